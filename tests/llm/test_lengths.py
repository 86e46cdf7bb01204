"""A vector of another length does not keep the others from being found."""

from kinfold.llm import multi_index


def test_lengths_apart(spark):
    rows = [(i, [1.0, i / 100, 0.5, 0.25]) for i in range(60)] + [(100, [1.0] * 6), (101, [2.0] * 6), (120, [1.0] * 8)]
    got = {}
    for r in multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), share=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == {0, 20, 40, 100}
    assert [v for _, v in sorted(got[20])] == [*range(59, 39, -1)] and got[100] == [(1, 101)]
