"""Retrieval, unions, windows, decisions, evaluation, learning and output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import text as X
from kinfold.operators import collective, decision, learning, output, retrieval, statistics, windows
from kinfold.sources import records as R

from .registry import PAIRS, REC, TERMS, TRUTH, query, topk

#: Words and character trigrams that more records have than this are no retrieval terms.
CAP, GRAM_CAP = 2000, 3000


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return R.records(spark, sf).select("code", "country", "src", X.terms(F.col("nt"), F.col("at")).alias("terms"))


def _forward(spark: SparkSession, sf: str, k: int = 30) -> DataFrame:
    rows = _terms(spark, sf)
    return retrieval.idf_topk(rows.filter("src = 1"), rows.filter("src > 1"), k, CAP)


def _reverse(spark: SparkSession, sf: str, k: int = 3) -> DataFrame:
    rows = _terms(spark, sf)
    got = retrieval.idf_topk(rows.filter("src > 1"), rows.filter("src = 1"), k, CAP)
    return got.select(F.col("cand").alias("s1"), F.col("s1").alias("cand"), R.source_of(F.col("s1")).alias("src"), "score", "rank")


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return R.names(spark, sf).select("code", "country", "src", F.col("nt").alias("terms"))


def _trigrams(spark: SparkSession, sf: str) -> DataFrame:
    return R.terms(spark, sf, "name-trigrams", lambda name, address: X.trigrams(name), R.names)


FORWARD = f"{TERMS}, {topk('tm', 'src = 1', 'src > 1', 30, CAP)}"
NAMES = f"{REC}, nm AS (SELECT code, country, src, nt AS terms FROM rec), {topk('nm', 'src = 1', 'src > 1', 10, CAP)}"


@query("jn_idf_topk_fwd", f"WITH {FORWARD} SELECT s1, cand, src, score, rank FROM hits")
def jn_idf_topk_fwd(spark: SparkSession, sf: str) -> DataFrame:
    return _forward(spark, sf)


@query("jn_idf_topk_rev", f"WITH {TERMS}, {topk('tm', 'src > 1', 'src = 1', 3, CAP)} SELECT cand AS s1, s1 AS cand, s1 // 10000000000 AS src, score, rank FROM hits")
def jn_idf_topk_rev(spark: SparkSession, sf: str) -> DataFrame:
    return _reverse(spark, sf)


@query("jn_name_topk", f"WITH {NAMES} SELECT s1, cand, src, score, rank FROM hits")
def jn_name_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _names(spark, sf)
    return retrieval.idf_topk(rows.filter("src = 1"), rows.filter("src > 1"), 10, CAP)


@query("jn_char3_topk", f"WITH {REC}, ch AS (SELECT code, country, src, list_distinct(flatten(list_transform(nt, lambda t: list_transform(range(1, len(t) + 1), lambda i: ('#' || t || '#')[i:i + 2])))) AS terms FROM rec), {topk('ch', 'src = 1', 'src > 1', 10, GRAM_CAP)} SELECT s1, cand, src, score, rank FROM hits")
def jn_char3_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _trigrams(spark, sf)
    return retrieval.idf_topk(rows.filter("src = 1"), rows.filter("src > 1"), 10, GRAM_CAP)


@query("jn_bm25_topk", f"""WITH {REC}, x AS (SELECT DISTINCT code, country, src, unnest(nt) AS term FROM rec), nn AS (SELECT country, src, count(*) AS n FROM rec WHERE src > 1 GROUP BY ALL),
wt AS (SELECT country, src, term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS w FROM x JOIN nn USING (country, src) GROUP BY country, src, term HAVING count(*) <= {CAP}),
p AS (SELECT code AS cand, country, src, term, w FROM x JOIN wt USING (country, src, term)), l AS (SELECT cand, country, src, count(*) AS len FROM p GROUP BY ALL), m AS (SELECT country, src, avg(len) AS mean FROM l GROUP BY ALL),
d AS (SELECT cand, 2.2 / (1 + 1.2 * (0.25 + 0.75 * len / mean)) AS damp FROM l JOIN m USING (country, src)),
s AS (SELECT q.code AS s1, p.src AS src, p.cand AS cand, sum(p.w) AS w FROM x q JOIN p ON q.country = p.country AND q.term = p.term WHERE q.src = 1 GROUP BY ALL),
r AS (SELECT s1, cand, src, round(w * damp, 9) AS score FROM s JOIN d USING (cand))
SELECT *, row_number() OVER (PARTITION BY s1, src ORDER BY score DESC, cand) - 1 AS rank FROM r QUALIFY rank < 10""")
def jn_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _names(spark, sf)
    return retrieval.bm25_topk(rows.filter("src = 1"), rows.filter("src > 1"), 10, CAP)


VECTORS = "e AS (SELECT vec_id AS code, CAST(label AS VARCHAR) AS country, CASE WHEN vec_id % 3 = 0 THEN 1 WHEN vec_id % 3 = 1 THEN 2 ELSE 3 END AS src, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("jn_dense_knn", f"""WITH {VECTORS}, s AS (SELECT q.code AS s1, p.code AS cand, p.src AS src, round(list_inner_product(q.v, p.v), 9) AS score FROM e q JOIN e p ON q.country = p.country WHERE q.src = 1 AND p.src > 1),
f AS (SELECT s1, cand, src, score, row_number() OVER (PARTITION BY s1, src ORDER BY score DESC, cand) - 1 AS rank_f FROM s QUALIFY rank_f < 10), r AS (SELECT s1, cand, src, score, row_number() OVER (PARTITION BY cand ORDER BY score DESC, s1) - 1 AS rank_r FROM s QUALIFY rank_r < 2)
SELECT s1, cand, CAST(coalesce(f.src, r.src) AS BIGINT) AS src, coalesce(f.score, r.score) AS cos, coalesce(rank_f, 99) AS rank_f, coalesce(rank_r, 99) AS rank_r FROM f FULL JOIN r USING (s1, cand) WHERE coalesce(rank_f, 99) < 5 OR coalesce(rank_r, 99) < 2""")
def jn_dense_knn(spark: SparkSession, sf: str) -> DataFrame:
    src = F.when(F.col("vec_id") % 3 == 0, 1).when(F.col("vec_id") % 3 == 1, 2).otherwise(3)
    rows = R.table(spark, sf, "embeddings").select(F.col("vec_id").alias("code"), F.col("label").cast("string").alias("country"), src.alias("src"), F.col("embedding").cast("array<double>").alias("v"))
    forward = retrieval.dense_knn(rows.filter("src = 1"), rows.filter("src > 1"), 10).select("s1", "cand", "src", "score", F.col("rank").alias("rank_f"))
    back = retrieval.dense_knn(rows.filter("src > 1"), rows.filter("src = 1").withColumn("src", F.lit(1)), 2).select(F.col("cand").alias("s1"), F.col("s1").alias("cand"), F.col("score").alias("back"), F.col("rank").alias("rank_r"))
    got = forward.join(back, ["s1", "cand"], "full")
    both = got.select("s1", "cand", F.coalesce("src", F.when(F.col("cand") % 3 == 1, 2).otherwise(3)).alias("src"), F.coalesce("score", "back").alias("cos"), F.coalesce("rank_f", F.lit(99)).alias("rank_f"), F.coalesce("rank_r", F.lit(99)).alias("rank_r"))
    return both.filter("rank_f < 5 OR rank_r < 2")


@query("jn_superset", """WITH t AS (SELECT DISTINCT p_name AS name, list_distinct(string_split(p_name || ' ' || lower(p_type) || ' ' || lower(p_brand), ' ')) AS w FROM part), c AS (SELECT DISTINCT string_split(p_name, ' ')[2] || ' ' || lower(p_type) AS name FROM part)
SELECT md5(array_to_string(list_sort(t.w), ' ')) AS s1, c.name AS cand FROM (SELECT DISTINCT list_sort(w) AS w FROM t) t JOIN c ON list_has_all(t.w, string_split(c.name, ' '))""")
def jn_superset(spark: SparkSession, sf: str) -> DataFrame:
    part = R.table(spark, sf, "part")
    words = F.array_sort(F.array_distinct(F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand")), " ")))
    targets = part.select(words.alias("words")).distinct().select(F.md5(F.array_join("words", " ")).alias("s1"), "words")
    cand = F.concat(F.get(F.split("p_name", " "), 1), F.lit(" "), F.lower("p_type"))
    return retrieval.superset(targets, part.select(cand.alias("cand")).distinct().select("cand", F.split("cand", " ").alias("words")))


@query("jn_name_group", """WITH g AS (SELECT p_partkey AS s1, p_brand AS country, p_name AS name, count(*) OVER w AS n, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) - 1 AS i FROM part WINDOW w AS (PARTITION BY p_brand, p_name)),
k AS (SELECT * FROM g WHERE n > 1 AND (n <= 30 OR i = ceil(floor(i * 30 / n) * n / 30.0)))
SELECT g.s1, k.s1 AS other FROM g JOIN k USING (country, name) WHERE g.n > 1 AND g.s1 <> k.s1""")
def jn_name_group(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.name_group(R.table(spark, sf, "part").select(F.col("p_partkey").alias("s1"), F.col("p_brand").alias("country"), F.col("p_name").alias("name")))


def _channels(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    names, grams = _names(spark, sf), _trigrams(spark, sf)
    return {"name": retrieval.idf_topk(names.filter("src = 1"), names.filter("src > 1"), 10, CAP), "char": retrieval.idf_topk(grams.filter("src = 1"), grams.filter("src > 1"), 10, GRAM_CAP)}


CHANNELS = f"""{REC}, nm AS (SELECT code, country, src, nt AS terms FROM rec), ch AS (SELECT code, country, src, list_distinct(flatten(list_transform(nt, lambda t: list_transform(range(1, len(t) + 1), lambda i: ('#' || t || '#')[i:i + 2])))) AS terms FROM rec),
c1 AS (WITH {topk('nm', 'src = 1', 'src > 1', 10, CAP)} SELECT * FROM hits), c2 AS (WITH {topk('ch', 'src = 1', 'src > 1', 10, GRAM_CAP)} SELECT * FROM hits)"""


@query("jn_union_channels", f"WITH {CHANNELS} SELECT s1, cand, src, c1.score AS name_score, coalesce(c1.rank, 99) AS name_rank, c2.score AS char_score, coalesce(c2.rank, 99) AS char_rank, CAST(c1.rank IS NOT NULL AS BIGINT) AS in_name, CAST(c2.rank IS NOT NULL AS BIGINT) AS in_char FROM c1 FULL JOIN c2 USING (s1, cand, src)")
def jn_union_channels(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.union_channels(_channels(spark, sf))


@query("jn_anti_new", f"WITH {CHANNELS} SELECT s1, cand, src FROM c2 WHERE (s1, cand) NOT IN (SELECT (s1, cand) FROM c1)")
def jn_anti_new(spark: SparkSession, sf: str) -> DataFrame:
    grams = _trigrams(spark, sf)
    known = jn_name_topk(spark, sf).groupBy("s1", "src").agg(F.collect_list("cand").alias("cands"))
    known = R.written(spark, known, f"{sf}/documents.parquet", "name-hits")
    return retrieval.new_hits(retrieval.idf_hits(grams.filter("src = 1"), grams.filter("src > 1"), 10, GRAM_CAP), known, 10)


@query("jn_rrf", f"WITH {CHANNELS}, s AS (SELECT s1, cand, src, round(sum(1 / (60.0 + rank)), 9) AS score FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2) GROUP BY s1, cand, src) SELECT *, row_number() OVER (PARTITION BY s1, src ORDER BY score DESC, cand) - 1 AS rank FROM s QUALIFY rank < 5")
def jn_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.rrf(_channels(spark, sf), 5)


@query("jn_label_pairs", f"WITH {NAMES}, {TRUTH}, o AS (SELECT m, min(s1) AS s FROM truth GROUP BY m) SELECT h.s1, cand, src, score, rank, CAST(coalesce(o.s = h.s1, false) AS BIGINT) AS label FROM hits h LEFT JOIN o ON o.m = cand")
def jn_label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.labelled(jn_name_topk(spark, sf), R.owners(R.names(spark, sf))).select("s1", "cand", "src", "score", "rank", "label")


@query("jn_anchor", f"""WITH {REC}, nm AS (SELECT code, country, src, nt AS terms FROM rec), f AS (WITH {topk('nm', 'src = 1', 'src > 1', 10, CAP)} SELECT * FROM hits), a AS (SELECT s1, cand AS anchor FROM f WHERE score >= 0.9),
g AS (WITH {topk('nm', 'src > 1', 'src > 1', 4, CAP)} SELECT * FROM hits), b AS (SELECT s1 AS anchor, cand, src, score, row_number() OVER (PARTITION BY s1, src ORDER BY score DESC, cand) - 1 AS rk FROM g WHERE s1 <> cand QUALIFY rk < 3)
SELECT s1, cand, src, max(score) AS anc_score, min(rk) AS anc_rank, count(*) AS anc_hits FROM a JOIN b USING (anchor) GROUP BY s1, cand, src""")
def jn_anchor(spark: SparkSession, sf: str) -> DataFrame:
    rows = _names(spark, sf)
    pool = rows.filter("src > 1")
    sure = retrieval.ranked(retrieval.idf_hits(rows.filter("src = 1"), pool, 10, CAP, 0.9), 10).select("s1", F.col("cand").alias("anchor"))
    sure = R.written(spark, sure, f"{sf}/documents.parquet", "anchors")
    asked = pool.join(sure.select(F.col("anchor").alias("code")).distinct(), "code", "left_semi").select("code", "country", "terms")
    return retrieval.anchored(sure, retrieval.idf_hits(asked, pool, 3, CAP, others=True))


@query("jn_score_combine", f"WITH {PAIRS} SELECT s1, cand, CASE WHEN cand % 5 = 0 THEN prob ELSE least(prob, round(prob * 0.5 + label * 0.3, 6)) END AS prob FROM pr")
def jn_score_combine(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.scored(spark, sf)
    second = rows.filter("cand % 5 <> 0").select("s1", "cand", F.round(F.col("prob") * 0.5 + F.col("label") * 0.3, 6).alias("prob"))
    return retrieval.combined({"a": rows, "b": second})


IDF = "WITH {rec}, t AS (SELECT DISTINCT code, unnest({w}) AS token FROM rec WHERE src = 1), n AS (SELECT count(*) AS n FROM rec WHERE src = 1) SELECT token, count(*) AS df, round(ln(any_value(n) + 1) - ln(count(*) + 1), 9) AS idf FROM t, n GROUP BY token"


@query("agg_token_idf", IDF.format(rec=REC, w="list_concat(nt, aw)"))
def agg_token_idf(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.token_idf(R.records(spark, sf).filter("src = 1").select(F.concat("nt", "at").alias("w")), "w")


@query("agg_noise_score", f"""WITH {REC}, t AS (SELECT token, count(*) AS dt FROM (SELECT DISTINCT code, unnest(nt) AS token FROM rec WHERE src > 1) GROUP BY token), o AS (SELECT token, count(*) AS d FROM (SELECT DISTINCT code, unnest(nt) AS token FROM rec WHERE src = 1) GROUP BY token),
n AS (SELECT count(*) FILTER (WHERE src > 1) AS nt, count(*) FILTER (WHERE src = 1) AS no FROM rec)
SELECT token, round(ln((coalesce(dt, 0) + 1) / (nt + 1.0)) - ln((coalesce(d, 0) + 1) / (no + 1.0)), 9) AS noise FROM t FULL JOIN o USING (token), n""")
def agg_noise_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.records(spark, sf)
    return statistics.noise(rows.filter("src > 1").select("nt"), rows.filter("src = 1").select("nt"), "nt")


@query("agg_name_counts", "SELECT p_name AS name, count(*) AS n, count(DISTINCT p_brand) AS n_brands FROM part GROUP BY p_name")
def agg_name_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("n_brands"))


@query("agg_pool_names", f"WITH {REC} SELECT country, name, count(*) AS n, count(*) FILTER (WHERE addr = '') AS n_empty FROM rec WHERE src > 1 GROUP BY country, name")
def agg_pool_names(spark: SparkSession, sf: str) -> DataFrame:
    return R.records(spark, sf).filter("src > 1").groupBy("country", "name").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("addr") == "").cast("int")).alias("n_empty"))


ONE = "row_number() OVER (PARTITION BY cand ORDER BY prob DESC, s1)"


@query("agg_competition_full", f"""WITH {PAIRS}, r AS (SELECT *, {ONE} AS r, max(prob) OVER (PARTITION BY cand) AS top, count(*) OVER (PARTITION BY cand) AS n FROM pr), s AS (SELECT cand, prob AS p2 FROM r WHERE r = 2)
SELECT s1, cand, CASE WHEN r = 1 THEN coalesce(p2, 0) ELSE top END AS comp_best_other, round(prob - CASE WHEN r = 1 THEN coalesce(p2, 0) ELSE top END, 9) AS comp_margin, CAST(r = 1 AS BIGINT) AS comp_is_top, n AS comp_n FROM r LEFT JOIN s USING (cand)""")
def agg_competition_full(spark: SparkSession, sf: str) -> DataFrame:
    return windows.competition(R.scored(spark, sf).select("s1", "cand", "prob")).drop("prob")


@query("agg_competition_fwd", f"""WITH {PAIRS}, f AS (SELECT * FROM pr WHERE prob >= 0.3), r AS (SELECT *, {ONE} AS r FROM f), t AS (SELECT cand, max(prob) FILTER (WHERE r = 1) AS p1, max(s1) FILTER (WHERE r = 1) AS top, max(prob) FILTER (WHERE r = 2) AS p2, count(*) AS n FROM r GROUP BY cand)
SELECT pr.s1, pr.cand, coalesce(CASE WHEN pr.s1 = top THEN p2 ELSE p1 END, 0) AS comp_best_other, round(CASE WHEN pr.prob >= 0.3 THEN pr.prob END - coalesce(CASE WHEN pr.s1 = top THEN p2 ELSE p1 END, 0), 9) AS comp_margin, CAST(coalesce(pr.s1 = top, false) AS BIGINT) AS comp_is_top, coalesce(n, 0) AS comp_n FROM pr LEFT JOIN t USING (cand)""")
def agg_competition_fwd(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.scored(spark, sf).select("s1", "cand", "prob")
    return windows.competition_forward(rows, rows.filter("prob >= 0.3")).select("s1", "cand", "comp_best_other", "comp_margin", "comp_is_top", "comp_n")


@query("agg_translit_dict", """WITH p AS (SELECT string_split(upper(replace(p_name, 'a', 'o')), ' ') AS x, string_split(p_name, ' ') AS y FROM part), a AS (SELECT unnest(x) AS native, unnest(y) AS latin FROM p WHERE len(x) = len(y)),
k AS (SELECT native, latin, count(*) AS k FROM a GROUP BY ALL), b AS (SELECT native, CAST(sum(k) AS BIGINT) AS n, arg_min(latin, (-k, latin)) AS latin, max(k) AS top FROM k GROUP BY native)
SELECT native, latin, n, round(top / CAST(n AS DOUBLE), 9) AS share FROM b WHERE n >= 3 AND top / CAST(n AS DOUBLE) >= 0.8""")
def agg_translit_dict(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.dictionary(R.table(spark, sf, "part").select(F.split(F.upper(F.replace("p_name", F.lit("a"), F.lit("o"))), " ").alias("native"), F.split("p_name", " ").alias("latin")))


@query("agg_number_support", f"""WITH {PAIRS}, e AS (SELECT s1, cand, prob, 0 AS pos, CAST(cand % 7 AS VARCHAR) AS num FROM pr UNION ALL SELECT s1, cand, prob, 1, CAST(cand % 11 + 100 AS VARCHAR) FROM pr),
w AS (SELECT s1, cand, pos, sum(prob) OVER (PARTITION BY s1, num) - prob AS p, count(*) OVER (PARTITION BY s1, num) - 1 AS n FROM e)
SELECT s1, cand, round(max(p) FILTER (WHERE pos = 0), 9) AS nsup_first_p, max(n) FILTER (WHERE pos = 0) AS nsup_first_n, round(min(p) FILTER (WHERE pos = 1), 9) AS nsup_extra_p, min(n) FILTER (WHERE pos = 1) AS nsup_extra_n FROM w GROUP BY s1, cand""")
def agg_number_support(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.scored(spark, sf).select("s1", "cand", "prob", F.array((F.col("cand") % 7).cast("string"), (F.col("cand") % 11 + 100).cast("string")).alias("numbers"))
    return statistics.number_support(rows)


@query("agg_source_audit", """SELECT lang, count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, min(doc_id) AS min_id, max(doc_id) AS max_id, count(*) FILTER (WHERE coalesce(text, '') = '') AS n_empty, count(DISTINCT text) AS n_texts, round(avg(length(coalesce(text, ''))), 6) AS mean_chars,
round(quantile_cont(length(coalesce(text, '')), 0.5), 6) AS p50_chars, round(quantile_cont(length(coalesce(text, '')), 0.95), 6) AS p95_chars, max(length(coalesce(text, ''))) AS max_chars, count(*) FILTER (WHERE regexp_matches(text, '[0-9]')) AS n_digits, count(*) FILTER (WHERE regexp_matches(text, '[^\\x00-\\x7F]')) AS n_nonascii FROM documents GROUP BY lang""")
def agg_source_audit(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.source_audit(R.table(spark, sf, "documents"), "lang", "doc_id", "text")


@query("agg_gt_audit", """WITH t AS (SELECT c_custkey AS s1, o_orderkey AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey), p AS (SELECT s1, count(m) AS n_matches FROM t GROUP BY s1), x AS (SELECT count(*) AS k FROM (SELECT m FROM t WHERE m IS NOT NULL GROUP BY m HAVING count(DISTINCT s1) > 1))
SELECT n_matches, count(*) AS n_entities, any_value(k) AS n_multi_claimed FROM p, x GROUP BY n_matches""")
def agg_gt_audit(spark: SparkSession, sf: str) -> DataFrame:
    c, o = R.table(spark, sf, "customer"), R.table(spark, sf, "orders")
    return statistics.match_counts(c.join(o, c.c_custkey == o.o_custkey, "left").select(F.col("c_custkey").alias("s1"), F.col("o_orderkey").alias("m")))


@query("agg_cross_checks", f"""WITH {REC}, {TRUTH} SELECT (SELECT count(*) FROM truth) AS n_pairs, CAST(0 AS BIGINT) AS n_cross, (SELECT round(avg(abs(s1 % 10000000000 - m % 10000000000)), 6) FROM truth) AS mean_id_diff, (SELECT count(*) FROM rec WHERE src > 1 AND code NOT IN (SELECT m FROM truth)) AS n_unmatched""")
def agg_cross_checks(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.records(spark, sf)
    return statistics.cross_checks(R.owners(rows), rows.filter("src = 1"), rows.filter("src > 1"))


@query("agg_profile", f"""WITH {NAMES}, p AS (SELECT src, s1, max(score) FILTER (WHERE rank = 0) AS a, coalesce(max(score) FILTER (WHERE rank = 1), 0) AS b, avg(score) FILTER (WHERE rank < 5) AS five FROM hits GROUP BY src, s1)
SELECT src, count(*) AS n, round(avg(a), 6) AS top1, round(avg(b), 6) AS top2, round(avg(five), 6) AS top5, round(avg(a - b), 6) AS gap, round(avg(CAST(a > 0.5 AS INT)), 6) AS over_half, round(quantile_cont(a, 0.1), 6) AS p10 FROM p GROUP BY src""")
def agg_profile(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.profile(jn_name_topk(spark, sf))


@query("agg_recall_at_k", f"""WITH {NAMES}, {TRUTH}, k AS (SELECT unnest([1, 3, 5, 10, 20, 30]) AS depth), h AS (SELECT truth.s1, rank FROM truth LEFT JOIN hits ON hits.s1 = truth.s1 AND hits.cand = truth.m),
p AS (SELECT depth, s1, count(*) AS n, count(*) FILTER (WHERE rank < depth) AS h FROM h, k GROUP BY depth, s1)
SELECT CAST(depth AS BIGINT) AS depth, round(sum(h) / CAST(sum(n) AS DOUBLE), 6) AS recall, round(avg(CASE WHEN h = 0 THEN 0 ELSE 1.25 * h / (0.25 * n + h) END), 6) AS oracle_f05, round(avg(CAST(h = n AS INT)), 6) AS full_coverage FROM p GROUP BY depth""")
def agg_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.recall_at(R.owners(R.names(spark, sf)), jn_name_topk(spark, sf))


@query("agg_union_recall", f"""WITH {CHANNELS}, {TRUTH}, t AS (SELECT DISTINCT s1, m AS cand FROM truth), f AS (SELECT s1, cand FROM c2 EXCEPT SELECT s1, cand FROM c1),
k AS (SELECT (SELECT count(*) FROM t) AS n_truth, (SELECT count(*) FROM t SEMI JOIN c1 USING (s1, cand)) AS n_old, (SELECT count(*) FROM f) AS n_new, (SELECT count(*) FROM t SEMI JOIN f USING (s1, cand)) AS n_recovered)
SELECT *, round(n_old / CAST(n_truth AS DOUBLE), 6) AS recall_old, round((n_old + n_recovered) / CAST(n_truth AS DOUBLE), 6) AS recall_union FROM k""")
def agg_union_recall(spark: SparkSession, sf: str) -> DataFrame:
    c = _channels(spark, sf)
    return statistics.channel_report(R.owners(R.names(spark, sf)), c["name"], c["char"])


AUC = "s AS (SELECT src, prob, count(*) AS n, sum(label) AS pos FROM pr GROUP BY src, prob), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY src ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS r FROM s)"


@query("agg_auc", f"WITH {PAIRS}, {AUC} SELECT src, round((sum(pos * r) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * CAST(sum(n) - sum(pos) AS DOUBLE)), 6) AS auc FROM r GROUP BY src")
def agg_auc(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.auc(R.scored(spark, sf), ["src"])


CLIP = "least(greatest({}, 1e-7), 1 - 1e-7)"


@query("agg_logloss", f"WITH {PAIRS}, c AS (SELECT *, {CLIP.format('prob')} AS p FROM pr) SELECT src, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS log_loss, round(avg(prob), 6) AS mean_prob, round(avg(label), 6) AS rate FROM c GROUP BY src")
def agg_logloss(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.log_loss(R.scored(spark, sf), ["src"])


LOGIT = "ln({0} / (1 - {0}))"


@query("agg_gates", f"""WITH {PAIRS}, b AS (SELECT *, round(prob * 0.9 + label * 0.1, 6) AS q FROM pr), d AS (SELECT src, s1, {LOGIT.format(CLIP.format('q'))} - {LOGIT.format(CLIP.format('prob'))} AS d, CAST((prob >= 0.5) <> (q >= 0.5) AS INT) AS x FROM b),
p AS (SELECT src, s1, max(x) AS x, sum(d) AS sd, sum(d * d) AS sq, count(*) AS n, sum(CAST(abs(d) > 1 AS INT)) AS big FROM d GROUP BY src, s1)
SELECT src, round(1000 * avg(x), 6) AS changed_per_1000, round(sum(sd) / sum(n), 6) AS shift, round(sqrt(greatest(sum(sq) / sum(n) - (sum(sd) / sum(n)) * (sum(sd) / sum(n)), 0)), 6) AS shift_sd, round(sum(big) / CAST(sum(n) AS DOUBLE), 6) AS share_over_1 FROM p GROUP BY src""")
def agg_gates(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.scored(spark, sf).withColumn("q", F.round(F.col("prob") * 0.9 + F.col("label") * 0.1, 6))
    return statistics.gates(rows, "prob", "q", "src")


@query("agg_loss_bands", f"""WITH {PAIRS}, w AS (SELECT *, CAST(CAST(prob >= 0.5 AS INT) <> label AS INT) AS wrong, count(*) OVER (PARTITION BY s1) AS n FROM pr)
SELECT CAST(CASE WHEN prob >= 0.75 THEN 4 WHEN prob >= 0.5 THEN 3 WHEN prob >= 0.25 THEN 2 WHEN prob >= 0.1 THEN 1 ELSE 0 END AS BIGINT) AS band, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_right, CAST(sum(wrong) AS BIGINT) AS n_wrong, round(sum(wrong / CAST(n AS DOUBLE)), 6) AS weighted_wrong FROM w GROUP BY band""")
def agg_loss_bands(spark: SparkSession, sf: str) -> DataFrame:
    return decision.loss_budget(R.scored(spark, sf), [0.1, 0.25, 0.5, 0.75])


@query("win_context", f"WITH {PAIRS} SELECT s1, cand, count(*) OVER w AS n_cands, round(max(prob) OVER w - prob, 9) AS prob_gap, rank() OVER (PARTITION BY s1 ORDER BY prob DESC) AS prob_rank FROM pr WINDOW w AS (PARTITION BY s1)")
def win_context(spark: SparkSession, sf: str) -> DataFrame:
    return windows.context(R.scored(spark, sf).select("s1", "cand", "prob"), ["prob"]).drop("prob")


@query("win_leave_one_out", f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY prob DESC, cand) AS r, max(prob) OVER (PARTITION BY s1) AS t, count(*) OVER (PARTITION BY s1) AS n FROM pr), s AS (SELECT s1, prob AS p2 FROM r WHERE r = 2) SELECT s1, cand, CASE WHEN r = 1 THEN p2 ELSE t END AS max_other, r - 1 AS rank0, n AS size FROM r LEFT JOIN s USING (s1)")
def win_leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    return windows.leave_one_out(R.scored(spark, sf).select("s1", "cand", "prob"), ["s1"], "prob").drop("prob")


def _grp(by: str, prefix: str) -> str:
    p = prefix
    return f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY prob DESC, s1, cand) AS r, count(*) OVER w AS n, sum(prob) OVER w AS s, max(prob) OVER w AS t, sum(CAST(prob >= 0.1 AS INT)) OVER w AS a, sum(CAST(prob >= 0.5 AS INT)) OVER w AS b, sum(CAST(prob >= 0.9 AS INT)) OVER w AS c,
  lead(prob) OVER (PARTITION BY {by} ORDER BY prob DESC, s1, cand) AS nx, lag(prob) OVER (PARTITION BY {by} ORDER BY prob DESC, s1, cand) AS pv FROM pr WINDOW w AS (PARTITION BY {by})), q AS (SELECT {by}, prob AS p2 FROM r WHERE r = 2)
SELECT s1, cand, n AS {p}n, CASE WHEN r = 1 THEN coalesce(p2, 0) ELSE t END AS {p}max_other, round(s - prob, 9) + 0 AS {p}sum_other, r AS {p}rank, round(t - prob, 9) AS {p}gap_top, round(prob / greatest(s, 1e-9), 9) AS {p}share, CAST(a - CAST(prob >= 0.1 AS INT) AS BIGINT) AS {p}n10_other, CAST(b - CAST(prob >= 0.5 AS INT) AS BIGINT) AS {p}n50_other, CAST(c - CAST(prob >= 0.9 AS INT) AS BIGINT) AS {p}n90_other,
  round(prob - coalesce(nx, 0), 9) AS {p}gap_next, round(coalesce(pv, 1) - prob, 9) AS {p}gap_prev, round(s - r, 9) + 0 AS {p}expcnt_minus_rank FROM r LEFT JOIN q USING ({by})"""


@query("win_grp_stats", _grp("s1", "e_"))
def win_grp_stats(spark: SparkSession, sf: str) -> DataFrame:
    return windows.group_stats(R.scored(spark, sf).select("s1", "cand", "prob"), ["s1"], "e_", neighbours=True).drop("prob")


@query("l2_group_stats", _grp("s1, src", "es_"))
def l2_group_stats(spark: SparkSession, sf: str) -> DataFrame:
    return windows.group_stats(R.scored(spark, sf).select("s1", "src", "cand", "prob"), ["s1", "src"], "es_", neighbours=True).drop("prob", "src")


@query("win_other_source", f"WITH {PAIRS}, k AS (SELECT *, cand % 13 AS k FROM pr), m AS (SELECT s1, k, src, max(prob) AS mx FROM k GROUP BY ALL) SELECT k.s1, cand, coalesce(mx, -1) AS max_other_src FROM k LEFT JOIN m ON m.s1 = k.s1 AND m.k = k.k AND m.src = 5 - k.src")
def win_other_source(spark: SparkSession, sf: str) -> DataFrame:
    return windows.other_source(R.scored(spark, sf).withColumn("k", F.col("cand") % 13), "k").select("s1", "cand", "max_other_src")


@query("win_anchors", f"""WITH {PAIRS}, a AS (SELECT s1, count(*) FILTER (WHERE prob >= 0.7) AS n, sum(prob) FILTER (WHERE prob >= 0.7) AS s FROM pr GROUP BY s1) SELECT s1, cand, row_number() OVER (PARTITION BY s1 ORDER BY prob DESC, cand) - 1 AS p2_rank, CAST(prob >= 0.7 AS BIGINT) AS is_anchor, n AS n_anchors, round(coalesce(s / n, 0), 9) AS anchor_p_mean FROM pr JOIN a USING (s1)""")
def win_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return windows.anchors(R.scored(spark, sf).select("s1", "cand", "prob"), 0.7).drop("prob")


@query("win_stacker", f"""WITH {PAIRS}, l AS (SELECT *, round({LOGIT.format(CLIP.format('prob'))}, 6) AS logit, row_number() OVER (PARTITION BY s1 ORDER BY prob DESC, cand) AS r, count(*) OVER (PARTITION BY s1) AS n FROM pr), t AS (SELECT s1, max(logit) AS t, max(logit) FILTER (WHERE r = 2) AS p2, count(*) FILTER (WHERE prob BETWEEN 1e-3 AND 0.999) AS band, count(*) FILTER (WHERE prob >= 0.999) AS sure FROM l GROUP BY s1)
SELECT s1, cand, logit, r - 1 AS ce_rank, CASE WHEN n = 1 THEN 20 ELSE round(logit - coalesce(CASE WHEN r = 1 THEN p2 ELSE t END, -20), 6) END AS ce_gap, coalesce(CASE WHEN r = 1 THEN p2 ELSE t END, -20) AS ce_max_o, band AS n_band, sure AS n_sure FROM l JOIN t USING (s1)""")
def win_stacker(spark: SparkSession, sf: str) -> DataFrame:
    return windows.stacker(R.scored(spark, sf).select("s1", "cand", "prob")).drop("prob")


@query("l2_source_room", f"""WITH {PAIRS}, w AS (SELECT *, CAST(prob >= 0.5 AS INT) AS c, sum(CAST(prob >= 0.5 AS INT)) OVER (PARTITION BY s1, src) AS own, sum(CAST(prob >= 0.5 AS INT)) OVER (PARTITION BY s1) AS al, sum(prob) OVER (PARTITION BY s1, src) AS sp FROM pr)
SELECT s1, cand, CAST(own - c AS BIGINT) AS n_conf_src_other, CAST(al - own AS BIGINT) AS n_conf_othersrc, round(sp - prob, 9) AS sum_p_src_other, CAST(CASE WHEN src = 2 THEN 5 ELSE 6 END - (own - c) AS BIGINT) AS src_cap_room, CAST(al AS BIGINT) AS ent_conf_n FROM w""")
def l2_source_room(spark: SparkSession, sf: str) -> DataFrame:
    return windows.source_room(R.scored(spark, sf).select("s1", "cand", "src", "prob")).drop("src", "prob")


@query("col_empty_context", f"""WITH {PAIRS}, e AS (SELECT s1, cand, round(prob * 100, 6) AS sim, CAST(cand % 4 = 0 AS BIGINT) AS empty, cand % 9 AS name FROM pr)
SELECT s1, cand, CAST(sum(empty) OVER w AS BIGINT) AS ent_n_empty, CAST(sum(CAST(empty = 1 AND sim >= 90 AS INT)) OVER w AS BIGINT) AS ent_n_empty_sim, CAST(CASE WHEN empty = 1 THEN row_number() OVER (PARTITION BY s1, empty ORDER BY sim DESC, cand) - 1 ELSE -1 END AS BIGINT) AS empty_sim_rank, count(*) OVER (PARTITION BY s1, name) AS c_name_ent_n FROM e WINDOW w AS (PARTITION BY s1)""")
def col_empty_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.scored(spark, sf).select("s1", "cand", "prob", F.round(F.col("prob") * 100, 6).alias("sim"), (F.col("cand") % 9).alias("name"), (F.col("cand") % 4 == 0).cast("int").alias("empty"))
    return collective.empty_context(rows).fillna(-1, ["empty_sim_rank"])


@query("col_sibling_numbers", f"""WITH {PAIRS}, e AS (SELECT s1, cand, prob, cand % 5 AS num FROM pr) SELECT x.s1, x.cand, CAST(coalesce(max(CAST(y.cand IS NOT NULL AS INT)), 0) AS BIGINT) AS sib_num_eq FROM e x LEFT JOIN e y ON x.s1 = y.s1 AND x.cand <> y.cand AND x.num = y.num AND y.prob >= 0.5 GROUP BY x.s1, x.cand""")
def col_sibling_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return collective.sibling_numbers(R.scored(spark, sf).select("s1", "cand", "prob", (F.col("cand") % 5).alias("num")), 0.5)


@query("col_siblings")
def col_siblings(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.records(spark, sf).select(F.col("code").alias("cand"), "name", F.array_join("at", " ").alias("addr"), "at")
    return collective.siblings(jn_name_topk(spark, sf).select("s1", "cand", F.col("score").alias("prob")), rows, 0.6)


@query("dec_exclusive", f"WITH {PAIRS} SELECT s1, cand, prob FROM pr QUALIFY {ONE} = 1")
def dec_exclusive(spark: SparkSession, sf: str) -> DataFrame:
    return decision.exclusive(R.scored(spark, sf)).select("s1", "cand", "prob")


@query("dec_threshold", f"WITH {PAIRS} SELECT s1, array_to_string(list(cand ORDER BY cand), ',') AS cands FROM pr WHERE prob >= 0.5 GROUP BY s1")
def dec_threshold(spark: SparkSession, sf: str) -> DataFrame:
    got = decision.threshold(R.scored(spark, sf), 0.5).groupBy("s1").agg(F.array_sort(F.collect_list("cand")).alias("c"))
    return got.select("s1", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("cands"))


EXPECTED = """{src}, o AS (SELECT s1, cand, least(greatest(prob, 0), 1) AS p, row_number() OVER (PARTITION BY s1 ORDER BY prob DESC, cand) AS i FROM x QUALIFY i <= 40), l AS (SELECT s1, list(p ORDER BY i) AS ps, list(cand ORDER BY i) AS cs FROM o GROUP BY s1),
k AS (SELECT s1, ps, cs, unnest(range(0, len(ps) + 1)) AS k FROM l), one AS (SELECT [CASE WHEN i = 1 THEN 1.0::DOUBLE ELSE 0.0 END FOR i IN range(1, 18)] AS d0),
m AS (SELECT s1, ps, cs, k, list_reduce(list_concat([d0], list_transform(ps[1:k], lambda p: [p])), lambda d, q: [CASE WHEN i = 1 THEN d[1] * (1 - q[1]) ELSE d[i] * (1 - q[1]) + d[i - 1] * q[1] END FOR i IN range(1, 18)]) AS a,
  list_reduce(list_concat([d0], list_transform(ps[k + 1:], lambda p: [p])), lambda d, q: [CASE WHEN i = 1 THEN d[1] * (1 - q[1]) ELSE d[i] * (1 - q[1]) + d[i - 1] * q[1] END FOR i IN range(1, 18)]) AS b FROM k, one),
v AS (SELECT s1, cs, k, round(CASE WHEN k = 0 THEN list_product(list_concat([1.0], list_transform(ps, lambda p: 1 - p))) ELSE
  list_sum(flatten([[CASE WHEN a[i] < 1e-12 OR a[i] * b[j] < 1e-12 OR i = 1 THEN 0 ELSE a[i] * b[j] * 1.25 * (i - 1) / (0.25 * (i + j - 2) + k) END FOR j IN range(1, 18)] FOR i IN range(1, 18)])) END, 9) AS v FROM m)"""


@query("dec_expected_f", f"WITH {PAIRS}, {EXPECTED.format(src='x AS (SELECT * FROM pr)')} SELECT s1, k, v AS value, array_to_string(cs[1:k], ',') AS cands FROM v QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY v DESC, k) = 1")
def dec_expected_f(spark: SparkSession, sf: str) -> DataFrame:
    got = decision.expected_f(R.scored(spark, sf).select("s1", "cand", "prob"))
    return got.select("s1", "k", "value", F.array_join(F.transform("cands", lambda x: x.cast("string")), ",").alias("cands"))


@query("dec_final", f"WITH {PAIRS}, {EXPECTED.format(src=f'x AS (SELECT * FROM pr WHERE prob >= 0.01 QUALIFY {ONE} = 1)')} SELECT s1, k, array_to_string(cs[1:k], ',') AS cands FROM v QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY v DESC, k) = 1")
def dec_final(spark: SparkSession, sf: str) -> DataFrame:
    got = decision.decided(R.scored(spark, sf).select("s1", "cand", "prob"))
    return got.select("s1", "k", F.array_join(F.transform("cands", lambda x: x.cast("string")), ",").alias("cands"))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.scored(spark, sf)
    truth = rows.select("s1", F.when(F.col("label") == 1, F.col("cand")).alias("m"))
    return decision.scores(decision.counted(truth, rows.filter("prob >= 0.4")))


COUNTS = f"""{PAIRS}, ct AS (SELECT s1, sum(label) AS n_true, count(*) FILTER (WHERE prob >= 0.4) AS n_pred, count(*) FILTER (WHERE prob >= 0.4 AND label = 1) AS tp FROM pr GROUP BY s1),
ev AS (SELECT *, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (0.25 * n_true + n_pred) END AS f, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1 WHEN n_pred = 0 THEN 0 ELSE tp / CAST(n_pred AS DOUBLE) END AS precision, CASE WHEN n_pred = 0 AND n_true = 0 THEN 1 WHEN n_true = 0 THEN 0 ELSE tp / CAST(n_true AS DOUBLE) END AS recall FROM ct)"""
MACRO = "count(*) AS n, round(avg(f), 6) AS f05, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall"


@query("evl_macro", f"WITH {COUNTS} SELECT {MACRO} FROM ev")
def evl_macro(spark: SparkSession, sf: str) -> DataFrame:
    return decision.macro(_counts(spark, sf), [])


@query("evl_groups", f"WITH {COUNTS} SELECT CASE WHEN n_true = 0 THEN '0' WHEN n_true = 1 THEN '1' WHEN n_true <= 3 THEN '2-3' ELSE '4+' END AS bucket, {MACRO} FROM ev GROUP BY bucket")
def evl_groups(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_true")
    return decision.macro(_counts(spark, sf).withColumn("bucket", F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").otherwise("4+")), ["bucket"])


@query("evl_micro", f"WITH {COUNTS}, s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(n_pred) - sum(tp) AS BIGINT) AS fp, CAST(sum(n_true) - sum(tp) AS BIGINT) AS fn FROM ct), pq AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS p, tp / CAST(tp + fn AS DOUBLE) AS r FROM s) SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(1.25 * p * r / (0.25 * p + r), 6) AS f05, round(2 * p * r / (p + r), 6) AS f1 FROM pq")
def evl_micro(spark: SparkSession, sf: str) -> DataFrame:
    return decision.micro(_counts(spark, sf))


@query("evl_cv", f"WITH {COUNTS}, g AS (SELECT CAST(('0x' || substr(md5(CAST(s1 AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS fold, avg(f) AS f, count(*) AS n FROM ev GROUP BY 1) SELECT fold, n, round(f, 6) AS f05, round((SELECT avg(f) FROM g), 6) AS mean, round((SELECT stddev_samp(f) FROM g), 6) AS sd FROM g")
def evl_cv(spark: SparkSession, sf: str) -> DataFrame:
    return decision.cross_validated(_counts(spark, sf), 5)


@query("evl_ceiling", f"WITH {COUNTS}, s AS (SELECT *, CASE WHEN n_true = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (0.25 * n_true + tp) END AS o FROM ct) SELECT round(avg(o), 6) AS oracle_f05, round(sum(tp) / CAST(sum(n_true) AS DOUBLE), 6) AS pair_recall, round(avg(n_pred), 6) AS mean_candidates FROM s")
def evl_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    rows = _counts(spark, sf)
    best = F.when(F.col("n_true") == 0, 1.0).otherwise(decision.f_beta(F.col("tp"), F.col("tp"), F.col("n_true")))
    return rows.agg(F.round(F.avg(best), 6).alias("oracle_f05"), F.round(F.sum("tp") / F.sum("n_true"), 6).alias("pair_recall"), F.round(F.avg("n_pred"), 6).alias("mean_candidates"))


@query("evl_rules", f"""WITH {PAIRS}, r AS (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7]) AS thr), ct AS (SELECT CAST(thr AS DOUBLE) AS thr, s1, sum(label) AS t, count(*) FILTER (WHERE prob >= thr) AS p, count(*) FILTER (WHERE prob >= thr AND label = 1) AS tp FROM pr, r GROUP BY ALL)
SELECT thr, count(*) AS n, round(avg(CASE WHEN p = 0 AND t = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (0.25 * t + p) END), 6) AS f05 FROM ct GROUP BY thr""")
def evl_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = F.explode(F.array(*[F.lit(t / 10) for t in range(2, 8)])).alias("thr")
    rows = R.scored(spark, sf).select("s1", "prob", "label", rules)
    hit = (F.col("prob") >= F.col("thr")).cast("int")
    per = rows.groupBy("thr", "s1").agg(F.sum("label").alias("n_true"), F.sum(hit).alias("n_pred"), F.sum(hit * F.col("label")).alias("tp"))
    return per.groupBy("thr").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(decision.f_beta(F.col("tp"), F.col("n_pred"), F.col("n_true"))), 6).alias("f05"))


@query("evl_paired_gain", f"""WITH {PAIRS}, c AS (SELECT s1, sum(label) AS t, count(*) FILTER (WHERE prob >= 0.4) AS p1, count(*) FILTER (WHERE prob >= 0.4 AND label = 1) AS h1, count(*) FILTER (WHERE prob >= 0.6) AS p2, count(*) FILTER (WHERE prob >= 0.6 AND label = 1) AS h2 FROM pr GROUP BY s1),
d AS (SELECT s1 % 3 AS g, CASE WHEN p2 = 0 AND t = 0 THEN 1 WHEN h2 = 0 THEN 0 ELSE 1.25 * h2 / (0.25 * t + p2) END - CASE WHEN p1 = 0 AND t = 0 THEN 1 WHEN h1 = 0 THEN 0 ELSE 1.25 * h1 / (0.25 * t + p1) END AS d FROM c)
SELECT g, count(*) AS n, round(avg(d), 6) AS gain, round(stddev_pop(d) / sqrt(count(*)), 6) AS se FROM d GROUP BY g""")
def evl_paired_gain(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.scored(spark, sf)
    truth = rows.select("s1", F.when(F.col("label") == 1, F.col("cand")).alias("m"))
    a, b = (decision.scores(decision.counted(truth, rows.filter(F.col("prob") >= t))).select("s1", "f", (F.col("s1") % 3).alias("g")) for t in (0.4, 0.6))
    return statistics.paired_gain(a, b, "g")


def _features(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Pairs with their features, which learners read several times: made once a session, by one shuffle of the pairs for what follows
    from a candidate's claimants and one for what follows from an entity's pairs."""

    def competing(rows: DataFrame) -> DataFrame:
        got = windows.leave_one_out(R.unique(rows), ["cand"], "prob")
        return got.select("s1", "cand", "prob", "label", F.coalesce("max_other", F.lit(0.0)).alias("comp_best_other"), (F.col("rank0") == 0).cast("int").alias("comp_is_top"), F.col("size").alias("comp_n"))

    make = lambda: R.in_turns(R.claims(spark, sf), "cand", competing, "s1", lambda rows: windows.context(rows, ["prob"]), "pair-features")
    rows = R.written(spark, make, f"{sf}/lineitem.parquet", "pair-features")
    rows = rows.withColumn("comp_margin", F.round(F.col("prob") - F.col("comp_best_other"), windows.D))
    return rows, ["prob", "comp_best_other", "comp_margin", "comp_is_top", "comp_n", "n_cands", "prob_gap", "prob_rank"]


@query("ml_stage1_cascade")
def ml_stage1_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return learning.cascade(*_features(spark, sf)).select("s1", "cand", "label", "p")


@query("ml_oof")
def ml_oof(spark: SparkSession, sf: str) -> DataFrame:
    rows, features = _features(spark, sf)
    return learning.stacked(rows, features, 3, 0.5).select("s1", "cand", "label", "p", "p2")


@query("snk_set_lists", f"WITH {PAIRS} SELECT o_orderkey AS pos, o_orderkey AS s1, coalesce(array_to_string(list(cand ORDER BY cand) FILTER (WHERE prob >= 0.5), ','), '') AS ids FROM orders LEFT JOIN pr ON s1 = o_orderkey GROUP BY o_orderkey")
def snk_set_lists(spark: SparkSession, sf: str) -> DataFrame:
    entities = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("s1"))
    return output.lists(entities, R.scored(spark, sf).filter("prob >= 0.5"))


@query("snk_verify", "SELECT * FROM (VALUES ('dup_row', 0), ('dup_id', 0), ('bad_id', 0), ('missing', (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0)), ('extra', 0)) AS t(fault, n)")
def snk_verify(spark: SparkSession, sf: str) -> DataFrame:
    entities = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("s1"))
    return output.verified(snk_set_lists(spark, sf).filter("s1 % 10 <> 0"), entities)


@query("snk_integrity", f"WITH {PAIRS} SELECT CAST(0 AS BIGINT) AS dup_entities, (SELECT count(DISTINCT s1) FROM pr WHERE prob >= 0.5 AND s1 NOT IN (SELECT o_orderkey FROM orders)) AS unknown_entities, (SELECT count(DISTINCT cand) FROM pr WHERE prob >= 0.5 AND cand NOT IN (SELECT p_partkey FROM part)) AS unknown_ids, (SELECT count(*) FROM pr WHERE prob >= 0.5 AND NOT prob >= 0.6) AS not_candidates")
def snk_integrity(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.scored(spark, sf).select("s1", "cand", "prob")
    entities, known = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("s1")), R.table(spark, sf, "part").select(F.col("p_partkey").alias("cand"))
    return output.integrity(entities, rows.filter("prob >= 0.5"), rows.filter("prob >= 0.6"), known)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Each record of source 1 with its matches: shared keys, overlap of rare words, a fixed linear score, one owner, best prefix."""
    from kinfold.operators import similarity

    rows = R.records(spark, sf)
    keyed = rows.select("code", "country", "src", X.record_keys(F.col("nt"), F.col("at")).alias("keys"))
    pairs = retrieval.key_join(keyed.filter("src = 1"), keyed.filter("src > 1"))
    idf = statistics.token_idf(rows.filter("src = 1").select(F.concat("nt", "at").alias("w")), "w").select("token", "idf")
    words = similarity.weighed(rows.select("code", F.concat("nt", "at").alias("w")), ["code"], "w", idf, 8.0)
    q, c = words.select(F.col("code").alias("s1"), F.col("words").alias("aw"), F.col("total").alias("at")), words.select(F.col("code").alias("cand"), F.col("words").alias("bw"), F.col("total").alias("bt"))
    overlap = similarity.idf_overlap(pairs.select("s1", "cand").join(q, "s1").join(c, "cand"))
    prob = F.round(1 / (1 + F.exp(-(12 * F.col("idf_u") - 6))), 6)
    chosen = decision.decided(overlap.select("s1", "cand", prob.alias("prob")))
    return rows.filter("src = 1").select(F.col("code").alias("s1")).join(chosen, "s1", "left").select("s1", F.coalesce("cands", F.array().cast("array<bigint>")).alias("cands"))

