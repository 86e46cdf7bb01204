"""Further level-two columns, training sets, sweeps and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from kinfold.functions import text as X
from kinfold.operators import crossed, decision, learning, retrieval, similarity, statistics, windows
from kinfold.sources import records as R

from .pair_queries import COUNTS, MACRO, NAMES, jn_name_topk
from .registry import CS, NULLS, PAIRS, REC, TRUTH, canonical, first_number, query, words
from .text_queries import _valued_sides


@query("key_hash")
def key_hash(spark: SparkSession, sf: str) -> DataFrame:
    keys = R.records(spark, sf).select(F.explode(X.record_keys(F.col("nt"), F.col("at"))).alias("key")).distinct()
    return keys.select("key", X.key_hash(F.col("key")).alias("h"), X.pair_hash(F.col("key"), F.length("key")).alias("p"))


@query("sim_counts", f"""WITH {NAMES}, n AS (SELECT name, count(*) AS n FROM rec WHERE src = 1 GROUP BY name)
SELECT h.s1, h.cand, CAST(len(q.nt) AS BIGINT) AS name_ntok_q, CAST(len(c.nt) AS BIGINT) AS name_ntok_c, CAST(abs(len(q.nt) - len(c.nt)) AS BIGINT) AS name_ntok_diff, CAST(len(c.aw) AS BIGINT) AS addr_ntok_c, CAST(c.addr = '' AS BIGINT) AS addr_empty_c,
  round(CASE WHEN greatest(len(q.name), len(c.name)) = 0 THEN 1 ELSE least(len(q.name), len(c.name)) / CAST(greatest(len(q.name), len(c.name)) AS DOUBLE) END, 6) AS name_len_ratio, coalesce(a.n, 0) AS s1_name_count, coalesce(b.n, 0) AS cand_name_count_in_s1
FROM hits h JOIN rec q ON q.code = h.s1 JOIN rec c ON c.code = h.cand LEFT JOIN n a ON a.name = q.name LEFT JOIN n b ON b.name = c.name""")
def sim_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.names(spark, sf)
    n = rows.filter("src = 1").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    q = rows.select(F.col("code").alias("s1"), F.col("name").alias("qn"), F.size("nt").alias("qs")).join(n.withColumnsRenamed({"name": "qn", "n": "s1_name_count"}), "qn", "left")
    c = rows.select(F.col("code").alias("cand"), F.col("name").alias("cn"), F.size("nt").alias("cs"), F.col("n_at").alias("addr_ntok_c"), (F.col("n_at") == 0).cast("int").alias("addr_empty_c")).join(n.withColumnsRenamed({"name": "cn", "n": "cand_name_count_in_s1"}), "cn", "left")
    both = jn_name_topk(spark, sf).select("s1", "cand").join(q, "s1").join(c, "cand")
    low, high = F.least(F.length("qn"), F.length("cn")), F.greatest(F.length("qn"), F.length("cn"))
    return both.select("s1", "cand", F.col("qs").alias("name_ntok_q"), F.col("cs").alias("name_ntok_c"), F.abs(F.col("qs") - F.col("cs")).alias("name_ntok_diff"), "addr_ntok_c", "addr_empty_c", F.when(high == 0, 1.0).otherwise(F.round(low / high, 6)).alias("name_len_ratio"), F.coalesce("s1_name_count", F.lit(0)).alias("s1_name_count"), F.coalesce("cand_name_count_in_s1", F.lit(0)).alias("cand_name_count_in_s1"))


@query("col_neighbour_number", f"WITH {CS}, n AS (SELECT s1, cand, {canonical(first_number(words('a')))} AS x, {canonical(first_number(words('b')))} AS y FROM cs) SELECT s1, cand, CAST(abs(CAST(x AS BIGINT) - CAST(y AS BIGINT)) BETWEEN 1 AND 4 AS DOUBLE) AS is_neighbor_number FROM n")
def col_neighbour_number(spark: SparkSession, sf: str) -> DataFrame:
    c, s = _valued_sides(spark, sf, w=lambda name: X.first_number(X.tokens(name)), d=lambda name: X.house_number(X.first_number(X.tokens(name)))[0], n=lambda name: X.house_number(X.first_number(X.tokens(name)))[1])
    return crossed.pairs(c, s, crossed.neighbours, {"is_neighbor_number": "double"})


@query("col_mismatch_idf", f"""WITH {NAMES}, t AS (SELECT DISTINCT code, unnest(nt) AS token FROM rec WHERE src = 1), n AS (SELECT count(*) AS n FROM rec WHERE src = 1), i AS (SELECT token, ln(any_value(n) + 1) - ln(count(*) + 1) AS idf FROM t, n GROUP BY token),
d AS (SELECT h.s1, h.cand, unnest(list_concat(list_filter(q.nt, lambda w: NOT list_contains(c.nt, w)), list_filter(c.nt, lambda w: NOT list_contains(q.nt, w)))) AS token FROM hits h JOIN rec q ON q.code = h.s1 JOIN rec c ON c.code = h.cand)
SELECT s1, cand, round(max(coalesce(idf, ln((SELECT n FROM n) + 1))), 6) AS mismatch_token_max_idf FROM d LEFT JOIN i USING (token) GROUP BY s1, cand""")
def col_mismatch_idf(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.names(spark, sf)
    own = rows.filter("src = 1")
    n = own.agg(F.log(F.count(F.lit(1)) + 1).alias("d"))
    idf = own.select(F.explode(F.array_distinct("nt")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("token", (F.col("d") - F.log(F.col("df") + 1)).alias("idf"))  # n is one row
    both = jn_name_topk(spark, sf).select("s1", "cand").join(rows.select(F.col("code").alias("s1"), F.col("nt").alias("q")), "s1").join(rows.select(F.col("code").alias("cand"), F.col("nt").alias("c")), "cand")
    diff = both.select("s1", "cand", F.explode(F.concat(F.array_except("q", "c"), F.array_except("c", "q"))).alias("token")).join(idf, "token", "left").crossJoin(F.broadcast(n))
    return diff.groupBy("s1", "cand").agg(F.round(F.max(F.coalesce("idf", "d")), 6).alias("mismatch_token_max_idf"))


@query("l2_raw_equality", f"WITH {NAMES} SELECT h.s1, h.cand, CAST(q.text = c.text AS BIGINT) AS raw_eq, CAST(trim(regexp_replace(lower(q.text), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(c.text), '\\s+', ' ', 'g')) AS BIGINT) AS rawl_eq FROM hits h JOIN rec q ON q.code = h.s1 JOIN rec c ON c.code = h.cand")
def l2_raw_equality(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.texts(spark, sf).select("code", F.sha2(X.lowered(F.col("text")), 256).alias("low"), F.sha2("text", 256).alias("raw"))
    q, c = (rows.select(F.col("code").alias(k), F.col("low").alias(f"{k}_low"), F.col("raw").alias(f"{k}_raw")) for k in ("s1", "cand"))
    return jn_name_topk(spark, sf).select("s1", "cand").join(q, "s1").join(c, "cand").select("s1", "cand", (F.col("s1_raw") == F.col("cand_raw")).cast("int").alias("raw_eq"), (F.col("s1_low") == F.col("cand_low")).cast("int").alias("rawl_eq"))


@query("l2_pool_counts", f"WITH {REC}, a AS (SELECT country, name, count(*) AS n FROM rec WHERE src = 1 GROUP BY ALL), e AS (SELECT country, name, count(*) AS n FROM rec WHERE src > 1 AND addr = '' GROUP BY ALL) SELECT code, coalesce(a.n, 0) AS cand_nn_s1_n, coalesce(e.n, 0) AS pool_empty_nn_n, round(coalesce(e.n, 0) / CAST(greatest(coalesce(a.n, 0), 1) AS DOUBLE), 6) AS pool_empty_per_s1 FROM rec LEFT JOIN a USING (country, name) LEFT JOIN e USING (country, name) WHERE src > 1")
def l2_pool_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.records(spark, sf)
    n = rows.groupBy("country", "name").agg(F.sum((F.col("src") == 1).cast("int")).alias("a"), F.sum(((F.col("src") > 1) & (F.col("addr") == "")).cast("int")).alias("e"))
    return rows.filter("src > 1").join(n, ["country", "name"]).select("code", F.col("a").alias("cand_nn_s1_n"), F.col("e").alias("pool_empty_nn_n"), F.round(F.col("e") / F.greatest("a", F.lit(1)), 6).alias("pool_empty_per_s1"))


@query("l2_superset_support", """WITH t AS (SELECT p_partkey AS s1, list_distinct(string_split(p_name || ' ' || lower(p_type), ' ')) AS w, p_size FROM part), c AS (SELECT DISTINCT string_split(p_name, ' ')[2] || ' ' || lower(p_type) AS cand FROM part), j AS (SELECT s1, cand, p_size FROM t JOIN c ON list_has_all(w, string_split(cand, ' ')))
SELECT cand, count(*) AS sup_n, CAST(max(p_size) AS BIGINT) AS sup_best, CAST(sum(p_size) AS BIGINT) AS sup_sum FROM j GROUP BY cand""")
def l2_superset_support(spark: SparkSession, sf: str) -> DataFrame:
    part = R.table(spark, sf, "part")
    t = part.select(F.col("p_partkey").alias("s1"), F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ").alias("words"))
    c = part.select(F.concat(F.get(F.split("p_name", " "), 1), F.lit(" "), F.lower("p_type")).alias("cand")).distinct().select("cand", F.split("cand", " ").alias("words"))
    got = retrieval.superset(t, c).join(part.select(F.col("p_partkey").alias("s1"), "p_size"), "s1")
    return got.groupBy("cand").agg(F.count(F.lit(1)).alias("sup_n"), F.max("p_size").cast("int").alias("sup_best"), F.sum("p_size").alias("sup_sum"))


@query("l2_empty_sums", f"WITH {PAIRS}, e AS (SELECT *, CAST(cand % 4 = 0 AS INT) AS empty FROM pr) SELECT s1, cand, round(sum(prob * empty) OVER w - prob * empty, 9) + 0 AS ent_empty_psum, round(sum(prob * (1 - empty)) OVER w - prob * (1 - empty), 9) + 0 AS ent_nonempty_psum FROM e WINDOW w AS (PARTITION BY s1)")
def l2_empty_sums(spark: SparkSession, sf: str) -> DataFrame:
    return windows.empty_sums(R.scored(spark, sf).withColumn("empty", (F.col("cand") % 4 == 0).cast("int")))


@query("l2_residual", f"WITH {PAIRS}, c AS (SELECT *, least(greatest(prob, 1e-7), 1 - 1e-7) AS p FROM pr) SELECT s1, cand, round(1 / (1 + exp(-(ln(p / (1 - p)) + (label * 2 - 1) * 0.5))), 6) AS prob FROM c WHERE prob >= 1e-3")
def l2_residual(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.scored(spark, sf).filter("prob >= 1e-3")
    return rows.select("s1", "cand", F.round(learning.shifted(F.col("prob"), (F.col("label") * 2 - 1) * 0.5), 6).alias("prob"))


@query("win_rescue", f"""WITH {PAIRS}, n AS (SELECT s1, cand, prob AS ce, round(prob * (cand % 7) / 7.0, 6) AS cos FROM pr WHERE cand % 3 = 0), k AS (SELECT s1, max(prob) AS a, round(sum(prob), 9) AS b, count(*) FILTER (WHERE prob >= 0.5) AS c FROM pr WHERE cand % 3 <> 0 GROUP BY s1)
SELECT n.*, row_number() OVER (PARTITION BY s1 ORDER BY ce DESC, cand) - 1 AS ce_rank, row_number() OVER (PARTITION BY s1 ORDER BY cos DESC, cand) - 1 AS cos_rank, count(*) OVER (PARTITION BY s1) AS n_new, coalesce(a, 0) AS ent_pmax, coalesce(b, 0) AS ent_psum, coalesce(c, 0) AS ent_n50 FROM n LEFT JOIN k USING (s1)""")
def win_rescue(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.scored(spark, sf)
    new = rows.filter("cand % 3 = 0").select("s1", "cand", F.col("prob").alias("ce"), F.round(F.col("prob") * (F.col("cand") % 7) / 7.0, 6).alias("cos"))
    return windows.rescue(new, rows.filter("cand % 3 <> 0"))


@query("agg_fixed_gain", f"""WITH {PAIRS}, x AS (SELECT *, CASE WHEN prob >= 0.6 THEN 2 WHEN prob >= 0.3 THEN 1 ELSE 0 END AS slot FROM pr), b AS (SELECT unnest(range(-1, 3)) AS b), y AS (SELECT b, s1, label, CASE WHEN b = slot THEN label ELSE CAST(prob >= 0.4 AS INT) END AS said FROM x, b),
c AS (SELECT b, s1, sum(label) AS t, sum(said) AS p, sum(said * label) AS tp FROM y GROUP BY b, s1) SELECT b, round(avg(CASE WHEN p = 0 AND t = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (0.25 * t + p) END), 6) AS f05 FROM c GROUP BY b""")
def agg_fixed_gain(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.scored(spark, sf)
    truth = rows.select("s1", F.when(F.col("label") == 1, F.col("cand")).alias("m"))
    return decision.fixed_gain(truth, rows, 0.4, [0.3, 0.6])


@query("agg_anchor_stats", f"WITH {NAMES}, a AS (SELECT q.country, h.s1, count(*) FILTER (WHERE score >= 0.9) AS n, max(score) AS m FROM hits h JOIN rec q ON q.code = h.s1 GROUP BY ALL) SELECT country, count(*) AS n_entities, CAST(sum(CAST(n > 0 AS INT)) AS BIGINT) AS n_with_anchor, round(avg(n), 6) AS mean_anchors, round(avg(m), 6) AS mean_best FROM a GROUP BY country")
def agg_anchor_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.names(spark, sf).select(F.col("code").alias("s1"), "country")
    per = jn_name_topk(spark, sf).groupBy("s1").agg(F.sum((F.col("score") >= 0.9).cast("int")).alias("n"), F.max("score").alias("m")).join(rows, "s1")
    return per.groupBy("country").agg(F.count(F.lit(1)).alias("n_entities"), F.sum((F.col("n") > 0).cast("int")).alias("n_with_anchor"), F.round(F.avg("n"), 6).alias("mean_anchors"), F.round(F.avg("m"), 6).alias("mean_best"))


@query("agg_misses", f"WITH {NAMES}, {TRUTH} SELECT country, count(*) AS n_missed, count(*) FILTER (WHERE rec.addr = '') AS n_missed_empty FROM truth t JOIN rec ON rec.code = t.m WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.s1 = t.s1 AND h.cand = t.m) GROUP BY country")
def agg_misses(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.names(spark, sf)
    missed = R.owners(rows).withColumnRenamed("m", "cand").join(jn_name_topk(spark, sf), ["s1", "cand"], "left_anti")
    return missed.join(rows.select(F.col("code").alias("cand"), "country", "n_at"), "cand").groupBy("country").agg(F.count(F.lit(1)).alias("n_missed"), F.sum((F.col("n_at") == 0).cast("int")).alias("n_missed_empty"))


@query("ml_prune_sweep", f"WITH {PAIRS}, r AS (SELECT unnest([0.05, 0.1, 0.2, 0.4]) AS thr) SELECT CAST(thr AS DOUBLE) AS thr, round(avg(CAST(prob >= thr AS INT)), 6) AS kept, round(sum(CAST(prob >= thr AS INT) * label) / CAST(sum(label) AS DOUBLE), 6) AS recall FROM pr, r GROUP BY thr")
def ml_prune_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return learning.prune_sweep(R.scored(spark, sf), [0.05, 0.1, 0.2, 0.4])


HASH = "CAST(('0x' || substr(md5({} || '{}'), 1, 8)) AS BIGINT)"


@query("ml_band_sample", f"WITH {PAIRS} SELECT s1, cand, prob, label FROM pr WHERE prob BETWEEN 0.3 AND 0.5 OR {HASH.format('CAST(cand AS VARCHAR)', 'band')} % 1000 < 100")
def ml_band_sample(spark: SparkSession, sf: str) -> DataFrame:
    return learning.banded(R.scored(spark, sf), 0.3, 0.5, 0.1).select("s1", "cand", "prob", "label")


@query("ml_uniform_sample", "SELECT c_custkey AS s1 FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR) || 'u'), c_custkey LIMIT 200")
def ml_uniform_sample(spark: SparkSession, sf: str) -> DataFrame:
    return learning.uniform(R.table(spark, sf, "customer").select(F.col("c_custkey").alias("s1")), 200)


@query("ml_shift_weights", f"WITH {PAIRS}, w AS (SELECT *, CASE WHEN label = 1 THEN 1.0 WHEN prob >= 0.5 THEN 2.5 ELSE 0.5 END AS w FROM pr) SELECT src, round(sum(CAST(w * CAST(prob >= 0.4 AND label = 1 AS INT) AS DOUBLE)), 6) AS tp, round(sum(CAST(w * CAST(prob >= 0.4 AND label = 0 AS INT) AS DOUBLE)), 6) AS fp FROM w GROUP BY src")
def ml_shift_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.scored(spark, sf).withColumn("w", F.when(F.col("label") == 1, 1.0).when(F.col("prob") >= 0.5, 2.5).otherwise(0.5))
    on = (F.col("prob") >= 0.4).cast("int")
    return rows.groupBy("src").agg(F.round(F.sum(F.col("w") * on * F.col("label")), 6).alias("tp"), F.round(F.sum(F.col("w") * on * (1 - F.col("label"))), 6).alias("fp"))


@query("ml_self_train")
def ml_self_train(spark: SparkSession, sf: str) -> DataFrame:
    rows = windows.competition(R.scored(spark, sf).select("s1", "cand", "src", "prob", "label"))
    return learning.self_trained(rows, ["prob", "comp_best_other", "comp_n"], F.col("src") == 3, 1, 0.4, 0.2).select("s1", "cand", "p")


@query("evl_truth", f"WITH {REC}, {TRUTH}, g AS (SELECT s1, array_to_string(list(m ORDER BY m), ',') AS ms FROM truth GROUP BY s1) SELECT code AS s1, coalesce(ms, '') AS ms FROM rec LEFT JOIN g ON g.s1 = code WHERE src = 1")
def evl_truth(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.records(spark, sf)
    sets = R.owners(rows).groupBy("s1").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m.cast("string")), ",").alias("ms"))
    return rows.filter("src = 1").select(F.col("code").alias("s1")).join(sets, "s1", "left").fillna("", ["ms"])


@query("evl_subset", f"WITH {COUNTS} SELECT {MACRO} FROM ev WHERE s1 IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def evl_subset(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.scored(spark, sf)
    some = R.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("s1"))
    truth = rows.select("s1", F.when(F.col("label") == 1, F.col("cand")).alias("m"))
    return decision.macro(decision.scores(decision.counted(truth, rows.filter("prob >= 0.4"))).join(some, "s1", "left_semi"), [])


@query("dec_owner_gain", f"""WITH {PAIRS}, o AS (SELECT s1, cand FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY prob DESC, s1) AS r FROM pr) WHERE r = 1 AND prob >= 0.4), c AS (SELECT pr.s1, sum(label) AS t, count(o.cand) AS p, count(o.cand) FILTER (WHERE label = 1) AS tp FROM pr LEFT JOIN o ON o.s1 = pr.s1 AND o.cand = pr.cand GROUP BY pr.s1)
SELECT count(*) AS n, round(avg(CASE WHEN p = 0 AND t = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 1.25 * tp / (0.25 * t + p) END), 6) AS f05 FROM c""")
def dec_owner_gain(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.scored(spark, sf)
    truth = rows.select("s1", F.when(F.col("label") == 1, F.col("cand")).alias("m"))
    return decision.macro(decision.scores(decision.counted(truth, decision.exclusive(rows).filter("prob >= 0.4"))), []).select("n", "f05")


@query("dec_calibrated")
def dec_calibrated(spark: SparkSession, sf: str) -> DataFrame:
    return decision.expected_f(R.scored(spark, sf).select("s1", "cand", "prob"), 0.25, 40, 1.2).select("s1", "k", "value")


@query("sim_raw_ratio")
def sim_raw_ratio(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.names(spark, sf)
    q, c = (rows.select(F.col("code").alias(k), F.col("name").alias(f"{k}_n")) for k in ("s1", "cand"))
    pairs = jn_name_topk(spark, sf).select("s1", "cand").join(q, "s1").join(c, "cand")
    got = similarity.scored(pairs, "s1_n", "cand_n", ["ratio"])
    best = F.max("ratio").over(W.Window.partitionBy("cand"))
    return got.select("s1", "cand", "ratio", F.round(best - F.col("ratio"), 6).alias("margin"))


@query("agg_addr_key_counts", f"""WITH {REC}, own AS (SELECT code, list_filter(aw, lambda w: w NOT IN {NULLS}) AS aw FROM rec WHERE src = 1), k AS (SELECT code, coalesce({canonical(first_number('aw'))}, '') AS num, {first_number('aw')} IS NULL AS none,
  list_sort(list_transform(list_sort(list_transform(list_filter(list_distinct(aw), lambda w: regexp_full_match(w, '[a-z]+') AND len(w) >= 3), lambda w: {{'n': -len(w), 't': w}}))[1:2], lambda s: s.t)) AS two FROM own)
SELECT CASE WHEN none THEN '' ELSE num END || '|' || array_to_string(two, ' ') AS addr_key, count(*) AS n FROM k WHERE NOT (none AND len(two) = 0) GROUP BY addr_key""")
def agg_addr_key_counts(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.addresses(R.records(spark, sf).filter("src = 1"))
