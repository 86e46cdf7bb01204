"""Sources, text rules, terms, keys and similarities."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import text as X
from kinfold.operators import collective, crossed, retrieval, similarity, statistics
from kinfold.sources import records as R

from .registry import CS, NULLS, REC, TERMS, canonical, first_number, meaningful, normal, query, sounds, words

@query("src_semi_lookup", f"WITH {REC} SELECT code, name, addr FROM rec WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def src_semi_lookup(spark: SparkSession, sf: str) -> DataFrame:
    ids = R.table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return R.records(spark, sf).join(ids, "doc_id", "left_semi").select("code", "name", "addr")


@query("src_id_codec", f"WITH {REC} SELECT code, 'S' || src || '-' || lpad(CAST(code % 10000000000 AS VARCHAR), CAST(greatest(5, len(CAST(code % 10000000000 AS VARCHAR))) AS INTEGER), '0') AS id, src AS source, code % 10000000000 AS number FROM rec")
def src_id_codec(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.records(spark, sf).select("code")
    return rows.select("code", R.encode(F.col("code")).alias("id")).select("code", "id", R.source_of(R.decode(F.col("id"))).alias("source"), (R.decode(F.col("id")) % R.OFFSET).alias("number"))


@query("src_gt_explode", "SELECT o_custkey AS s1, o_orderkey AS m FROM orders UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def src_gt_explode(spark: SparkSession, sf: str) -> DataFrame:
    lists = R.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("s1")).agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ",").alias("ids"))
    rows = R.table(spark, sf, "customer").select(F.col("c_custkey").alias("s1")).join(lists, "s1", "full")
    each = rows.select("s1", F.explode_outer(F.when(F.coalesce("ids", F.lit("")) != "", F.split("ids", ","))).alias("m"))
    return each.select("s1", F.coalesce(F.col("m").cast("long"), F.lit(-1)).alias("m"))


@query("txt_normalize", f"WITH {REC} SELECT code, name, addr, CAST(regexp_matches(text, '[^\\x00-\\x7F]') AS BIGINT) AS nonascii FROM rec")
def txt_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return R.normalised(spark, sf).select("code", "name", "addr", F.col("text").rlike(r"[^\x00-\x7F]").cast("int").alias("nonascii"))


@query("txt_tokens", f"""WITH {REC}, m AS (SELECT code, {meaningful('list_concat(nt, aw)')} AS ws FROM rec)
SELECT code, CAST(len(ws) AS BIGINT) AS n, array_to_string(list_filter(ws, lambda w: regexp_full_match(w, '[0-9]+')), ' ') AS digits, array_to_string(list_filter(ws, lambda w: NOT regexp_full_match(w, '[0-9]+')), ' ') AS alpha FROM m""")
def txt_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.records(spark, sf).select("code", X.meaningful(F.concat("nt", "at")).alias("ws"))
    return rows.select("code", F.size("ws").alias("n"), F.array_join(X.numeric(F.col("ws")), " ").alias("digits"), F.array_join(X.alphabetic(F.col("ws")), " ").alias("alpha"))


@query("txt_skeleton", f"WITH {REC} SELECT code, array_to_string({sounds('list_concat(nt, aw)')}, ' ') AS skeletons FROM rec")
def txt_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    return R.records(spark, sf).select("code", F.array_join(X.skeletons(F.concat("nt", "at")), " ").alias("skeletons"))


@query("txt_canon_num", f"""WITH t AS (SELECT c_custkey, {words(normal('c_name'))} AS ws FROM customer)
SELECT c_custkey, {first_number('ws')} AS raw, {canonical(first_number('ws'))} AS canon FROM t""")
def txt_canon_num(spark: SparkSession, sf: str) -> DataFrame:
    ws = X.tokens(X.normalize(F.col("c_name")))
    return R.table(spark, sf, "customer").select("c_custkey", F.get(X.numeric(ws), 0).alias("raw"), X.first_number(ws).alias("canon"))


@query("txt_addr_key", f"""WITH {REC}, own AS (SELECT code, list_filter(aw, lambda w: w NOT IN {NULLS}) AS aw FROM rec), k AS (SELECT code, coalesce({canonical(first_number('aw'))}, '') AS num, {first_number('aw')} IS NULL AS none,
  list_sort(list_transform(list_sort(list_transform(list_filter(list_distinct(aw), lambda w: regexp_full_match(w, '[a-z]+') AND len(w) >= 3), lambda w: {{'n': -len(w), 't': w}}))[1:2], lambda s: s.t)) AS two FROM own)
SELECT code, CASE WHEN none AND len(two) = 0 THEN '' ELSE CASE WHEN none THEN '' ELSE num END || '|' || array_to_string(two, ' ') END AS addr_key FROM k""")
def txt_addr_key(spark: SparkSession, sf: str) -> DataFrame:
    return R.records(spark, sf).select("code", X.address_key(F.col("at")).alias("addr_key"))


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers (s1, k, a) and suppliers (cand, k, b): codes, nations and normalised names."""
    c = R.table(spark, sf, "customer").select(F.col("c_custkey").alias("s1"), F.col("c_nationkey").alias("k"), X.normalize(F.col("c_name")).alias("a"))
    s = R.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cand"), F.col("s_nationkey").alias("k"), X.normalize(F.col("s_name")).alias("b"))
    return c, s


#: A nation's customers are dealt to so many parts, each of which meets all its suppliers.
PARTS = 16


def _paired(c: DataFrame, s: DataFrame) -> DataFrame:
    """All pairs of a nation. What a pair needs of one side alone is computed before."""
    by = ["k", "part"]
    spread = int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = c.withColumn("part", F.pmod(F.xxhash64("s1"), F.lit(PARTS)).cast("int")).repartition(spread, *by)
    return c.join(s.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), by).drop(*by)


def _cs(spark: SparkSession, sf: str, **of: Callable[[Column], Column]) -> DataFrame:
    """Pairs of a nation: s1, cand and, for each name in of, its value a_name of the customer's name and b_name of the supplier's."""
    return _paired(*(_valued_sides(spark, sf, **of) if of else _sides(spark, sf)))


def _valued_sides(spark: SparkSession, sf: str, **of: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """_sides() with the values that _cs() gives instead of the names."""
    c, s = _sides(spark, sf)
    return c.select("s1", "k", *[f(F.col("a")).alias(f"a_{n}") for n, f in of.items()]), s.select("cand", "k", *[f(F.col("b")).alias(f"b_{n}") for n, f in of.items()])


NUM_SIM = "CASE WHEN x = y THEN 1.0 WHEN abs(len(x) - len(y)) = 1 AND (starts_with(CASE WHEN len(x) < len(y) THEN y ELSE x END, CASE WHEN len(x) < len(y) THEN x ELSE y END) OR ends_with(CASE WHEN len(x) < len(y) THEN y ELSE x END, CASE WHEN len(x) < len(y) THEN x ELSE y END)) THEN 0.8 WHEN abs(len(x) - len(y)) <= 1 AND levenshtein(x, y) <= 1 THEN 0.6 ELSE 0.0 END"


@query("txt_num_sim", f"WITH {CS}, n AS (SELECT s1, cand, {canonical(first_number(words('a')))} AS x, {canonical(first_number(words('b')))} AS y FROM cs) SELECT s1, cand, CAST({NUM_SIM} AS DOUBLE) AS num_sim FROM n")
def txt_num_sim(spark: SparkSession, sf: str) -> DataFrame:
    rows = _cs(spark, sf, n=lambda name: X.first_number(X.tokens(name)))
    return rows.select("s1", "cand", X.number_similarity(F.col("a_n"), F.col("b_n")).alias("num_sim"))


@query("txt_ocr", "SELECT p_partkey, translate(translate(lower(p_type || p_brand), '0158634729', 'olsbgeatzg'), 'i', 'l') AS ocr, trim(regexp_replace(lower(coalesce(p_name, '')), '\\s+', ' ', 'g')) AS low FROM part")
def txt_ocr(spark: SparkSession, sf: str) -> DataFrame:
    return R.table(spark, sf, "part").select("p_partkey", X.lookalike(F.lower(F.concat("p_type", "p_brand"))).alias("ocr"), X.lowered(F.col("p_name")).alias("low"))


@query("txt_char3", f"""WITH {REC} SELECT code, array_to_string(list_sort(list_distinct(flatten(list_transform(nt, lambda t: list_transform(range(1, len(t) + 1), lambda i: ('#' || t || '#')[i:i + 2]))))), ' ') AS grams FROM rec""")
def txt_char3(spark: SparkSession, sf: str) -> DataFrame:
    return R.records(spark, sf).select("code", F.array_join(F.array_sort(X.trigrams(F.col("nt"))), " ").alias("grams"))


@query("txt_core_name", f"""WITH {REC}, n AS (SELECT count(*) AS n FROM rec WHERE src = 1), f AS (SELECT w FROM (SELECT DISTINCT code, unnest(nt) AS w FROM rec WHERE src = 1) GROUP BY w HAVING count(*) > 0.02 * (SELECT n FROM n)),
l AS (SELECT coalesce(list(w), []) AS common FROM f), c AS (SELECT code, name, array_to_string(list_filter(nt, lambda w: NOT list_contains(common, w)), ' ') AS core FROM rec, l)
SELECT code, CASE WHEN core = '' THEN name ELSE core END AS core FROM c""")
def txt_core_name(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.records(spark, sf)
    return statistics.core_names(rows.select("code", "nt", "name"), rows.filter("src = 1").select("nt"), 0.02).select("code", "core")


@query("txt_script")
def txt_script(spark: SparkSession, sf: str) -> DataFrame:
    return R.table(spark, sf, "documents").groupBy("lang", X.script(F.col("text")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query("txt_side", f"WITH {REC} SELECT code, CASE WHEN name = '' THEN addr WHEN addr = '' THEN name ELSE name || ' | ' || addr END AS side FROM rec")
def txt_side(spark: SparkSession, sf: str) -> DataFrame:
    return R.records(spark, sf).select("code", X.side(F.col("name"), F.col("addr")).alias("side"))


@query("trm_terms_df", f"WITH {TERMS}, x AS (SELECT DISTINCT code, country, src, unnest(terms) AS term FROM tm), n AS (SELECT country, src, count(*) AS n FROM tm GROUP BY ALL) SELECT country, src, term, count(*) AS df, round(ln((any_value(n) + 1.0) / (count(*) + 1)) + 1, 9) AS idf FROM x JOIN n USING (country, src) GROUP BY country, src, term")
def trm_terms_df(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.records(spark, sf).select("code", "country", "src", X.terms(F.col("nt"), F.col("at")).alias("terms"))
    return retrieval.frequencies(rows, None).select("country", "src", "term", "df", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 9).alias("idf"))


KEYS = f"""{REC}, k0 AS (SELECT code, country, src, {sounds('nt')} AS ks, (list_distinct(list_transform(list_filter(aw, lambda w: regexp_full_match(w, '[0-9]+')), lambda w: {canonical('w')}))) AS ds0, list_transform(list_filter(aw, lambda w: regexp_full_match(w, '[0-9]+')), lambda w: {canonical('w')}) AS dl FROM rec),
k1 AS (SELECT code, country, src, ks, (list_filter(dl, lambda d, i: list_position(dl, d) = i))[1:2] AS ds FROM k0),
keyed AS (SELECT code, country, src, list_distinct(list_concat(flatten(list_transform(ks, lambda k: list_transform(ds, lambda d: 'T|' || k || '|' || d))), list_transform(range(1, len(ks)), lambda i: 'N|' || ks[i] || '|' || ks[i + 1]))) AS keys FROM k1)"""


@query("key_record_keys", f"WITH {KEYS} SELECT code, array_to_string(list_sort(keys), ' ') AS keys FROM keyed")
def key_record_keys(spark: SparkSession, sf: str) -> DataFrame:
    return R.records(spark, sf).select("code", F.array_join(F.array_sort(X.record_keys(F.col("nt"), F.col("at"))), " ").alias("keys"))


@query("key_join_capped", f"""WITH {KEYS}, e AS (SELECT code, country, src, unnest(keys) AS key FROM keyed),
a AS (SELECT country, key, count(*) AS na FROM e WHERE src = 1 GROUP BY ALL HAVING count(*) <= 10), b AS (SELECT country, src, key, count(*) AS nb FROM e WHERE src > 1 GROUP BY ALL HAVING count(*) <= 60)
SELECT x.code AS s1, y.code AS cand, y.src AS src, count(*) AS key_hits, min(na * nb) AS key_minfreq FROM e x JOIN a USING (country, key) JOIN b USING (country, key) JOIN e y ON y.country = x.country AND y.key = x.key AND y.src = b.src WHERE x.src = 1 GROUP BY ALL""")
def key_join_capped(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.records(spark, sf).select("code", "country", "src", X.record_keys(F.col("nt"), F.col("at")).alias("keys"))
    return retrieval.key_join(rows.filter("src = 1"), rows.filter("src > 1"))


@query("sim_levenshtein", f"WITH {CS} SELECT s1, cand, round(1 - levenshtein(replace(a, ' ', ''), replace(b, ' ', '')) / CAST(greatest(len(replace(a, ' ', '')), len(replace(b, ' ', ''))) AS DOUBLE), 6) AS nospace_lev FROM cs")
def sim_levenshtein(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (F.replace(F.col(c), F.lit(" "), F.lit("")) for c in "ab")
    return _cs(spark, sf).select("s1", "cand", F.round(similarity.levenshtein_similarity(a, b), 6).alias("nospace_lev"))


@query("sim_jaro_winkler", f"WITH {CS} SELECT s1, cand, round(jaro_winkler_similarity(a, b), 6) AS name_jw FROM cs")
def sim_jaro_winkler(spark: SparkSession, sf: str) -> DataFrame:
    return crossed.pairs(*_sides(spark, sf), crossed.alike({"name_jw": "jw"}), {"name_jw": "double"})


@query("sim_ratio")
def sim_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return crossed.pairs(*_sides(spark, sf), crossed.alike({n: n for n in ("ratio", "tsort")}), {n: "double" for n in ("ratio", "tsort")})


@query("sim_token_set")
def sim_token_set(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.scored(_cs(spark, sf), "a", "b", ["tset", "ptset"]).select("s1", "cand", "tset", "ptset")


@query("sim_partial")
def sim_partial(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.scored(_cs(spark, sf), "a", "b", ["partial"]).select("s1", "cand", "partial")


@query("sim_idf_overlap", f"""WITH {CS}, t AS (SELECT unnest(list_distinct({words(normal('c_name'))})) AS token FROM customer), n AS (SELECT count(*) AS n FROM customer),
i AS (SELECT token, ln(any_value(n) + 1) - ln(count(*) + 1) AS idf FROM t, n GROUP BY token),
x AS (SELECT DISTINCT s1, cand, unnest({words('a')}) AS token FROM cs), y AS (SELECT DISTINCT s1, cand, unnest({words('b')}) AS token FROM cs),
e AS (SELECT s1, cand, token, x.token IS NOT NULL AS inx, y.token IS NOT NULL AS iny FROM x FULL JOIN y USING (s1, cand, token)),
w AS (SELECT e.*, coalesce(idf, ln((SELECT n FROM n) + 1)) AS w FROM e LEFT JOIN i USING (token)),
s AS (SELECT s1, cand, coalesce(sum(w) FILTER (WHERE inx AND iny), 0) AS m, coalesce(sum(w) FILTER (WHERE inx), 0) AS q, coalesce(sum(w) FILTER (WHERE iny), 0) AS c, sum(w) AS u FROM w GROUP BY s1, cand)
SELECT s1, cand, round(CASE WHEN q = 0 OR c = 0 THEN 0 ELSE m / q END, 6) AS idf_q, round(CASE WHEN q = 0 OR c = 0 THEN 0 ELSE m / c END, 6) AS idf_c, round(CASE WHEN q = 0 OR c = 0 THEN 0 ELSE m / u END, 6) AS idf_u FROM s""")
def sim_idf_overlap(spark: SparkSession, sf: str) -> DataFrame:
    own = R.table(spark, sf, "customer").select(X.tokens(X.normalize(F.col("c_name"))).alias("w"))
    n = own.count()
    weights = own.select(F.explode(F.array_distinct("w")).alias("token")).groupBy("token").agg((F.log(F.lit(n + 1.0)) - F.log(F.count(F.lit(1)) + 1)).alias("idf"))
    c, s = _sides(spark, sf)
    c = similarity.weighed(c.select("s1", "k", X.tokens(F.col("a")).alias("w")), ["s1", "k"], "w", weights, math.log(n + 1)).withColumnsRenamed({"words": "aw", "total": "at"})
    s = similarity.weighed(s.select("cand", "k", X.tokens(F.col("b")).alias("w")), ["cand", "k"], "w", weights, math.log(n + 1)).withColumnsRenamed({"words": "bw", "total": "bt"})
    return crossed.pairs(c, s, crossed.overlaps, {n: "double" for n in ("idf_q", "idf_c", "idf_u")})


@query("sim_digits", f"""WITH {CS}, d AS (SELECT s1, cand, list_distinct(list_filter({words('a')}, lambda w: regexp_full_match(w, '[0-9]+'))) AS x, list_distinct(list_filter({words('b')}, lambda w: regexp_full_match(w, '[0-9]+'))) AS y FROM cs)
SELECT s1, cand, CAST(len(x) AS BIGINT) AS dig_n_q, CAST(len(y) AS BIGINT) AS dig_n_c, CAST(len(list_intersect(x, y)) > 0 AS BIGINT) AS dig_any, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE) END, 6) AS dig_jaccard,
  CAST({canonical('x[1]')} = {canonical('y[1]')} AS BIGINT) AS digz_first_eq FROM d""")
def sim_digits(spark: SparkSession, sf: str) -> DataFrame:
    rows = _cs(spark, sf, d=lambda name: F.array_distinct(X.numeric(X.tokens(name))), z=lambda name: X.first_number(X.tokens(name)))
    both = rows.select("s1", "cand", F.size("a_d").alias("x"), F.size("b_d").alias("y"), similarity.common("a_d", "b_d").alias("both"), (F.col("a_z") == F.col("b_z")).cast("int").alias("digz_first_eq"))
    jaccard = F.when(F.col("both") == 0, 0.0).otherwise(F.round(F.col("both") / (F.col("x") + F.col("y") - F.col("both")), 6))
    return both.select("s1", "cand", F.col("x").alias("dig_n_q"), F.col("y").alias("dig_n_c"), (F.col("both") > 0).cast("int").alias("dig_any"), jaccard.alias("dig_jaccard"), "digz_first_eq")


@query("col_number_distance", f"""WITH {CS}, n AS (SELECT s1, cand, {canonical(first_number(words('a')))} AS a, {canonical(first_number(words('b')))} AS b FROM cs), o AS (SELECT *, a <> b AND len(a) < 12 AND len(b) < 12 AS ok FROM n)
SELECT s1, cand, CAST(CASE WHEN ok THEN abs(CAST(a AS BIGINT) - CAST(b AS BIGINT)) END AS DOUBLE) AS nd_absdiff, round(CASE WHEN ok THEN ln(1 + abs(CAST(a AS BIGINT) - CAST(b AS BIGINT))) END, 6) AS nd_logdiff, CASE WHEN ok THEN CAST(CAST(CAST(a AS BIGINT) % 2 = CAST(b AS BIGINT) % 2 AS BIGINT) AS DOUBLE) END AS nd_same_parity,
  CAST(CASE WHEN ok AND len(a) = len(b) THEN (list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i]))[1] - 1 END AS DOUBLE) AS nd_first_diff_pos FROM o""")
def col_number_distance(spark: SparkSession, sf: str) -> DataFrame:
    c, s = _sides(spark, sf)
    c, s = (rows.select(code, "k", *collective.number_parts(X.first_number(X.tokens(F.col(n))), n)) for rows, code, n in ((c, "s1", "a"), (s, "cand", "b")))
    return crossed.pairs(c, s, crossed.distances, {n: "double" for n in ("nd_absdiff", "nd_logdiff", "nd_same_parity", "nd_first_diff_pos")})


PP = "pp AS (SELECT p.p_partkey AS s1, q.p_partkey AS cand, string_split(p.p_name, ' ') AS qw, string_split(q.p_name, ' ') AS cw FROM part p JOIN part q ON p.p_brand = q.p_brand AND p.p_size = q.p_size AND p.p_type = q.p_type AND p.p_partkey <> q.p_partkey)"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    p = R.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_type", F.split("p_name", " ").alias("w"))
    a, b = p.withColumnsRenamed({"p_partkey": "s1", "w": "qw"}), p.withColumnsRenamed({"p_partkey": "cand", "w": "cw"})
    return a.join(b, ["p_brand", "p_size", "p_type"]).filter("s1 <> cand").select("s1", "cand", "qw", "cw")


OCR = "translate(translate({}, '0158634729', 'olsbgeatzg'), 'i', 'l')"


@query("l2_edit_class", f"""WITH {PP}, q AS (SELECT DISTINCT s1, cand, cw, unnest(qw) AS q FROM pp), c AS (SELECT DISTINCT s1, cand, q, unnest(cw) AS c FROM q WHERE len(q) >= 2 AND NOT list_contains(cw, q)),
s AS (SELECT *, round(1 - levenshtein(q, c) / CAST(greatest(len(q), len(c)) AS DOUBLE), 9) AS sim FROM c), b AS (SELECT s1, cand, q, arg_min(c, (-sim, c)) AS c FROM s WHERE sim >= 0.5 GROUP BY s1, cand, q),
k AS (SELECT *, CASE WHEN {OCR.format('q')} = {OCR.format('c')} THEN 0 WHEN list_sort(string_split(q, '')) = list_sort(string_split(c, '')) THEN 1 WHEN starts_with(c, q) AND len(c) - len(q) BETWEEN 1 AND 3 THEN 2 WHEN starts_with(q, c) AND len(q) - len(c) BETWEEN 1 AND 3 THEN 3
  WHEN len(q) = len(c) AND len(list_filter(range(1, len(q) + 1), lambda i: ({OCR.format('q')})[i] <> ({OCR.format('c')})[i])) = 1 THEN 4 ELSE 5 END AS k FROM b),
g AS (SELECT s1, cand, {', '.join(f'CAST(sum(CAST(k = {i} AS INT)) AS BIGINT) AS ed_{i}' for i in range(6))}, coalesce(min(len(q)) FILTER (WHERE k >= 2), 0) AS ed_minlen, CAST(sum(CAST(k IN (2, 4) AND len(q) <= 4 AS INT)) AS BIGINT) AS ed_short FROM k GROUP BY s1, cand)
SELECT s1, cand, {', '.join(f'coalesce({c}, 0) AS {c}' for c in [*(f'ed_{i}' for i in range(6)), 'ed_minlen', 'ed_short'])} FROM pp LEFT JOIN g USING (s1, cand)""")
def l2_edit_class(spark: SparkSession, sf: str) -> DataFrame:
    return collective.edits(_parts(spark, sf))


@query("col_numbers")
def col_numbers(spark: SparkSession, sf: str) -> DataFrame:
    columns = {n: "int" for n in ("anum_n_q", "anum_n_c", "anum_first_rel", "anum_q_miss", "anum_c_extra", "anum_c_alpha_extra")}
    return crossed.pairs(*_valued_sides(spark, sf, n=lambda name: X.number_facts(X.tokens(name))), crossed.numbers, columns)


@query("col_name_residual")
def col_name_residual(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _parts(spark, sf).select("s1", "cand", F.array_join("qw", " ").alias("qn"), F.array_join("cw", " ").alias("cn"))
    own = R.table(spark, sf, "part").select(F.split("p_name", " ").alias("w"), "p_size")
    return collective.name_residual(pairs, statistics.noise(own.filter("p_size > 25"), own.filter("p_size <= 25"), "w"), statistics.token_idf(own, "w").select("token", "idf"), 8.0)



