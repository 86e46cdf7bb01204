"""Registration of queries, and SQL that several of their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.shipping import ship

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

NULLS = "('null','na','nan','none','nil','unknown','n a')"


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, others as double: the types that the SQL gives."""
    kinds = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}
    return df.select(*[F.col(f"`{c}`").cast("double" if t.startswith("decimal") else kinds.get(t, t)).alias(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return widened(f(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def normal(x: str) -> str:
    out = f"strip_accents(lower(coalesce({x}, '')))"
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("đ", "d"), ("ł", "l")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[^0-9a-z]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def skeleton(t: str) -> str:
    out = f"translate(replace({t}, 'ph', 'f'), 'bcdgjqvwxzaeiouyh', 'pktkkkffks')"
    for c in "fklmnprst0123456789":
        out = f"regexp_replace({out}, '{c}+', '{c}', 'g')"
    return f"CASE WHEN regexp_full_match({t}, '[0-9]+') THEN {t} ELSE {out} END"


def canonical(t: str) -> str:
    return f"coalesce(nullif(ltrim({t}, '0'), ''), '0')"


def first_number(ws: str) -> str:
    return f"(list_filter({ws}, lambda w: regexp_full_match(w, '[0-9]+')))[1]"


def meaningful(ws: str) -> str:
    return f"list_filter({ws}, lambda w: len(w) > 1 AND w NOT IN {NULLS})"


def sounds(ws: str) -> str:
    own = f"list_filter({ws}, lambda w: NOT regexp_full_match(w, '[0-9]+') AND w NOT IN {NULLS})"
    return f"list_filter(list_transform({own}, lambda w: {skeleton('w')}), lambda k: len(k) > 1)"


#: rec: documents as records; aw are the address's words.
REC = f"""rec0 AS (SELECT doc_id, text, lang AS country, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 + 1 AS src, {words(normal('text'))} AS w FROM documents),
rec AS (SELECT doc_id, text, country, CAST(src AS BIGINT) AS src, CAST(src AS BIGINT) * 10000000000 + doc_id AS code, w[1:8] AS nt, w[9:] AS aw, array_to_string(w[1:8], ' ') AS name, array_to_string(w[9:], ' ') AS addr FROM rec0)"""

#: pr: lineitem as scored pairs.
PAIRS = """pr AS (SELECT l_orderkey AS s1, l_partkey AS cand, max(round(l_discount * 8 + l_tax * 2, 6)) AS prob, CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS label, CAST(l_partkey % 2 + 2 AS BIGINT) AS src FROM lineitem GROUP BY l_orderkey, l_partkey)"""

#: tm: records with their terms.
TERMS = f"""{REC}, tm0 AS (SELECT code, country, src, {meaningful('nt')} AS n, {meaningful('aw')} AS a FROM rec),
tm1 AS (SELECT *, {sounds('n')} AS ks, {sounds('a')} AS aks FROM tm0),
tm AS (SELECT code, country, src, list_distinct(list_concat(
  list_transform(n, lambda w: 'n:' || w), list_transform(range(1, len(n)), lambda i: 'nb:' || n[i] || '_' || n[i + 1]),
  CASE WHEN len(array_to_string(n, '')) >= 4 THEN ['nc:' || array_to_string(n, '')[1:10]] ELSE [] END,
  list_transform(list_filter(a, lambda w: NOT regexp_full_match(w, '[0-9]+')), lambda w: 'a:' || w), list_transform(list_filter(a, lambda w: regexp_full_match(w, '[0-9]+')), lambda w: 'd:' || w),
  list_transform(range(1, len(a)), lambda i: 'ab:' || a[i] || '_' || a[i + 1]),
  list_transform(ks, lambda w: 'k:' || w), list_transform(range(1, len(ks)), lambda i: 'kb:' || ks[i] || '_' || ks[i + 1]),
  CASE WHEN array_to_string(ks, '') <> '' THEN ['kc:' || array_to_string(ks, '')[1:8]] ELSE [] END,
  list_transform(aks, lambda w: 'ak:' || w))) AS terms FROM tm1)"""


def topk(terms: str, asked: str, pool: str, k: int, cap: int) -> str:
    """CTEs from a table of terms (code, country, src, terms) to hits: s1, cand, src, score, rank."""
    return f"""qx AS (SELECT DISTINCT code AS s1, country, unnest(terms) AS term FROM {terms} WHERE {asked}),
px AS (SELECT DISTINCT code AS cand, country, src, unnest(terms) AS term FROM {terms} WHERE {pool}),
nn AS (SELECT country, src, count(*) AS n FROM {terms} WHERE {pool} GROUP BY ALL),
wt AS (SELECT country, src, term, ln((any_value(n) + 1.0) / (count(*) + 1)) + 1 AS w FROM px JOIN nn USING (country, src) GROUP BY country, src, term HAVING count(*) <= {cap}),
pw AS (SELECT cand, country, src, term, w FROM px JOIN wt USING (country, src, term)),
qw AS (SELECT s1, country, src, term, w FROM qx JOIN wt USING (country, term)),
pn AS (SELECT cand, sqrt(sum(w * w)) AS nt FROM pw GROUP BY cand), qn AS (SELECT s1, src, sqrt(sum(w * w)) AS nq FROM qw GROUP BY s1, src),
dots AS (SELECT s1, src, cand, sum(qw.w * pw.w) AS dot FROM qw JOIN pw USING (country, src, term) GROUP BY s1, src, cand),
sc AS (SELECT s1, cand, src, round(dot / (nq * nt), 9) AS score FROM dots JOIN qn USING (s1, src) JOIN pn USING (cand)),
hits AS (SELECT *, row_number() OVER (PARTITION BY s1, src ORDER BY score DESC, cand) - 1 AS rank FROM sc QUALIFY rank < {k})"""


#: truth: s1 (owner) and m, from equal texts.
TRUTH = """own AS (SELECT country, name || ' ' || addr AS k, min(code) AS s1 FROM rec WHERE src = 1 GROUP BY ALL),
truth AS (SELECT s1, code AS m FROM rec JOIN own ON rec.country = own.country AND rec.name || ' ' || rec.addr = own.k WHERE src > 1)"""

#: cs: customers and suppliers of one nation.
CS = f"""cs AS (SELECT c_custkey AS s1, s_suppkey AS cand, {normal('c_name')} AS a, {normal('s_name')} AS b FROM customer JOIN supplier ON c_nationkey = s_nationkey)"""
