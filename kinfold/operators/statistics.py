"""Corpus statistics, dictionaries, audits and diagnostics as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from kinfold.functions import text as X

D = 9


def token_idf(rows: DataFrame, words: str) -> DataFrame:
    """Documents that hold each word, and idf = ln(n + 1) - ln(df + 1)."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    df = rows.select(F.explode(F.array_distinct(words)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.round(F.log(F.col("n") + 1) - F.log(F.col("df") + 1), D).alias("idf"))  # n is one row


def noise(targets: DataFrame, own: DataFrame, words: str) -> DataFrame:
    """How much commoner a word is among targets than among own records."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.explode(F.array_distinct(words)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias(name))

    sizes = targets.agg(F.count(F.lit(1)).alias("nt")).crossJoin(own.agg(F.count(F.lit(1)).alias("no")))  # one row each
    both = counted(targets, "dt").join(counted(own, "do"), "token", "full").crossJoin(F.broadcast(sizes))
    dt, do = F.coalesce("dt", F.lit(0)), F.coalesce("do", F.lit(0))
    value = F.log((dt + 1) / (F.col("nt") + 1)) - F.log((do + 1) / (F.col("no") + 1))
    return both.select("token", F.round(value, D).alias("noise"))


def core_names(rows: DataFrame, own: DataFrame, most: float = 0.003) -> DataFrame:
    """rows (code, nt) with core, the name's words that at most that share of own records has, or all if none is left."""
    n = own.agg(F.count(F.lit(1)).alias("n"))
    common = own.select(F.explode(F.array_distinct("nt")).alias("w")).groupBy("w").count().crossJoin(F.broadcast(n)).filter(F.col("count") > most * F.col("n")).select("w")
    words = rows.select("code", F.posexplode("nt").alias("pos", "w")).join(common, "w", "left_anti")
    core = words.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda s: s["w"]), " ").alias("core"))
    return rows.join(core, "code", "left").withColumn("core", F.coalesce("core", "name"))


def dictionary(pairs: DataFrame, least: int = 3, share: float = 0.8) -> DataFrame:
    """pairs: native and latin (arrays). Words at the same place of pairs of equal length: native, latin, n, share, of words seen
    often enough with one partner mostly; of equal partners the first in order."""
    aligned = pairs.filter(F.size("native") == F.size("latin")).select(F.explode(F.arrays_zip("native", "latin")).alias("p")).select("p.native", "p.latin")
    counts = aligned.groupBy("native", "latin").agg(F.count(F.lit(1)).alias("k"))
    best = counts.groupBy("native").agg(F.sum("k").alias("n"), F.min(F.struct((-F.col("k")).alias("k"), "latin")).alias("b"))
    return best.select("native", F.col("b.latin").alias("latin"), "n", F.round(-F.col("b.k") / F.col("n"), D).alias("share")).filter((F.col("n") >= least) & (F.col("share") >= share))


def number_support(rows: DataFrame) -> DataFrame:
    """rows: s1, cand, prob, numbers. Each pair's support by the entity's other pairs of its first number, and the least of its
    other numbers: summed prob and count."""
    each = rows.select("s1", "cand", "prob", F.posexplode(F.array_distinct("numbers")).alias("pos", "number"))
    w = W.Window.partitionBy("s1", "number")
    got = each.withColumn("p", F.sum("prob").over(w) - F.col("prob")).withColumn("n", F.count(F.lit(1)).over(w) - 1)
    first, extra = F.col("pos") == 0, F.col("pos") > 0
    return got.groupBy("s1", "cand").agg(
        F.round(F.max(F.when(first, F.col("p"))), D).alias("nsup_first_p"), F.max(F.when(first, F.col("n"))).alias("nsup_first_n"),
        F.round(F.min(F.when(extra, F.col("p"))), D).alias("nsup_extra_p"), F.min(F.when(extra, F.col("n"))).alias("nsup_extra_n"),
    )


def source_audit(rows: DataFrame, by: str, key: str, text: str) -> DataFrame:
    """Rows, distinct and empty values, extreme keys and lengths per group."""
    n = F.length(F.coalesce(text, F.lit("")))
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_ids"), F.min(key).alias("min_id"), F.max(key).alias("max_id"),
        F.sum((n == 0).cast("int")).alias("n_empty"), F.count_distinct(text).alias("n_texts"), F.round(F.avg(n), 6).alias("mean_chars"),
        F.round(F.expr(f"percentile(length(coalesce({text}, '')), 0.5)"), 6).alias("p50_chars"), F.round(F.expr(f"percentile(length(coalesce({text}, '')), 0.95)"), 6).alias("p95_chars"),
        F.max(n).alias("max_chars"), F.sum(F.coalesce(F.col(text), F.lit("")).rlike("[0-9]").cast("int")).alias("n_digits"), F.sum(F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x00-\x7F]").cast("int")).alias("n_nonascii"),
    )


def match_counts(truth: DataFrame) -> DataFrame:
    """truth: s1, m (NULL for a singleton). How many entities have how many matches, and how many matches have more than one owner."""
    per = truth.groupBy("s1").agg(F.count("m").alias("n_matches"))
    claimed = truth.filter("m IS NOT NULL").groupBy("m").agg(F.count_distinct("s1").alias("k")).agg(F.coalesce(F.sum((F.col("k") > 1).cast("int")), F.lit(0)).alias("multi"))
    return per.groupBy("n_matches").agg(F.count(F.lit(1)).alias("n_entities")).crossJoin(F.broadcast(claimed)).withColumnRenamed("multi", "n_multi_claimed")  # one row


def cross_checks(truth: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """truth: s1, m; left, right: code, country. Pairs, pairs across blocks, unmatched share of right, mean code difference."""
    pairs = truth.filter("m IS NOT NULL").join(left.select(F.col("code").alias("s1"), F.col("country").alias("ca")), "s1").join(right.select(F.col("code").alias("m"), F.col("country").alias("cb")), "m")
    one = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.sum((F.col("ca") != F.col("cb")).cast("int")).alias("n_cross"), F.round(F.avg(F.abs(F.col("s1") % 10_000_000_000 - F.col("m") % 10_000_000_000)), 6).alias("mean_id_diff"))
    rest = right.join(truth.select(F.col("m").alias("code")).filter("code IS NOT NULL").distinct(), "code", "left_anti").agg(F.count(F.lit(1)).alias("n_unmatched"))
    return one.crossJoin(rest)  # one row each


def profile(cands: DataFrame) -> DataFrame:
    """cands: s1, src, score, rank. Per source: mean score of the first, the mean of the first two and five, gap and share above one half."""
    per = cands.groupBy("src", "s1").agg(F.max(F.when(F.col("rank") == 0, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("b"), F.avg(F.when(F.col("rank") < 5, F.col("score"))).alias("five"))
    b = F.coalesce("b", F.lit(0.0))
    return per.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("top1"), F.round(F.avg(b), 6).alias("top2"), F.round(F.avg("five"), 6).alias("top5"), F.round(F.avg(F.col("a") - b), 6).alias("gap"), F.round(F.avg((F.col("a") > 0.5).cast("int")), 6).alias("over_half"), F.round(F.expr("percentile(a, 0.1)"), 6).alias("p10"))


def recall_at(truth: DataFrame, cands: DataFrame, depths=(1, 3, 5, 10, 20, 30)) -> DataFrame:
    """Share of truth pairs (s1, m) among the first k candidates, and the share of entities whose pairs are all there."""
    hit = truth.filter("m IS NOT NULL").join(cands.select("s1", F.col("cand").alias("m"), "rank"), ["s1", "m"], "left")
    ks = F.explode(F.array(*[F.lit(k) for k in depths])).alias("depth")
    per = hit.select("s1", "rank", ks).groupBy("depth", "s1").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce((F.col("rank") < F.col("depth")).cast("int"), F.lit(0))).alias("h"))
    f = F.when(F.col("h") == 0, 0.0).otherwise(1.25 * F.col("h") / (0.25 * F.col("n") + F.col("h")))
    return per.groupBy("depth").agg(F.round(F.sum("h") / F.sum("n"), 6).alias("recall"), F.round(F.avg(f), 6).alias("oracle_f05"), F.round(F.avg((F.col("h") == F.col("n")).cast("int")), 6).alias("full_coverage"))


def channel_report(truth: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """What a channel adds to candidates: recall before and after, new pairs and how many of them are right."""
    t = truth.filter("m IS NOT NULL").select("s1", F.col("m").alias("cand")).distinct()
    fresh = new.select("s1", "cand").distinct().join(old.select("s1", "cand"), ["s1", "cand"], "left_anti")
    counts = [(t, "n_truth"), (t.join(old, ["s1", "cand"], "left_semi"), "n_old"), (fresh, "n_new"), (t.join(fresh, ["s1", "cand"], "left_semi"), "n_recovered")]
    out = None
    for rows, name in counts:
        one = rows.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.select("*", F.round(F.col("n_old") / F.col("n_truth"), 6).alias("recall_old"), F.round((F.col("n_old") + F.col("n_recovered")) / F.col("n_truth"), 6).alias("recall_union"))


def auc(rows: DataFrame, by: list[str], score: str = "prob", label: str = "label") -> DataFrame:
    """Area under the ROC curve from average ranks. Equal scores are one row before the running count."""
    steps = rows.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    before = F.coalesce(F.sum("n").over(W.Window.partitionBy(*by).orderBy(score).rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    mean = steps.withColumn("r", before + (F.col("n") + 1) / 2)
    p, n = F.sum("pos"), F.sum("n")
    return mean.groupBy(*by).agg(F.round((F.sum(F.col("pos") * F.col("r")) - p * (p + 1) / 2) / F.nullif(p * (n - p), F.lit(0)), 6).alias("auc"))


def log_loss(rows: DataFrame, by: list[str]) -> DataFrame:
    p = F.least(F.greatest("prob", F.lit(1e-7)), F.lit(1 - 1e-7))
    return rows.groupBy(*by).agg(F.round(F.avg(-(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p))), 6).alias("log_loss"), F.round(F.avg("prob"), 6).alias("mean_prob"), F.round(F.avg("label"), 6).alias("rate"))


def paired_gain(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """a, b: s1, f and by. The mean difference of two rules' scores and its standard error."""
    d = b.select("s1", F.col("f").alias("fb")).join(a, "s1").withColumn("d", F.col("fb") - F.col("f"))
    return d.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("gain"), F.round(F.stddev_pop("d") / F.sqrt(F.count(F.lit(1))), 6).alias("se"))


def gates(rows: DataFrame, a: str, b: str, by: str, least: float = 0.5) -> DataFrame:
    """How two scores differ: entities whose set above the threshold changes, per 1000, and the logit shift's moments."""

    def logit(c: str):
        p = F.least(F.greatest(c, F.lit(1e-7)), F.lit(1 - 1e-7))
        return F.log(p / (1 - p))

    got = rows.withColumn("d", logit(b) - logit(a)).withColumn("x", ((F.col(a) >= least) != (F.col(b) >= least)).cast("int"))
    per = got.groupBy(by, "s1").agg(F.max("x").alias("x"), F.sum("d").alias("sd"), F.sum(F.col("d") * F.col("d")).alias("sq"), F.count(F.lit(1)).alias("n"), F.sum((F.abs("d") > 1).cast("int")).alias("big"))
    mean = F.sum("sd") / F.sum("n")
    return per.groupBy(by).agg(F.round(1000 * F.avg("x"), 6).alias("changed_per_1000"), F.round(mean, 6).alias("shift"), F.round(F.sqrt(F.greatest(F.sum("sq") / F.sum("n") - mean * mean, F.lit(0.0))), 6).alias("shift_sd"), F.round(F.sum("big") / F.sum("n"), 6).alias("share_over_1"))


def addresses(rows: DataFrame) -> DataFrame:
    """How many records have each address key; the empty key is none."""
    return rows.select(X.address_key(F.col("at")).alias("addr_key")).filter("addr_key <> ''").groupBy("addr_key").agg(F.count(F.lit(1)).alias("n"))


def translated(rows: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """rows (key, text) with said, the words of text with those of the dictionary (t, said) replaced; others stay."""
    words = rows.select(key, F.posexplode(X.tokens(F.col(text))).alias("pos", "t")).join(dictionary, "t", "left")
    said = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("said", "t").alias("w")))).alias("l"))
    return rows.select(key).join(said, key, "left").select(key, F.coalesce(F.array_join(F.transform("l", lambda x: x["w"]), " "), F.lit("")).alias("said"))


def gate_percentiles(rows: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """The first and last percentile of the change in logit from score a to score b."""

    def logit(c: str):
        p = F.least(F.greatest(c, F.lit(1e-7)), F.lit(1 - 1e-7))
        return F.log(p / (1 - p))

    got = rows.withColumn("d", logit(b) - logit(a))
    return got.groupBy(by).agg(F.round(F.expr("percentile(d, 0.01)"), 6).alias("p1"), F.round(F.expr("percentile(d, 0.99)"), 6).alias("p99"))
