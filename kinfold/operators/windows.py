"""Context of a pair among its entity's, its candidate's or another group's pairs. Frames are whole groups; ties go to the smaller
candidate; NaN becomes NULL on entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

D = 9


def number(c: str) -> Column:
    return F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))


def context(rows: DataFrame, columns: list[str], by: str = "s1") -> DataFrame:
    """Per column its gap to the group's maximum and its rank (descending, ties share the least), and the group's size."""
    w = W.Window.partitionBy(by)
    out = [F.count(F.lit(1)).over(w).alias("n_cands")]
    for c in columns:
        v = number(c)
        out += [F.round(F.max(v).over(w) - v, D).alias(f"{c}_gap"), F.when(v.isNotNull(), F.rank().over(w.orderBy(v.desc_nulls_last()))).alias(f"{c}_rank")]
    return rows.select("*", *out)


def leave_one_out(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """max_other (NULL if alone), rank from 0, size."""
    w = W.Window.partitionBy(*by)
    order = w.orderBy(F.desc(value), "s1", "cand")
    rank = F.row_number().over(order)
    top, second = F.max(value).over(w), F.max(F.when(F.col("_r") == 2, F.col(value))).over(w)
    return rows.withColumn("_r", rank).select(*rows.columns, F.when(F.col("_r") == 1, second).otherwise(top).alias("max_other"), (F.col("_r") - 1).alias("rank0"), F.count(F.lit(1)).over(w).alias("size"))


def group_stats(rows: DataFrame, by: list[str], prefix: str, thresholds=(0.1, 0.5, 0.9), neighbours: bool = False) -> DataFrame:
    """n, max_other, sum_other, rank, gap_top, share and counts of others over thresholds; gaps to the neighbours in order too."""
    w = W.Window.partitionBy(*by)
    order = w.orderBy(F.desc("prob"), "s1", "cand")
    p = F.col("prob")
    got = rows.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_s", F.sum(p).over(w)).withColumn("_t", F.max(p).over(w))
    second = F.coalesce(F.max(F.when(F.col("_r") == 2, p)).over(w), F.lit(0.0))
    out = {
        "n": F.col("_n"), "max_other": F.when(F.col("_r") == 1, second).otherwise(F.col("_t")), "sum_other": F.round(F.col("_s") - p, D),
        "rank": F.col("_r"), "gap_top": F.round(F.col("_t") - p, D), "share": F.round(p / F.greatest(F.col("_s"), F.lit(1e-9)), D),
    }
    for t in thresholds:
        over = (p >= t).cast("int")
        out[f"n{int(t * 100):02d}_other"] = F.sum(over).over(w) - over
    if neighbours:
        out["gap_next"] = F.round(p - F.coalesce(F.lead(p).over(order), F.lit(0.0)), D)
        out["gap_prev"] = F.round(F.coalesce(F.lag(p).over(order), F.lit(1.0)) - p, D)
        out["expcnt_minus_rank"] = F.round(F.col("_s") - F.col("_r"), D)
    return got.select(*rows.columns, *[c.alias(prefix + k) for k, c in out.items()])


def other_source(rows: DataFrame, key: str) -> DataFrame:
    """The largest prob that the entity's other source (2 or 3) has under the same key, -1 if none."""
    w = W.Window.partitionBy("s1", key)
    best = {s: F.max(F.when(F.col("src") == s, F.col("prob"))).over(w) for s in (2, 3)}
    return rows.withColumn("max_other_src", F.coalesce(F.when(F.col("src") == 2, best[3]).otherwise(best[2]), F.lit(-1.0)))


def competition(rows: DataFrame, score: str = "prob") -> DataFrame:
    """Per pair: the best score that another entity gives its candidate (0 if none), the margin, whether the entity is the best
    claimant, and the number of claimants. Maxima and joins, not a window, as a candidate may have very many claimants."""
    top = rows.groupBy("cand").agg(F.max(F.struct(F.col(score).alias("p"), (-F.col("s1")).alias("o"))).alias("_t"), F.count(F.lit(1)).alias("comp_n"))
    got = rows.join(top, "cand")
    is_top = F.col("s1") == -F.col("_t.o")
    second = got.filter(~is_top).groupBy("cand").agg(F.max(score).alias("_p2"))
    other = F.when(is_top, F.coalesce("_p2", F.lit(0.0))).otherwise(F.col("_t.p"))
    return got.join(second, "cand", "left").select(*rows.columns, other.alias("comp_best_other"), F.round(F.col(score) - other, D).alias("comp_margin"), is_top.cast("int").alias("comp_is_top"), "comp_n")


def competition_forward(rows: DataFrame, forward: DataFrame) -> DataFrame:
    """The second definition: claimants are the forward pairs only, the margin is NULL for a pair that is not one of them, and an
    unknown candidate has best other 0, no top and no claimants."""
    n = forward.groupBy("cand").agg(F.max(F.struct("prob", (-F.col("s1")).alias("o"))).alias("t"), F.count(F.lit(1)).alias("n"))
    second = forward.join(n.select("cand", (-F.col("t.o")).alias("top")), "cand").filter("s1 <> top").groupBy("cand").agg(F.max("prob").alias("p2"))
    got = rows.join(n, "cand", "left").join(second, "cand", "left").join(forward.select("s1", "cand", F.col("prob").alias("own")), ["s1", "cand"], "left")
    is_top = F.coalesce(F.col("s1") == -F.col("t.o"), F.lit(False))
    other = F.coalesce(F.when(is_top, F.col("p2")).otherwise(F.col("t.prob")), F.lit(0.0))
    return got.select(*rows.columns, other.alias("comp_best_other"), F.round(F.col("own") - other, D).alias("comp_margin"), is_top.cast("int").alias("comp_is_top"), F.coalesce("n", F.lit(0)).alias("comp_n"))


def source_room(rows: DataFrame) -> DataFrame:
    """Confident others (prob of .5 and more) of the own and the other source, sums, and the room left of 5 (source 2) or 6."""
    w, all_ = W.Window.partitionBy("s1", "src"), W.Window.partitionBy("s1")
    sure = (F.col("prob") >= 0.5).cast("int")
    own = F.sum(sure).over(w) - sure
    room = F.when(F.col("src") == 2, 5).otherwise(6) - own
    return rows.select("*", own.alias("n_conf_src_other"), (F.sum(sure).over(all_) - F.sum(sure).over(w)).alias("n_conf_othersrc"), F.round(F.sum("prob").over(w) - F.col("prob"), D).alias("sum_p_src_other"), room.alias("src_cap_room"), F.sum(sure).over(all_).alias("ent_conf_n"))


def anchors(rows: DataFrame, sure: float = 0.9) -> DataFrame:
    """Rank of prob in the entity from 0, whether the pair is an anchor, and the anchors' number and mean."""
    w = W.Window.partitionBy("s1")
    is_anchor = (F.col("prob") >= sure).cast("int")
    mean = F.coalesce(F.sum(F.col("prob") * is_anchor).over(w) / F.nullif(F.sum(is_anchor).over(w), F.lit(0)), F.lit(0.0))
    return rows.select("*", (F.row_number().over(w.orderBy(F.desc("prob"), "cand")) - 1).alias("p2_rank"), is_anchor.alias("is_anchor"), F.sum(is_anchor).over(w).alias("n_anchors"), F.round(mean, D).alias("anchor_p_mean"))


def stacker(rows: DataFrame) -> DataFrame:
    """Rank, gap to the best other (default 20 and -20) in logit terms, band size and sure pairs of the entity."""
    w = W.Window.partitionBy("s1")
    p = F.least(F.greatest("prob", F.lit(1e-7)), F.lit(1 - 1e-7))
    got = rows.withColumn("logit", F.round(F.log(p / (1 - p)), 6)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("prob"), "cand")))
    second = F.max(F.when(F.col("_r") == 2, F.col("logit"))).over(w)
    other = F.coalesce(F.when(F.col("_r") == 1, second).otherwise(F.max("logit").over(w)), F.lit(-20.0))
    band = F.sum(F.col("prob").between(1e-3, 0.999).cast("int")).over(w)
    return got.select(*rows.columns, "logit", (F.col("_r") - 1).alias("ce_rank"), F.when(F.count(F.lit(1)).over(w) == 1, 20.0).otherwise(F.round(F.col("logit") - other, 6)).alias("ce_gap"), other.alias("ce_max_o"), band.alias("n_band"), F.sum((F.col("prob") >= 0.999).cast("int")).over(w).alias("n_sure"))


def rescue(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows: new pairs s1, cand, ce, cos. Ranks by both scores, new pairs of the entity, and what its known pairs' prob says (0 without any)."""
    w = W.Window.partitionBy("s1")
    got = known.groupBy("s1").agg(F.max("prob").alias("ent_pmax"), F.round(F.sum("prob"), D).alias("ent_psum"), F.sum((F.col("prob") >= 0.5).cast("int")).alias("ent_n50"))
    ranks = [(F.row_number().over(w.orderBy(F.desc(c), "cand")) - 1).alias(f"{c}_rank") for c in ("ce", "cos")]
    return rows.select("*", *ranks, F.count(F.lit(1)).over(w).alias("n_new")).join(got, "s1", "left").fillna(0, ["ent_pmax", "ent_psum", "ent_n50"])


def empty_sums(rows: DataFrame) -> DataFrame:
    """rows: s1, cand, prob, empty. Summed prob of the entity's other pairs without and with an address."""
    w = W.Window.partitionBy("s1")
    e, f = F.col("prob") * F.col("empty"), F.col("prob") * (1 - F.col("empty"))
    return rows.select("s1", "cand", F.round(F.sum(e).over(w) - e, D).alias("ent_empty_psum"), F.round(F.sum(f).over(w) - f, D).alias("ent_nonempty_psum"))


def looked_up(pairs: DataFrame, forward: DataFrame) -> DataFrame:
    """Any pairs (s1, cand) with what a forward table (s1, cand, score, rank) says of them: their own score and rank (NULL and 99 if
    they are not in it) and the competition for their candidate."""
    own = forward.select("s1", "cand", F.col("score").alias("blk_score"), F.col("rank").alias("blk_rank"))
    rows = competition_forward(pairs, forward.select("s1", "cand", F.col("score").alias("prob")))
    return rows.join(own, ["s1", "cand"], "left").withColumn("blk_rank", F.coalesce("blk_rank", F.lit(99)))


def recomputed(rows: DataFrame, columns: list[str], by: str = "s1") -> DataFrame:
    """The context of what is left after pruning, in place of the one that rows carry."""
    return context(rows.drop("n_cands", *[f"{c}_{k}" for c in columns for k in ("gap", "rank")]), columns, by)


def stage_four(rows: DataFrame) -> DataFrame:
    """rows: s1, cand, p3. Rank (ties share the least), the entity's sum, and the best other: the second largest for a pair that has
    the largest value."""
    w = W.Window.partitionBy("s1")
    got = rows.withColumn("_o", F.row_number().over(w.orderBy(F.desc("p3"), "cand")))
    second = F.coalesce(F.max(F.when(F.col("_o") == 2, F.col("p3"))).over(w), F.lit(0.0))
    top = F.max("p3").over(w)
    return got.select("s1", "cand", "p3", F.rank().over(w.orderBy(F.desc("p3"))).alias("s4_rank"), F.round(F.sum("p3").over(w), D).alias("s4_ent_sum"), F.when(F.col("p3") >= top, second).otherwise(top).alias("s4_best_other"))
