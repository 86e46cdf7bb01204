"""Personal data by weak supervision, in DataFrame functions only.

Base kinds (email, ip, card, phone) are found by their patterns and always stay. Further candidates, long words that mix letters and digits
(secret) and three-two-four digit groups (ssn), go before five labelers: shape, gazetteer of known prefixes, context words before the
span, delimiters around it and share of digits. Each votes for, against or not at all. Expectation-maximisation over the
counted patterns of votes estimates how reliable each labeler is; the posteriors then train a logistic span classifier on the
votes and the span's kind and length class. Patterns are few however large the corpus is, so their counts are all that the driver sees.
Candidates that the classifier accepts and no base span touches are added.

Places are code points, the end exclusive. Patterns use possessive repeats and start only where a run of their first characters
starts or the last match ended, so a long run is read once. Nulls: a null text is empty and has no spans; a null doc_id is
kept. Repeated rows are judged alike, each for itself; where spans of several kinds overlap, all are given, base ones first. A text
of very many spans is gathered in blocks, in little more than proportion. Other columns pass through, but for _base and _spans,
which are replaced. An empty table gives no rows; without candidates nothing is added.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "ssn")
#: The patterns; \\G is the last match's end.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?(?:\.|$)){4}$"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
CARD_LEAST = r"[0-9](?:[\x20-]?[0-9]){12}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?:\G|(?<![A-Za-z0-9_-]))(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PREFIXES = r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|sk-|sk_live_|pk_live_|xox[abp]-|AIza|eyJ|glpat-)"
CONTEXT = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_\x20-]?key|private[_\x20-]?key|access[_\x20-]?key|auth|bearer|credential|ssn|social[\x20]security)[\"'\x20:=_a-zA-Z]{0,12}$"
#: Code points before a span that the context labeler reads, and spans of a text that are gathered at once.
BEFORE, BLOCK = 32, 128
EMPTY = "array<struct<kind: string, start: long, end: long, match: string, before: string, after: string>>"
SPAN = "array<struct<kind: string, start: long, end: long>>"
LABELERS = ("shape", "gazetteer", "context", "delimiter", "digits")
ROUNDS = 50


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, also where a function inside use reads it for each of many elements."""
    return F.get(F.transform(F.array(value), use), 0)


def gathered(items: Column, begin: Column, empty: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What step makes of each item and a state that runs through them, as an array. step returns the next state and the element. An
    array grows by copying, so BLOCK elements are gathered at a time, and the blocks after that."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / BLOCK) - 1, F.lit(0)).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, BLOCK))

    def one(state: Column, item: Column) -> Column:
        after, element = step(state["at"], item)
        return F.struct(after.alias("at"), F.concat(state["out"], F.array(element)).alias("out"))

    def block(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["at"].alias("at"), empty.alias("out")), one)
        return F.aggregate(F.array(inner), state, lambda _, x: F.struct(x["at"].alias("at"), F.concat(state["out"], F.array(x["out"])).alias("out")))

    return F.aggregate(blocks, F.struct(begin.alias("at"), F.array().cast(f"array<{EMPTY}>").alias("out")), block, lambda state: F.flatten(state["out"]))


def found(text: Column, pattern: str, kind: str, only: Column) -> Column:
    """The pattern's matches where only holds, as structs kind, start, end, match, before and after: up to BEFORE code points of the
    match before and what follows it, and the next one. What lies between matches comes from a split at them, and lengths add up to
    places, so no match is sought from the text's start."""
    none = F.array(F.lit(""))

    def zipped(gaps: Column, matches: Column) -> Column:
        n = F.size(matches)
        items = F.arrays_zip(F.slice(gaps, F.lit(1), n).alias("gap"), matches.alias("match"), F.slice(F.concat(none, matches), F.lit(1), n).alias("prior"), F.slice(gaps, F.lit(2), n).alias("next"), F.slice(F.concat(matches, none), F.lit(2), n).alias("following"))
        return bound(items, lambda x: gathered(x, F.lit(0).cast("long"), F.array().cast(EMPTY), step))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["match"])
        before, after = F.right(F.concat(x["prior"], x["gap"]), F.lit(BEFORE)), F.left(F.concat(x["next"], x["following"]), F.lit(1))
        return end, F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["match"].alias("match"), before.alias("before"), after.alias("after"))

    all_ = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: bound(F.split(text, pattern, -1), lambda gaps: zipped(gaps, matches)))
    return F.when(only, all_).otherwise(F.array().cast(EMPTY))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The base kinds' spans by kind, each in order of start."""
    cards = F.filter(found(text, CARD, "card", text.rlike(CARD_LEAST)), lambda s: F.length(_digits(s["match"])).between(13, 19))
    return {
        "email": found(text, EMAIL, "email", F.contains(text, F.lit("@"))),
        "ip": F.filter(found(text, IP, "ip", text.rlike(r"[0-9]\.[0-9]++\.[0-9]")), lambda s: s["match"].rlike(IP_PARTS)),
        "card": F.filter(cards, lambda s: luhn(_digits(s["match"]))),
        "phone": F.filter(found(text, PHONE, "phone", F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s["match"])).between(9, 15)),
    }


def _vote(for_: Column, against: Column) -> Column:
    return F.when(for_, 2).when(against, 0).otherwise(1)


def judged(span: Column) -> Column:
    """A candidate with its cell: its kind, length class and votes (0 against, 1 none, 2 for) as one string."""
    match, before, after = span["match"], span["before"], span["after"]
    share = F.length(_digits(match)) / F.length(match)
    secret = span["kind"] == "secret"
    shape = _vote(F.when(secret, match.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | (match.rlike("[a-z]") & match.rlike("[A-Z]") & (F.length(match) >= 20))).otherwise(match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)")), F.when(secret, match.rlike("^[A-Za-z]+[_-]?[0-9]{1,4}$")).otherwise(match.rlike("^(?:000|666|9)")))
    gazetteer = _vote(match.rlike(PREFIXES), match.rlike("(?i)(?:version|license|example|chapter|section)"))
    context = _vote(before.rlike(CONTEXT), ~before.rlike(CONTEXT))
    quoted = before.rlike(r"[\"'=:]\x20?$") | after.rlike("[\"']")
    delimiter = _vote(quoted, before.rlike(r"[A-Za-z,]\x20$"))
    digits = _vote(F.when(secret, share.between(0.2, 0.85)).otherwise(F.lit(True)), F.when(secret, ~share.between(0.05, 0.95)).otherwise(F.lit(False)))
    size = F.when(F.length(match) < 20, "a").when(F.length(match) < 32, "b").otherwise("c")
    return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), F.concat_ws("", F.substring(span["kind"], 1, 2), size, shape, gazetteer, context, delimiter, digits).alias("cell"))


def candidates(text: Column) -> Column:
    secrets = found(text, SECRET, "secret", text.rlike(SECRET.replace(r"\G|", "")))
    return F.transform(F.concat(secrets, found(text, SSN, "ssn", text.rlike(SSN))), judged)


def estimate(cells: dict[str, int], rounds: int = ROUNDS) -> tuple[float, dict[tuple[int, int], tuple[float, float]], dict[str, float]]:
    """(share of true spans, (labeler, vote) -> its chance on true and on false spans, posteriors by cell) by
    expectation-maximisation, from a start where votes are right more often than not, with pseudo-counts."""
    prior = 0.5
    table = {(k, v): (p, q) for k in range(len(LABELERS)) for v, p, q in ((0, 0.15, 0.55), (1, 0.3, 0.3), (2, 0.55, 0.15))}
    posterior: dict[str, float] = {}
    for _ in range(rounds):
        for cell in cells:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[k, int(v)][0] / table[k, int(v)][1]) for k, v in enumerate(cell[3:]))
            posterior[cell] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        true = sum(n * posterior[c] for c, n in cells.items())
        total = sum(cells.values())
        prior = (true + 2) / (total + 4)
        for k in range(len(LABELERS)):
            sums = {v: [0.0, 0.0] for v in range(3)}
            for cell, n in cells.items():
                sums[int(cell[3 + k])][0] += n * posterior[cell]
                sums[int(cell[3 + k])][1] += n * (1 - posterior[cell])
            for v, p, q in ((0, 1.0, 3.0), (1, 2.0, 2.0), (2, 3.0, 1.0)):
                table[k, v] = (sums[v][0] + p) / (true + 6), (sums[v][1] + q) / (total - true + 6)
    return prior, table, posterior


def signals(cell: str) -> list[str]:
    """What the span classifier sees of a cell."""
    return ["bias", f"kind:{cell[:2]}", f"size:{cell[2]}", *(f"{name}:{v}" for name, v in zip(LABELERS, cell[3:], strict=True))]


def train(cells: dict[str, int], posterior: dict[str, float], rounds: int = 400, rate: float = 1.0, decay: float = 1e-3) -> dict[str, float]:
    """Logistic regression on posteriors, each cell weighted by its share."""
    total = sum(cells.values()) or 1
    weights = {s: 0.0 for c in cells for s in signals(c)}
    for _ in range(rounds):
        step = {s: decay * w for s, w in weights.items()}
        for cell, n in cells.items():
            miss = (1 / (1 + math.exp(-sum(weights[s] for s in signals(cell)))) - posterior[cell]) * n / total
            for s in signals(cell):
                step[s] += miss
        for s in weights:
            weights[s] -= rate * step[s]
    return weights


def accepted(docs: DataFrame) -> list[str]:
    """The cells whose spans the trained classifier accepts. Reads all documents once for the counts of cells."""
    rows = docs.select(F.explode(candidates(common.text_of())).alias("c")).groupBy("c.cell").count().collect()
    cells = {r["cell"]: r["count"] for r in rows}
    if not cells:
        return []
    _, _, posterior = estimate(cells)
    weights = train(cells, posterior)
    return sorted(c for c in cells if sum(weights[s] for s in signals(c)) > 0)


def with_spans(docs: DataFrame) -> DataFrame:
    """docs and a column _spans: per kind, in the order of BASE and ADDED, the spans in order of start."""
    good = accepted(docs)
    text = common.text_of()
    base = F.concat(*[F.transform(s, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))) for s in base_spans(text).values()])
    rows = docs.withColumn("_base", base)
    if not good:
        return rows.withColumn("_spans", F.col("_base"))
    free = F.filter(candidates(text), lambda c: c["cell"].isin(good) & ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return rows.withColumn("_spans", F.concat("_base", F.transform(free, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of overlapping spans the first names what they cover together. Each
    block of spans takes its part out of the text once, and each span its piece out of that part."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def blocks(every: Column) -> Column:
        count = F.greatest(F.ceil(F.size(every) / BLOCK) - 1, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda k: F.slice(every, k * BLOCK + 1, BLOCK))

    def piece(part: Column, at: Column, start: Column, end: Column) -> Column:
        return F.substring(part, (start - at).cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int"))

    def block(state: Column, some: Column) -> Column:
        at, last = state["at"], F.greatest(state["at"], F.array_max(F.transform(some, lambda s: s["start"])))
        part = piece(text, F.lit(0), at, last)

        def one(inner: Column, s: Column) -> Column:
            fresh = s["start"] >= inner["at"]
            said = F.concat(piece(inner["part"], at, inner["at"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.struct(F.greatest(inner["at"], -s["back"]).alias("at"), F.when(fresh, F.concat(inner["out"], F.array(said))).otherwise(inner["out"]).alias("out"), inner["part"].alias("part"))

        inner = F.aggregate(some, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"), part.alias("part")), one)
        return F.aggregate(F.array(inner), state, lambda _, x: F.struct(x["at"].alias("at"), F.concat(state["out"], F.array(F.array_join(x["out"], ""))).alias("out")))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(bound(ordered, blocks), begin, block, lambda state: F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"].cast("int") + 1, F.lit(2147483647))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spans(common.table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))
