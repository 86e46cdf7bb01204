"""All pairs of two sides of a block, scored by matrices: rows of either side meet in lists, a pair is a row only in the result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similarity

#: A list holds so many rows of a block at most, so a matrix the square of it. A block's left lists are dealt to so many parts.
ROWS, PARTS, D = 512, 16, 6
#: Strings of so many letters at most are compared as bits of a number, longer ones by a call a pair. Lists of lists meet in parts of so
#: many pairs of values, or of single rows.
LETTERS, CELLS = 64, 1 << 22
#: So many left strings at a time, so that their matrices stay in a core's cache.
BLOCK = 128


def _listed(rows: DataFrame, by: str) -> DataFrame:
    """Rows of equal by in lists, one row a list."""
    names = rows.columns

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).combine_chunks()
            order = table[by].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            at = np.argsort(order, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(order[at])) + 1, len(at)) if len(at) else []
            table, begin = table.take(pa.array(at)), 0
            for end in ends:
                for b in range(begin, int(end), ROWS):
                    part = table.slice(b, min(ROWS, int(end) - b)).combine_chunks()
                    lists = [part[n].combine_chunks() for n in names]
                    yield pa.RecordBatch.from_arrays([x[:1] if n == by else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for n, x in zip(names, lists, strict=True)], names)
                begin = int(end)

    types = ", ".join(f"{f.name} {f.dataType.simpleString() if f.name == by else f'array<{f.dataType.simpleString()}>'}" for f in rows.schema)
    return rows.filter(F.col(by).isNotNull()).mapInArrow(gathered, types)


def pairs(left: DataFrame, right: DataFrame, score: Callable, columns: dict[str, str], by: str = "k") -> DataFrame:
    """left: s1, by and columns of its own; right: cand, by and others. All pairs of equal by: s1, cand and columns (name: type), which
    score makes of the columns of either side (Arrow arrays by name): a matrix each, or a matrix of values and one of what is null."""
    spread = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the result is far larger than what is dealt
    a = _listed(left, by).withColumn("part", F.pmod(F.xxhash64(F.get("s1", 0)), F.lit(PARTS)).cast("int")).repartition(spread, by, "part")
    b = _listed(right, by).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    own, other = [c for c in left.columns if c not in ("s1", by)], [c for c in right.columns if c not in ("cand", by)]
    kinds = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = ({c: batch.column(c)[i].values for c in [code, *cs]} for code, cs in (("s1", own), ("cand", other)))
                s1, cand = x["s1"].to_numpy(zero_copy_only=False), y["cand"].to_numpy(zero_copy_only=False)
                got = score(x, y)
                out = [pa.array(np.repeat(s1, len(cand)), pa.int64()), pa.array(np.tile(cand, len(s1)), pa.int64())]
                for c, kind in columns.items():
                    value, null = got[c] if isinstance(got[c], tuple) else (got[c], None)
                    null = null if null is not None and null.any() else None
                    out.append(pa.array(value.ravel().astype(kinds[kind].to_pandas_dtype(), copy=False), kinds[kind], mask=None if null is None else null.ravel()))
                yield pa.RecordBatch.from_arrays(out, ["s1", "cand", *columns])

    return a.join(b, [by, "part"]).drop(by, "part").mapInArrow(crossed, ", ".join(f"{n} {t}" for n, t in {"s1": "bigint", "cand": "bigint", **columns}.items()))


def _codes(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Equal values of either side as equal numbers; null is -1."""
    at = pa.concat_arrays([x, y]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return at[: len(x)], at[len(x) :]


def _numbers(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), x.is_null().to_numpy(zero_copy_only=False)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x[:, None] != y[None, :]


def neighbours(x: dict, y: dict) -> dict:
    """functions.text.neighbour_number() of w, d and n: a first number, its house number's digits and their value."""
    (w, v), (p, q) = _codes(x["a_w"], y["b_w"]), _codes(x["a_d"], y["b_d"])
    (m, no_m), (n, no_n) = _numbers(x["a_n"]), _numbers(y["b_n"])
    off = np.abs(m[:, None] - n[None, :])
    near = (off >= 1) & (off <= 4) & ~(no_m[:, None] | no_n[None, :])
    digits = np.array([bool(t) for t in x["a_d"].to_pylist()], bool)
    letter = ~_differ(p, q) & digits[:, None] & _differ(w, v)
    return {"is_neighbor_number": (near | letter, (w == -1)[:, None] | (v == -1)[None, :])}


def distances(x: dict, y: dict) -> dict:
    """collective.number_distance() of its number_parts() a and b."""
    (m, no_m), (n, no_n) = _numbers(x["a_n"]), _numbers(y["b_n"])
    (long, _), (wide, _) = _numbers(x["a_len"]), _numbers(y["b_len"])
    no = no_m[:, None] | no_n[None, :] | ~_differ(*_codes(x["a"], y["b"]))
    d = np.abs(m[:, None] - n[None, :]).astype(np.float64)
    differing = np.zeros(d.shape, np.int8)  # from the first digit that differs on, all prefixes do
    for p in range(11):
        differing += _differ(m // 10**p, n // 10**p)
    first = long[:, None] - differing
    return {"nd_absdiff": (d, no), "nd_logdiff": (np.round(np.log1p(d), D), no), "nd_same_parity": (~_differ(m % 2, n % 2), no), "nd_first_diff_pos": (first, no | _differ(long, wide))}


def overlaps(x: dict, y: dict) -> dict:
    """similarity.idf_overlap() of words and totals of weighed(). Only shared words are added up, in the order of the left's."""
    where: dict[str, list[int]] = {}
    for j, words in enumerate(y["bw"].to_pylist()):
        for w in words:
            where.setdefault(w["token"], []).append(j)
    at, bt = (t.to_numpy(zero_copy_only=False) for t in (x["at"], y["bt"]))
    m = np.zeros((len(at), len(bt)))
    for i, words in enumerate(x["aw"].to_pylist()):
        for w in words:
            if (j := where.get(w["token"])) is not None:
                m[i, j] += w["w"]
    at, bt = np.broadcast_to(at[:, None], m.shape), np.broadcast_to(bt[None, :], m.shape)
    out = {"idf_q": np.zeros(m.shape), "idf_c": np.zeros(m.shape), "idf_u": np.zeros(m.shape)}
    some = (m != 0) & (at != 0) & (bt != 0)
    if some.any():
        s, p, q = m[some], at[some], bt[some]
        for c, of in (("idf_q", p), ("idf_c", q), ("idf_u", p + q - s)):
            out[c][some] = np.round(s / of, D)
    return out


def _different(values: pa.Array) -> tuple[list[str], np.ndarray]:
    """Different strings, and where each row's is among them; null is empty."""
    coded = values.fill_null("").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def _rounded(x: np.ndarray) -> np.ndarray:
    """round() of each value to D digits; numpy's alone errs close to halves."""
    up = x * 10.0**D
    out = np.rint(up)
    np.subtract(up, out, out=up)
    half = np.abs(up, out=up) > 0.4999
    out /= 10.0**D
    if half.any():
        values, at = np.unique(x[half], return_inverse=True)
        out[half] = np.array([round(float(v), D) for v in values])[at]
    return out


def _lengths(p: list[str]) -> np.ndarray:
    return np.array([*map(len, p)], np.int64)


def _letters(p: list[str], q: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Letters of either side's strings as numbers, a row a string, and how many there are. 0 and 1 stand behind the end, of the left and
    of the right."""
    sizes = _lengths([*p, *q])
    width = int(sizes.max())
    points = np.array([*p, *q], f"<U{max(1, width)}").view(np.uint32).reshape(len(sizes), -1)[:, :width]
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    codes = (np.cumsum(seen) + 1)[points]
    codes[np.arange(width) >= sizes[:, None]] = 1
    left = codes[: len(p)]
    left[np.arange(width) >= sizes[: len(p), None]] = 0
    return left, codes[len(p) :], int(seen.sum()) + 2


def _masks(codes: np.ndarray, n: int, lengths: np.ndarray) -> np.ndarray:
    """For each of n letters (rows) and string (columns) the places that have the letter, as bits."""
    width = codes.shape[1]
    kind = np.uint16 if width <= 16 else np.uint32 if width <= 32 else np.uint64
    masks = np.zeros((n, len(codes)), kind)
    for k in range(width):
        own = np.flatnonzero(lengths > k)
        masks[codes[own, k], own] |= kind(1 << k)
    return masks


def _starts(codes: np.ndarray, new: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, np.ndarray]]:
    """For each place in sorted strings: the place, the letters of the different starts up to it, of which shorter start each is (None: of
    its own alone), and of which start each string is. new: where strings begin that share nothing with those before."""
    new, before = new.copy(), np.cumsum(new) - 1
    for k in range(codes.shape[1]):
        had = int(before[-1]) + 1
        new[1:] |= codes[1:, k] != codes[:-1, k]
        first, at = np.flatnonzero(new), np.cumsum(new) - 1
        yield k, codes[first, k], None if len(first) == had else before[first], at
        before = at


def _ratios(p: list[str], q: list[str]) -> np.ndarray:
    """similarity.ratio() of sorted strings p and others q: the bits of lcs() for all q at once, and once for what p begin with alike."""
    (x, y, kinds), n, m = _letters(p, q), _lengths(p), _lengths(q)
    masks, out = _masks(y, kinds, m), np.empty((len(p), len(q)))
    for r in range(0, len(p), BLOCK):
        v = np.full((1, len(q)), ~masks.dtype.type(0))
        for _, letters, of, _ in _starts(x[r : r + BLOCK], np.arange(len(x[r : r + BLOCK])) == 0):
            if of is not None:
                v = v.take(of, 0)
            u = masks.take(letters, 0)
            u &= v
            up = v + u
            v ^= u
            v |= up
        total = n[r : r + BLOCK, None] + m[None, :]
        got = np.multiply(np.bitwise_count(np.invert(v, out=v)), 200.0, out=out[r : r + BLOCK])
        got /= np.maximum(total, 1)
        got[total == 0] = 100.0
    return out


def _winklers(p: list[str], q: list[str]) -> np.ndarray:
    """similarity.jaro_winkler() of sorted strings p, those of a length together, and others q, for all q at once: a letter takes the
    lowest bit that is free, has it and is in reach."""
    (x, y, kinds), n, m = _letters(p, q), _lengths(p), _lengths(q)
    masks = _masks(y, kinds, m)
    return np.concatenate([_winkler(x[r : r + BLOCK], y, n[r : r + BLOCK], m, masks) for r in range(0, len(p), BLOCK)])


def _winkler(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, masks: np.ndarray) -> np.ndarray:
    kind = masks.dtype.type
    reach = np.maximum(0, np.maximum(n[:, None], m[None, :]) // 2 - 1)
    same, most = reach.min() == reach.max(), int(reach.max())
    new = np.append(True, n[1:] != n[:-1])
    used = np.zeros((int(new.sum()), len(m)), masks.dtype)
    hits, rows = np.zeros_like(used), np.flatnonzero(new)
    for k, letters, of, at in _starts(x, new):
        if of is not None:
            used, hits, rows = used.take(of, 0), hits.take(of, 0), np.flatnonzero(np.diff(at, prepend=-1))
        window = np.array([(1 << min(8 * masks.itemsize, k + r + 1)) - (1 << max(0, k - r)) for r in range(most + 1)], masks.dtype)
        free = masks.take(letters, 0)
        free &= window[-1] if same else window[reach[rows]]
        free &= ~used
        low = np.negative(free)
        low &= free
        used |= low
        np.not_equal(low, 0, out=low, casting="unsafe")
        low <<= kind(k)
        hits |= low
    met, right = np.bitwise_count(used).astype(np.float64), np.zeros_like(used)
    low, hit, known = np.empty_like(used), np.empty_like(used), masks.any(1)
    for k in np.flatnonzero(known[x].any(0)):
        # hit: all bits where the left's k-th letter has met one
        np.left_shift(hits, kind(8 * masks.itemsize - 1 - int(k)), out=hit)
        signed = hit.view(hit.dtype.str.replace("u", "i"))
        signed >>= signed.dtype.type(8 * masks.itemsize - 1)
        np.negative(used, out=low)
        low &= used
        low &= hit
        used ^= low
        low &= masks.take(x[:, k], 0)
        right |= low
    turned = met - np.bitwise_count(right)
    turned //= 2
    jaro = met / np.maximum(n, 1)[:, None]
    jaro += met / np.maximum(m, 1)[None, :]
    jaro += (met - turned) / np.maximum(met, 1)
    jaro /= 3
    like, begin = np.ones(jaro.shape, bool), np.zeros(jaro.shape, np.uint8)
    for k in range(min(4, x.shape[1])):
        like &= ~_differ(x[:, k], y[:, k])
        if not like.any():
            break
        begin += like
    got = jaro + begin * 0.1 * (1 - jaro) if begin.any() else jaro
    got = np.where(jaro > 0.7, got, jaro)
    got[(n == 0)[:, None] & (m == 0)[None, :]] = 1.0
    return got


#: Kernels of similarity as matrices, with what they compare of each string.
ALIKE: dict[str, tuple[Callable, Callable]] = {"ratio": (_ratios, str), "tsort": (_ratios, lambda s: " ".join(sorted(s.split()))), "jw": (_winklers, str)}


def _alike(kind: str, p: list[str], q: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernel kind of what it compares of strings, and where in that p and q are."""
    kernel, of = ALIKE[kind]
    x, y = [*map(of, p)], [*map(of, q)]
    a, b = (sorted(set(v), key=lambda s: (len(s), s)) for v in (x, y))
    n, m = (sum(len(s) <= LETTERS for s in v) for v in (a, b))
    out = np.empty((len(a), len(b)))
    if n and m:
        out[:n, :m] = kernel(a[:n], b[:m])
    for i in range(len(a)):
        for j in range(m if i < n else 0, len(b)):
            out[i, j] = similarity.KERNELS[kind](a[i], b[j])
    at, to = (np.array([*map({s: k for k, s in enumerate(u)}.get, v)], np.int64) for u, v in ((a, x), (b, y)))
    return _rounded(out), at, to


def alike(columns: dict[str, str]) -> Callable:
    """A score for pairs() of strings a and b: kernels of ALIKE by the columns' names. Different strings meet once."""

    def score(x: dict, y: dict) -> dict:
        (p, i), (q, j) = _different(x["a"]), _different(y["b"])
        got = {c: _alike(kind, p, q) for c, kind in columns.items()}
        return {c: m.take(at[i], 0).take(to[j], 1) for c, (m, at, to) in got.items()}

    return score


def _equals(p: list, q: list) -> np.ndarray:
    """Where values are equal; None is equal to nothing."""
    code: dict = {}
    x, y = (np.array([none if v is None else code.setdefault(v, len(code)) for v in side], np.int32) for side, none in ((p, -1), (q, -2)))
    return ~_differ(x, y)


def _cuts(p: list[str], q: list[str]) -> np.ndarray:
    """Where one string is the other without its first or its last letter."""
    (a, b), (c, d) = ([[s[1:] if s else None for s in v], [s[:-1] if s else None for s in v]] for v in (p, q))
    return _equals(p, c) | _equals(p, d) | _equals(a, q) | _equals(b, q)


def _edits(p: list[str], q: list[str]) -> np.ndarray:
    """Where one insertion, deletion or replacement at most makes one string of the other. Different strings on either side."""
    left, right = ({s: k for k, s in enumerate(v)} for v in (p, q))
    out, less = np.zeros((len(p), len(q)), bool), {}  # less: right strings without their k-th letter
    for j, b in enumerate(q):
        if (i := left.get(b)) is not None:
            out[i, j] = True
        for k in range(len(b)):
            rest = b[:k] + b[k + 1 :]
            less.setdefault((k, rest), []).append(j)
            if (i := left.get(rest)) is not None:
                out[i, j] = True
    for i, a in enumerate(p):
        for k in range(len(a)):
            rest = a[:k] + a[k + 1 :]
            if (js := less.get((k, rest))) is not None:
                out[i, js] = True
            if (j := right.get(rest)) is not None:
                out[i, j] = True
    return out


def _of_lists(m: np.ndarray, at: np.ndarray, sizes: np.ndarray, f: np.ufunc, axis: int, kind: type) -> np.ndarray:
    """f over the rows (axis 0) or columns of m that each list has, 0 for an empty list. at: those of all lists, one after another."""
    if (sizes == 1).all():
        return m.take(at, axis).astype(kind, copy=False)
    out = np.zeros((len(sizes), m.shape[1]) if axis == 0 else (m.shape[0], len(sizes)), kind)
    some = np.flatnonzero(sizes)
    if len(some):
        got = f.reduceat(m.take(at, axis), (np.cumsum(sizes) - sizes)[some], axis, dtype=kind)
        out[some if axis == 0 else (slice(None), some)] = got
    return out


def _firsts(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each list's first; any one for an empty list."""
    return np.append(at, 0)[np.minimum(np.cumsum(sizes) - sizes, len(at))]


def _sizes(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def listed(score: Callable, size: Callable) -> Callable:
    """score, for parts of the lists whose sizes, size(x, y) for either side, make CELLS pairs of values at most, or single rows."""

    def parts(x: dict, y: dict) -> dict:
        n, m = size(x, y)
        a, b = max(len(n), int(n.sum())), max(len(m), int(m.sum()))
        if a * b <= CELLS or len(n) == len(m) == 1:
            return score(x, y)
        axis = 0 if len(m) == 1 or (len(n) > 1 and a >= b) else 1
        half = len((n, m)[axis]) // 2
        cut = [{c: v.slice(*s) for c, v in (x, y)[axis].items()} for s in ((0, half), (half,))]
        got = [parts(*((k, y) if axis == 0 else (x, k))) for k in cut]
        return {c: tuple(np.concatenate(v, axis) for v in zip(*(g[c] for g in got), strict=True)) for c in got[0]}

    return parts


def _facts(lists: pa.Array) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Different number_facts() of all lists as lists of their fields, which of these the lists have, and how many each. All follows from
    raw."""
    flat = lists.flatten()
    fields = {f.name: v for f, v in zip(flat.type, flat.flatten(), strict=True)}
    coded = fields["raw"].dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    first = pa.array(np.unique(at, return_index=True)[1])
    return tuple(fields[c].take(first).to_pylist() for c in ("raw", "can", "plain", "digits")), at, _sizes(lists)


def _relations(x: tuple, y: tuple) -> np.ndarray:
    """functions.text.number_relation() of different number_facts()."""
    (raw, can, plain, digits), (raw2, can2, plain2, digits2) = x, y
    a, b = (list(dict.fromkeys(v)) for v in (can, can2))
    at = np.ix_(*(np.array([*map({s: k for k, s in enumerate(u)}.get, v)], np.int64) for u, v in ((a, can), (b, can2))))
    out = np.where(_edits(a, b), np.uint8(4), np.uint8(5))[at]
    both = np.outer(np.array(plain, bool), np.array(plain2, bool))
    out[~both & _equals(digits, digits2)] = 3
    out[both & (_cuts(raw, raw2) | _cuts(a, b)[at])] = 2
    out[_equals(can, can2)] = 1
    return out


def _numbers_of_lists(x: dict, y: dict) -> dict:
    (p, i, n), (q, j, m) = _facts(x["a_n"]), _facts(y["b_n"])
    shape = (len(n), len(m))
    related, no = np.zeros(shape, np.int64), (n == 0)[:, None] | (m == 0)[None, :]
    missed, extra, alpha = (np.zeros(shape, np.int64) for _ in range(3))
    if len(i) and len(j):
        rel = _relations(p, q)
        related = rel[_firsts(i, n)][:, _firsts(j, m)].astype(np.int64)
        near, letters = rel <= 3, ~np.array(q[2], bool)
        missed = _of_lists(~_of_lists(near, j, m, np.logical_or, 1, bool), i, n, np.add, 0, np.int64)
        lone = ~_of_lists(near, i, n, np.logical_or, 0, bool)
        extra = _of_lists(lone, j, m, np.add, 1, np.int64)
        alpha = _of_lists(lone & letters[None, :], j, m, np.add, 1, np.int64) if letters.any() else alpha
    some = np.zeros(shape, bool)
    of = {"anum_n_q": np.broadcast_to(n[:, None], shape), "anum_n_c": np.broadcast_to(m[None, :], shape), "anum_first_rel": related, "anum_q_miss": missed, "anum_c_extra": extra, "anum_c_alpha_extra": alpha}
    return {c: (v, some if c in ("anum_n_q", "anum_n_c") else no) for c, v in of.items()}


#: collective.numbers() of number_facts() a_n and b_n.
numbers = listed(_numbers_of_lists, lambda x, y: (_sizes(x["a_n"]), _sizes(y["b_n"])))


def _bare(values: pa.Array) -> tuple[pa.Array, pa.Array]:
    """first and bare of digits()."""
    fields = {f.name: v for f, v in zip(values.type, values.flatten(), strict=True)}
    return fields["first"], fields["bare"]


def _digits_of_lists(x: dict, y: dict) -> dict:
    (first, p), (other, q) = _bare(x["a_n"]), _bare(y["b_n"])
    (p, i), n, (q, j), m = _different(p.flatten()), _sizes(p), _different(q.flatten()), _sizes(q)
    shape = (len(n), len(m))
    none = np.zeros(shape, bool)
    same, jaccard, best, begin = np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape), np.zeros(shape)
    if len(i) and len(j):
        some, equal = (n > 0)[:, None] & (m > 0)[None, :], _equals(p, q)
        like = np.zeros(equal.shape, np.uint8)  # how alike: 1 by an edit, 2 cut, 3 equal
        like[_edits(p, q)] = 1
        like[_cuts(p, q)] = 2
        like[equal] = 3
        level = np.array([0.0, 0.6, 0.8, 1.0])
        most = _of_lists(like, j, m, np.maximum, 1, np.uint8)
        begin = np.where(some, level[most[_firsts(i, n)]], 0.0)
        best = level[_of_lists(most, i, n, np.maximum, 0, np.uint8)]
        same = (some & ~_differ(*_codes(first, other))).astype(np.int64)
        if equal.any():
            both = _of_lists(_of_lists(equal, j, m, np.add, 1, np.int64), i, n, np.add, 0, np.int64)
            at = np.nonzero(both)
            shares, of = np.unique(both[at] / (n[at[0]] + m[at[1]] - both[at]), return_inverse=True)
            jaccard[at] = np.array([float(Decimal(repr(float(s))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for s in shares])[of]
    return {c: (v, none) for c, v in (("dig_first_eq", same), ("digz_jaccard", jaccard), ("digz_best_sim", best), ("digz_first_sim", begin))}


#: similarity.canonical_digits() of digits() a_n and b_n.
digits = listed(_digits_of_lists, lambda x, y: (_sizes(_bare(x["a_n"])[1]), _sizes(_bare(y["b_n"])[1])))
