"""Words of whole Arrow string columns and their hashes, on the UTF-8 bytes and without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: The primes and bases of the window hashes, an odd multiplier that tells words' lengths apart, and one that spreads words.
PRIMES, BASES = (2147483647, 2147483629, 65521), (1812433253, 1099087573, 40503)
LENGTH, SPREAD = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
#: Bytes or words that are worked on at once, and places in a word whose bytes' values are kept in a table.
SLICE, PLACES = 1 << 17, 64


def powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, prime)) % np.uint64(prime)
        k *= 2
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on all bits of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo its prime, SLICE of each."""
    if k not in _tables:
        base, prime = BASES[k], PRIMES[k]
        _tables[k] = powers(base, SLICE, prime), powers(pow(base, -1, prime), SLICE, prime)
    return _tables[k]


#: A value for each byte at each of the first places in a word.
_values = mixed(np.arange(1, (PLACES << 8) + 1, dtype=np.uint64))


def valued(places: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A value of a byte at its place in a word; the values of different (place, byte) have nothing to do with each other."""
    code = (places << 8) | data
    return _values[code] if not len(code) or code.max() < len(_values) else mixed(code.astype(np.uint64) + np.uint64(1))


class Words:
    """data: the column's bytes; offsets: where its texts begin; start, end: of each word; doc: its text's number."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("")
        if pa.types.is_large_string(column.type):
            width = "<i8"
        else:
            width = "<i4"
        n, (_, at, data) = len(column), column.buffers()
        self.offsets = np.frombuffer(at, width, n + 1, column.offset * np.dtype(width).itemsize).astype(np.int64) if at is not None else np.zeros(n + 1, np.int64)
        first, last = int(self.offsets[0]), int(self.offsets[-1])
        self.data = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
        self.offsets -= first
        inside = (self.data != 32) & ((self.data < 9) | (self.data > 13))
        some = self.offsets[:-1] < self.offsets[1:]
        begins, stops = np.empty_like(inside), np.empty_like(inside)
        begins[1:], stops[:-1] = ~inside[:-1], ~inside[1:]
        begins[self.offsets[:-1][some]] = True
        stops[self.offsets[1:][some] - 1] = True
        self.start = np.flatnonzero(inside & begins)
        self.end = np.flatnonzero(inside & stops) + 1
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.counts = np.bincount(self.doc, minlength=n)

    def hashes(self) -> np.ndarray:
        """A mixed sum of the values of each word's bytes at their places and of its length."""
        out, k, n = np.empty(len(self.start), np.uint64), 0, len(self.start)
        while k < n:
            base = int(self.start[k])
            stop = max(k + 1, int(np.searchsorted(self.end, base + SLICE, "right")))
            s, e = self.start[k:stop], self.end[k:stop]
            sizes = e - s
            if stop == k + 1 and sizes[0] > SLICE:  # one word, in parts
                sums = np.zeros(1, np.uint64)
                for at in range(0, int(sizes[0]), SLICE):
                    part = self.data[base + at : min(base + at + SLICE, int(e[0]))]
                    sums += valued(np.arange(at, at + len(part)), part).sum(dtype=np.uint64)
            else:
                first = np.cumsum(sizes) - sizes
                places = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
                sums = np.add.reduceat(valued(places, self.data[np.repeat(s, sizes) + places]), first)
            out[k:stop] = mixed(sums + sizes.astype(np.uint64) * np.uint64(LENGTH))
            k = stop
        return out

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, hash of 62 bits, check of 16 bits) of every run of length words inside one text. These are three Rabin-Karp
        hashes, modulo two primes below 2^31 and one below 2^16, over different parts of the words' hashes; equal runs have equal ones."""
        h = self.hashes()
        n = len(h) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint16)
        low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
        parts, out = (low, high, (h * np.uint64(SPREAD)) >> np.uint64(32)), []
        for k, prime in enumerate(map(np.uint64, PRIMES)):
            up, down = _table(k)
            found = np.empty(n, np.uint64)
            for a in range(0, n, SLICE - length):
                part = parts[k][a : a + SLICE] % prime
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(part * up[: len(part)] % prime, out=sums[1:])
                m = len(part) - length + 1
                found[a : a + m] = (sums[length:] - sums[:m]) % prime * down[:m] % prime
            out.append(found)
        at = np.flatnonzero(self.doc[:n] == self.doc[length - 1 :])
        return at, (out[0][at] << np.uint64(31)) | out[1][at], out[2][at].astype(np.uint16)
