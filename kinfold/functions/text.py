"""Text rules as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that mean nothing.
NULL_TOKENS = ("null", "na", "nan", "none", "nil", "unknown", "n a")
#: Letters that do not decompose, the look-alike digits and the consonant classes of skeletons.
EXPANSIONS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("đ", "d"), ("ł", "l"))
LOOKALIKE_DIGITS, LOOKALIKE_LETTERS = "0158634729", "olsbgeatzg"
SKELETON_FROM, SKELETON_TO = "bcdgjqvwxzaeiouyh", "pktkkkffks"


_SOUNDS = {ord(c): SKELETON_TO[k] if k < len(SKELETON_TO) else None for k, c in enumerate(SKELETON_FROM)}


def _accents() -> tuple[str, str]:
    """Accented Latin letters and the ASCII letters that they decompose to."""
    pairs = [(c, d[0]) for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower-cased, accents off; null is empty. Other scripts stay, and so turn to spaces in normalize()."""
    out = F.translate(F.lower(F.coalesce(text, F.lit(""))), *_accents())
    for a, b in EXPANSIONS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(text), "[^0-9a-z]+", " "))


def tokens(text: Column) -> Column:
    """The words of a normalised text; none for the empty one."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def meaningful(words: Column) -> Column:
    return F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(*NULL_TOKENS))


def numeric(words: Column) -> Column:
    return F.filter(words, lambda t: t.rlike("^[0-9]+$"))


def alphabetic(words: Column) -> Column:
    return F.filter(words, lambda t: ~t.rlike("^[0-9]+$"))


def skeleton(token: Column) -> Column:
    """Sound classes of a token: digits stay, ph is f, vowels and y, h go, classes of consonants are one, repeats collapse."""
    sound = F.translate(F.replace(token, F.lit("ph"), F.lit("f")), SKELETON_FROM, SKELETON_TO)
    return F.when(token.rlike("^[0-9]+$"), token).otherwise(F.regexp_replace(sound, r"(.)\1+", "$1"))


def sound(token: str) -> str:
    """skeleton() of one token, for functions that run in Python."""
    if token.isdigit():
        return token
    classes = token.replace("ph", "f").translate(_SOUNDS)
    return "".join(c for k, c in enumerate(classes) if k == 0 or c != classes[k - 1])


def skeletons(words: Column) -> Column:
    """Skeletons of two letters at least, of words that are neither numbers nor empty in meaning."""
    own = F.filter(alphabetic(words), lambda t: ~t.isin(*NULL_TOKENS))
    return F.filter(F.transform(own, skeleton), lambda t: F.length(t) > 1)


def canonical(number: Column) -> Column:
    out = F.ltrim(number, F.lit("0"))
    return F.when(out == "", "0").otherwise(out)


def first_number(words: Column) -> Column:
    return canonical(F.get(numeric(words), 0))


def number_similarity(a: Column, b: Column) -> Column:
    """1 equal; 0.8 one digit lost at an end; 0.6 one edit; else 0."""
    low, high = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    off = F.abs(F.length(a) - F.length(b))
    return F.when(a == b, 1.0).when((off == 1) & (F.startswith(high, low) | F.endswith(high, low)), 0.8).when((off <= 1) & (F.levenshtein(a, b) <= 1), 0.6).otherwise(0.0)


def number_tokens(words: Column) -> Column:
    """(raw, canonical) of every token with a digit; an ordinal's ending goes."""

    def one(t: Column) -> Column:
        raw = F.when(t.rlike("^[0-9]+(st|nd|rd|th)$"), F.substring(t, F.lit(1), F.length(t) - 2)).otherwise(t)
        bare = F.ltrim(raw, F.lit("0"))
        kept = F.when(bare == "", "0").when(~bare.rlike("^[0-9]") & F.startswith(raw, F.lit("0")), F.concat(F.lit("0"), bare)).otherwise(bare)
        return F.struct(raw.alias("raw"), kept.alias("can"))

    return F.transform(F.filter(words, lambda t: t.rlike("[0-9]") & ~t.isin(*NULL_TOKENS)), one)


def number_facts(words: Column) -> Column:
    """number_tokens() with what number_relation() compares: whether all are digits, and the digits alone."""
    return F.transform(number_tokens(words), lambda t: F.struct(t["raw"].alias("raw"), t["can"].alias("can"), t["can"].rlike("^[0-9]+$").alias("plain"), F.regexp_replace(t["can"], "[^0-9]", "").alias("digits")))


def number_relation(x: Column, y: Column) -> Column:
    """1 equal, 2 truncated, 3 same digits, 4 one edit, 5 conflict, of two of number_facts()."""

    def cut(a: Column, b: Column) -> Column:
        low, high = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
        return (F.abs(F.length(a) - F.length(b)) == 1) & (F.startswith(high, low) | F.endswith(high, low))

    xc, yc = x["can"], y["can"]
    plain = x["plain"] & y["plain"]
    near = (F.abs(F.length(xc) - F.length(yc)) <= 1) & (F.levenshtein(xc, yc) <= 1)
    return F.when(xc == yc, 1).when(plain & (cut(x["raw"], y["raw"]) | cut(xc, yc)), 2).when(~plain & (x["digits"] == y["digits"]), 3).when(near, 4).otherwise(5)


def address_key(words: Column) -> Column:
    """First canonical number, a bar, and the two longest words of three letters at least, in alphabetical order."""
    words = F.filter(words, lambda t: ~t.isin(*NULL_TOKENS))
    long = F.filter(F.array_distinct(words), lambda t: t.rlike("^[a-z]+$") & (F.length(t) >= 3))
    by = F.array_sort(F.transform(long, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    two = F.array_sort(F.transform(F.slice(by, 1, 2), lambda s: s["t"]))
    number = F.coalesce(first_number(words), F.lit(""))
    return F.when((number == "") & (F.size(two) == 0), "").otherwise(F.concat(number, F.lit("|"), F.array_join(two, " ")))


def lowered(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def lookalike(token: Column) -> Column:
    return F.translate(F.translate(token, LOOKALIKE_DIGITS, LOOKALIKE_LETTERS), "i", "l")


def edit_class(q: Column, c: Column) -> Column:
    """0 look-alike, 1 anagram, 2 ending added, 3 ending dropped, 4 one letter replaced, 5 other."""

    def letters(t: Column) -> Column:
        return F.array_sort(F.split(t, ""))

    a, b = lookalike(q), lookalike(c)
    off = F.length(c) - F.length(q)
    changed = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return F.when(a == b, 0).when(letters(q) == letters(c), 1).when(F.startswith(c, q) & off.between(1, 3), 2).when(F.startswith(q, c) & off.between(-3, -1), 3).when((off == 0) & (changed == 1), 4).otherwise(5)


def trigrams(words: Column) -> Column:
    """The set of three-letter runs of each word between hashes."""
    marked = F.concat(F.lit("#"), F.array_join(F.array_distinct(words), "# #"), F.lit("#"))
    return F.array_distinct(F.regexp_extract_all(marked, F.lit("(?=([^ ]{3}))"), F.lit(1)))


def translated(text: Column, dictionary: Column) -> Column:
    """Words of a text replaced by a map's values; others stay."""
    return F.array_join(F.transform(tokens(text), lambda t: F.coalesce(F.try_element_at(dictionary, t), t)), " ")


def script(text: Column) -> Column:
    """The script of the first letter."""
    first = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\p{L})", 1)
    out = F.when(first == "", "NONE")
    for name in ("Latin", "Greek", "Cyrillic", "Arabic", "Hebrew", "Devanagari", "Tamil", "Telugu", "Bengali", "Han", "Hiragana", "Katakana", "Hangul", "Thai"):
        out = out.when(first.rlike(rf"\p{{Is{name}}}"), name.upper())
    return out.otherwise("OTHER")


def side(name: Column, address: Column) -> Column:
    return F.concat_ws(" | ", F.nullif(name, F.lit("")), F.nullif(address, F.lit("")))


def bigrams(words: Column, tag: str) -> Column:
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(F.lit(tag), a, F.lit("_"), b))
    return F.when(n > 1, pairs).otherwise(F.array().cast("array<string>"))


def _tagged(words: Column, tag: str) -> Column:
    return F.transform(words, lambda t: F.concat(F.lit(tag), t))


def terms(name: Column, address: Column) -> Column:
    """The set of a record's namespaced terms, of its name's and its address's words."""
    n, a = meaningful(name), meaningful(address)
    ks, aks = skeletons(n), skeletons(a)
    joined, sounds = F.array_join(n, ""), F.array_join(ks, "")
    none = F.array().cast("array<string>")
    parts = [
        _tagged(n, "n:"), bigrams(n, "nb:"), F.when(F.length(joined) >= 4, F.array(F.concat(F.lit("nc:"), F.substring(joined, 1, 10)))).otherwise(none),
        _tagged(alphabetic(a), "a:"), _tagged(numeric(a), "d:"), bigrams(a, "ab:"),
        _tagged(ks, "k:"), bigrams(ks, "kb:"), F.when(sounds != "", F.array(F.concat(F.lit("kc:"), F.substring(sounds, 1, 8)))).otherwise(none), _tagged(aks, "ak:"),
    ]
    return F.array_distinct(F.concat(*parts))


def record_keys(name: Column, address: Column) -> Column:
    """T|skeleton|number for the name's skeletons and the first two numbers of the address, N|skeleton|skeleton for neighbours."""
    ks = skeletons(name)
    numbers = F.slice(F.array_distinct(F.transform(numeric(address), canonical)), 1, 2)
    typed = F.flatten(F.transform(F.array_distinct(ks), lambda k: F.transform(numbers, lambda d: F.concat(F.lit("T|"), k, F.lit("|"), d))))
    near = F.zip_with(F.slice(ks, 1, F.greatest(F.size(ks) - 1, F.lit(0))), F.slice(ks, 2, F.greatest(F.size(ks) - 1, F.lit(0))), lambda a, b: F.concat(F.lit("N|"), a, F.lit("|"), b))
    return F.array_distinct(F.concat(typed, F.when(F.size(ks) > 1, near).otherwise(F.array().cast("array<string>"))))


def key_hash(key: Column) -> Column:
    """A key as one signed 64-bit number of two checksums, of its bytes forwards and backwards. Flipping the highest bit takes 2^63 off."""
    return F.shiftleft(F.crc32(key), 32).bitwiseOR(F.crc32(F.reverse(key))).bitwiseXOR(F.lit(-(1 << 63)))


def pair_hash(s1: Column, cand: Column) -> Column:
    return F.xxhash64(s1, cand)


def house_number(number: Column) -> tuple[Column, Column]:
    """The leading digits of a house number (digits and an optional letter), as written and as a number."""
    digits = F.regexp_extract(number, "^([0-9]{1,11})", 1)
    return digits, digits.try_cast("long")


def neighbour_number(a: Column, b: Column, x: tuple[Column, Column] | None = None, y: tuple[Column, Column] | None = None) -> Column:
    """1 if two house numbers (digits and an optional letter) are at most four apart or differ in the letter alone, 0 if not, NULL if one is
    missing. x and y are their house_number(), where that is at hand."""
    (p, m), (q, n) = x or house_number(a), y or house_number(b)
    near = F.coalesce(F.abs(m - n).between(1, 4), F.lit(False)) | ((p != "") & (p == q) & (a != b))
    return F.when(a.isNull() | b.isNull(), None).otherwise(near.cast("double"))


def safe_name(text: Column) -> Column:
    """A block's name as part of a path: runs of other characters than ASCII letters and digits are one underscore."""
    out = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.when(out == "", "UNK").otherwise(out)


def grams(text: Column, n: int, tag: str) -> Column:
    """Runs of n letters, tagged."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.concat(F.lit(tag), F.substring(text, i, F.lit(n))))
    return F.when(F.length(text) >= n, each).otherwise(F.array().cast("array<string>"))


def blob(name: Column, address: Column) -> Column:
    """Three-letter runs of the joined skeletons, four-letter runs of the joined name, and the address's canonical numbers."""
    return F.concat(grams(F.array_join(skeletons(name), ""), 3, "g:"), grams(F.array_join(name, ""), 4, "h:"), F.transform(numeric(address), lambda d: F.concat(F.lit("d:"), canonical(d))))


def pair_key(s1: Column, cand: Column, offset: int = 10_000_000_000) -> Column:
    """A pair of codes as one decimal number: the first's number, then the second's in ten digits."""
    return (s1 % offset).cast("decimal(38,0)") * F.lit(offset) + cand % offset
