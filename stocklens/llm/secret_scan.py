"""Operator 4: find secrets by patterns and by tests of randomness.

Patterns find keys with a known shape. For other tokens an encoding is
inferred, and three tests ask whether the token could be drawn uniformly from
its alphabet: chi-squared of the symbol counts, runs above and below the
middle, and serial correlation. The smallest of the three p-values, corrected
for three tests, is the token's p-value.

Ordinary text fails these tests. Which tokens fail is decided for the whole
corpus by false-discovery control (Benjamini and Hochberg) within groups of
like encoding and length, since short tokens can hardly fail and long ones
easily. Tokens that do not fail are taken for random and reported. P-values are
counted in a fixed number of bins per group; that table has a bound, and only
it reaches the driver. Everything runs in built-in functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.sources.scratch import materialized

# Fixed patterns; value lengths are checked apart, as a failing match is used up.
_WORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = (
    "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS)
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
#: Tokens whose randomness is tested.
TOKEN = "[A-Za-z0-9+/_-]{20,}"

KINDS = ("assign", "access", "hex", "random")

#: Symbols of each encoding in order, with the pattern that infers it; the first that fits.
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]*[2-7][A-Z2-7]*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^((?=[a-z]*[0-9])[0-9a-z]+|(?=[A-Z]*[0-9])[0-9A-Z]+)$",
     "0123456789abcdefghijklmnopqrstuvwxyz"),
    # Fewer letters of one case do not tell a key from text: half of the words made of the twelve
    # most frequent letters pass as random with 24 letters, a tenth with 32.
    ("letters", "^([a-z]{32,}|[A-Z]{32,})$", "abcdefghijklmnopqrstuvwxyz"),
    ("base64", "^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)

#: Encodings in one case, either of them; their symbols are listed in lower case.
_ONE_CASE = tuple(i for i, (name, _, _) in enumerate(ENCODINGS)
                  if name in ("hex", "base36", "letters"))

#: Share of false discoveries among the tokens found to be ordinary text.
FALSE_SHARE = 0.01
#: Bins per power of ten of the p-values, and powers that are told apart.
FINE, POWERS = 4, 20


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Places (start, end) of the pattern's matches whose group has ``least`` characters.

    Matches do not overlap, from the left. The text between them is split off,
    so their places are sums of lengths.
    """
    spans = "array<struct<start:int,end:int>>"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)

    def step(state: Column, found: Column) -> Column:
        start = state["at"] + F.char_length(found["before"])
        end = start + F.char_length(found["match"])
        keep = F.char_length(found["value"]) >= least
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"),
            F.when(keep, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"),
        )

    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.arrays_zip(whole.alias("match"), value.alias("value"))
    placed = _let(F.struct(found.alias("f"), parts.alias("p")), lambda x: F.transform(
        x["f"], lambda m, i: F.struct(
            m["match"].alias("match"), m["value"].alias("value"), x["p"][i].alias("before"))))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(placed, empty, step)["out"]).otherwise(
        F.array().cast(spans))


def upper_tail(z: Column) -> Column:
    """Chance that a standard normal value exceeds ``z`` (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (
        1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = series * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _encoding(token: Column) -> Column:
    out = F.lit(len(ENCODINGS) - 1)
    for i, (_, pattern, _) in list(enumerate(ENCODINGS))[-2::-1]:
        out = F.when(token.rlike(pattern), i).otherwise(out)
    return out


def _codes(token: Column, encoding: Column) -> Column:
    """Each symbol's number in the alphabet."""
    alphabets = F.array(*[F.lit(symbols) for _, _, symbols in ENCODINGS])
    plain = F.when(encoding.isin(*_ONE_CASE), F.lower(token)).otherwise(F.translate(token, "-_", "+/"))
    symbols = F.regexp_extract_all(plain, F.lit("."), F.lit(0))
    return _let(F.element_at(alphabets, encoding + 1), lambda alphabet: F.transform(
        symbols, lambda c: F.call_function("instr", alphabet, c) - 1))


def chi_squared(codes: Column, n: Column, size: Column) -> Column:
    """Normal score (Wilson and Hilferty) of the symbol counts against equal counts."""
    squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda total, c: total + F.pow(
        F.size(F.filter(codes, lambda x: x == c)), F.lit(2)))
    free = size - 1
    value = squares * size / n - n
    share = 2 / (9 * free)
    return (F.cbrt(F.greatest(value, F.lit(0.0)) / free) - (1 - share)) / F.sqrt(share)


def runs_score(codes: Column, n: Column, size: Column) -> Column:
    """Score of the number of runs in the lower and the upper half of the alphabet."""
    high = F.aggregate(codes, F.lit(0), lambda a, c: a + (c * 2 >= size).cast("int"))
    changes = F.aggregate(
        F.slice(codes, F.lit(2), F.size(codes)),
        F.struct(F.lit(0).alias("n"), F.element_at(codes, 1).alias("last")),
        lambda a, c: F.struct(
            (a["n"] + ((c * 2 >= size) != (a["last"] * 2 >= size)).cast("int")).alias("n"),
            c.alias("last")),
    )["n"]

    def score(h: Column) -> Column:
        both = 2.0 * h * (n - h)
        mean = both / n + 1
        spread = both * (both - n) / (n * n * (n - 1))
        return F.when(spread > 0, (changes + 1 - mean) / F.sqrt(spread)).otherwise(
            F.lit(float(POWERS)))

    return _let(high, score)


def serial_score(codes: Column, n: Column) -> Column:
    """Score of the correlation of neighbours."""
    moved = F.zip_with(
        F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes)),
        lambda a, b: (a * b).cast("double"))
    total = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c)
    squares = F.aggregate(codes, F.lit(0.0), lambda a, c: a + c * c)
    products = F.aggregate(moved, F.lit(0.0), lambda a, c: a + c)

    def score(s: Column) -> Column:
        mean = s["total"] / n
        spread = s["squares"] / n - mean * mean
        shared = s["products"] / (n - 1) - mean * mean
        return F.when(spread > 0, shared / spread * F.sqrt(n)).otherwise(F.lit(float(POWERS)))

    return _let(F.struct(total.alias("total"), squares.alias("squares"),
                         products.alias("products")), score)


def tested(text: Column) -> Column:
    """start, end, group and p-value bin of every token of a text.

    The group is the encoding and the power of two of the length. Bin ``b``
    holds p-values in (10^-((b+1)/FINE), 10^-(b/FINE)].
    """
    sizes = F.array(*[F.lit(float(len(symbols))) for _, _, symbols in ENCODINGS])

    def judge(x: Column) -> Column:
        codes, n, size = x["codes"], x["n"], x["size"]
        smallest = F.least(
            upper_tail(chi_squared(codes, n, size)),
            2 * upper_tail(F.abs(runs_score(codes, n, size))),
            2 * upper_tail(F.abs(serial_score(codes, n))),
        )
        p = F.greatest(F.least(3 * smallest, F.lit(1.0)), F.lit(10.0**-POWERS))
        band = F.floor(F.log2(n)).cast("int")
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"),
            (x["encoding"] * 64 + band).alias("group"),
            F.floor(-F.log10(p) * FINE).cast("int").alias("bin"),
        )

    def coded(span: Column) -> Column:
        token = F.substring(text, span["start"] + 1, span["end"] - span["start"])
        return _let(token, lambda t: _let(_encoding(t), lambda e: F.struct(
            span["start"].alias("start"), span["end"].alias("end"), e.alias("encoding"),
            _codes(t, e).alias("codes"), F.char_length(t).cast("double").alias("n"),
            F.element_at(sizes, e + 1).alias("size"))))

    return F.transform(matches(text, TOKEN, 0, 0), lambda span: _let(coded(span), judge))


def thresholds(bins: DataFrame, false_share: float = FALSE_SHARE) -> dict[int, int]:
    """Group -> smallest bin whose tokens fail the tests; groups where none fails are left out.

    ``bins`` has group, bin and count. With ``k`` of a group's ``m`` p-values at
    or below a bin's upper end, the bin fails if that end is at most
    ``false_share * k / m``.
    """
    rows = bins.select("group", "bin", "count").collect()  # groups x bins: bounded
    counts: dict[int, dict[int, int]] = {}
    for group, bin_, count in rows:
        counts.setdefault(group, {})[bin_] = count
    out = {}
    for group, by_bin in counts.items():
        total, seen = sum(by_bin.values()), 0
        for bin_ in sorted(by_bin, reverse=True):
            seen += by_bin[bin_]
            if 10 ** (-bin_ / FINE) <= false_share * seen / total:
                out[group] = bin_
    return out


def scan_secrets(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """doc_id and the spans (start, end in code points) of each kind, one row per row.

    ``assign``, ``access`` and ``hex`` are pattern matches, ``random`` tokens
    that pass the tests and touch no match. Whole texts are read; null is the
    empty text. Without tokens nothing is random.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        "doc_id",
        matches(text, ASSIGN, 2, 12).alias("assign"),
        matches(text, ACCESS, 0, 18).alias("access"),
        matches(text, HEX, 0, 16).alias("hex"),
        tested(text).alias("tokens"),
    )
    found = materialized(found, "secrets")
    limits = thresholds(
        found.select(F.explode("tokens").alias("t")).groupBy("t.group", "t.bin").count(),
        false_share)
    by_group = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else (
        F.create_map().cast("map<int,int>"))
    base = F.concat("assign", "access", "hex")
    passing = F.filter("tokens", lambda t: (
        t["bin"] < F.coalesce(F.try_element_at(by_group, t["group"]), F.lit(10_000))
    ) & ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return found.select(
        "doc_id", "assign", "access", "hex",
        F.transform(passing, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
        .alias("random"))


def span_list(kinds: tuple[str, ...]) -> Column:
    """The spans as kind:start:end, by start and then kind, comma-joined."""
    def placed(number: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))

    every = F.concat(*[placed(i, kind) for i, kind in enumerate(kinds)])
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
        s["end"].cast("string"))), ",")
