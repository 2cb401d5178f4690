"""Secrets in texts: known forms, and tokens that pass a battery of randomness tests.

Everything here is a column of built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm import tables

# fixed values: the forms that are looked for, in this order
KINDS = ("assign", "access", "hex", "random")
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGNED = 6

TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
# alphabets of encodings, the smallest that has all characters of a token is taken
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("decimal", "[0-9]+", _DIGITS),
    ("hex", "[0-9a-f]+", _DIGITS + "abcdef"),
    ("hex upper", "[0-9A-F]+", _DIGITS + "ABCDEF"),
    ("lower", "[a-z]+", _LOWER),
    ("upper", "[A-Z]+", _UPPER),
    ("base32", "[A-Z2-7]+", _UPPER + "234567"),
    ("lower digits", "[a-z0-9]+", _DIGITS + _LOWER),
    ("upper digits", "[A-Z0-9]+", _DIGITS + _UPPER),
    ("letters", "[A-Za-z]+", _UPPER + _LOWER),
    ("base62", "[A-Za-z0-9]+", _UPPER + _LOWER + _DIGITS),
    ("base64", "[A-Za-z0-9+/]+", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64 url", "[A-Za-z0-9_-]+", _UPPER + _LOWER + _DIGITS + "-_"),
    ("mixed", ".+", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
FALSE_DISCOVERIES = 0.05
CONSISTENT = 0.01
_BANDS = 24
_PRIOR_ROWS = 10.0
_STEPS = 20  # bins per power of ten of a p-value
_BINS = 400


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _sum(values: Column, kind: str = "double") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))


def _short_running(values: Column) -> Column:
    """Sums before each value, of a short array."""
    zero = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("before"))
    return F.aggregate(
        values,
        zero,
        lambda a, x: F.struct(
            (a["total"] + x).alias("total"), F.concat(a["before"], F.array(a["total"])).alias("before")
        ),
        lambda a: a["before"],
    )


def _running(values: Column, step: int = 128) -> Column:
    """Sums before each value: within blocks, and of the blocks before.

    Arrays only grow by copying, so a long one is summed in blocks.
    """

    def blocks(v: Column) -> Column:
        last = F.greatest(F.ceil(F.size(v) / step) - 1, F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(v, i * step + 1, step))

    def sums(b: Column) -> Column:
        return _let(
            _short_running(F.transform(b, lambda x: _sum(x, "int"))),
            lambda before: F.flatten(
                F.transform(b, lambda x, i: F.transform(_short_running(x), lambda y: y + F.get(before, i)))
            ),
        )

    return _let(values, lambda v: _let(blocks(v), sums))


def _found(text: Column, pattern: str, kind: str) -> Column:
    """Matches as (start, end, kind, found): code points, leftmost, not overlapping.

    The parts between the matches and the matches follow one another, so the places
    are sums of their lengths.
    """
    none = F.array().cast("array<struct<start:int,end:int,kind:string,found:string>>")
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(
        gaps,
        hits,
        lambda g, h: F.struct(
            F.length(g).alias("gap"), F.coalesce(F.length(h), F.lit(0)).alias("length"), h.alias("found")
        ),
    )

    def placed(p: Column) -> Column:
        return F.zip_with(
            _running(F.transform(p, lambda x: x["gap"] + x["length"])),
            p,
            lambda before, x: F.struct(
                (before + x["gap"]).alias("start"),
                (before + x["gap"] + x["length"]).alias("end"),
                F.lit(kind).alias("kind"),
                x["found"].alias("found"),
            ),
        )

    return F.when(
        text.rlike(pattern), F.filter(_let(parts, placed), lambda x: x["found"].isNotNull())
    ).otherwise(none)


def _base(text: Column) -> Column:
    """Spans of the known forms by start, then kind."""
    assigned = F.filter(
        _found(text, ASSIGN, "assign"),
        lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 1)) >= ASSIGNED,
    )
    every = F.concat(assigned, _found(text, ACCESS, "access"), _found(text, HEX, "hex"))
    return _ordered(every)


def _ordered(spans: Column) -> Column:
    place = lambda s: s["start"] * 8 + F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int")
    return F.array_sort(spans, lambda a, b: place(a) - place(b))


def _candidates(text: Column, base: Column) -> Column:
    """Long tokens that touch no span of a known form."""
    return _let(
        base,
        lambda base: F.filter(
            _found(text, TOKEN, "random"),
            lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
        ),
    )


def _normal(z: Column) -> Column:
    """The normal distribution, by a logistic curve (within 0.00015)."""
    return _let(z, lambda z: 1 / (1 + F.exp(-z * (1.5976 + 0.070565992 * z * z))))


def _floored(p: Column) -> Column:
    return F.greatest(p, F.lit(1e-15))


def battery(token: Column) -> Column:
    """length, statistic and p of a token under "characters drawn at random".

    The alphabet is that of the smallest encoding that holds the token. Three tests:
    chi-squared of the counts against the uniform distribution (upper side), runs of
    upper and lower halves of the alphabet, and correlation of neighbours (both
    sides). `p` joins them by Fisher's method; `statistic` is the logarithm of
    Fisher's sum.
    """
    alphabet = reduce(
        lambda rest, e: F.when(token.rlike(f"^{e[1]}$"), F.lit(e[2])).otherwise(rest),
        reversed(ENCODINGS[:-1]),
        F.lit(ENCODINGS[-1][2]),
    )
    n, size = F.length(token).cast("double"), F.length(alphabet).cast("double")
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    # each is computed once: a column named twice in a lambda is computed twice
    return _let(
        F.struct(n.alias("n"), size.alias("size"), alphabet.alias("alphabet"), chars.alias("chars")),
        lambda t: _let(
            F.transform(t["chars"], lambda c: F.instr(t["alphabet"], c).cast("double")),
            lambda v: _tests(token, t["chars"], t["n"], t["size"], v),
        ),
    )


def _tests(token: Column, chars: Column, n: Column, size: Column, v: Column) -> Column:
    """The battery's struct; v are the places of the characters in the alphabet."""
    # the length without a character tells its count
    squares = _sum(
        F.transform(F.array_distinct(chars), lambda c: F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    )
    uniform = 1 - _normal((size / n * squares - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n))
    halves = F.transform(v, lambda x: (2 * x > size).cast("double"))

    def neighbours(values: Column, then: Callable[[Column, Column], Column]) -> Column:
        rest = F.slice(values, F.lit(2), (n - 1).cast("int"))
        return _sum(F.zip_with(F.slice(values, F.lit(1), (n - 1).cast("int")), rest, then))

    def two_sided(z: Column) -> Column:
        return 2 * (1 - _normal(F.abs(z)))

    def correlation(m: Column) -> Column:
        scatter = _sum(F.transform(v, lambda x: (x - m) * (x - m)))
        product = neighbours(v, lambda a, b: (a - m) * (b - m))
        return _let(
            scatter, lambda s: F.when(s > 0, (product / s + 1 / n) * F.sqrt(n)).otherwise(F.lit(30.0))
        )

    def turning(h: Column) -> Column:
        turns = 1 + neighbours(h, lambda a, b: (a != b).cast("double"))

        def of_spread(both: Column) -> Column:
            spread = both * (both - n) / (n * n * (n - 1))
            return F.when(spread > 0, (turns - both / n - 1) / F.sqrt(spread)).otherwise(F.lit(0.0))

        return _let(_sum(h), lambda upper: _let(2 * upper * (n - upper), of_spread))

    serial, runs = _let(_sum(v) / n, correlation), _let(halves, turning)
    half = -(F.log(_floored(uniform)) + F.log(_floored(two_sided(runs))) + F.log(_floored(two_sided(serial))))
    return _let(
        half,
        lambda h: F.struct(
            n.cast("int").alias("length"),
            F.log(2 * h + 1e-9).alias("statistic"),
            (F.exp(-h) * (1 + h + h * h / 2)).alias("p"),
        ),
    )


def _band(length: Column) -> Column:
    """Bands of lengths, four to a doubling from 16."""
    return F.least(F.floor(F.log2(length / 16.0) * 4), F.lit(_BANDS - 1)).cast("int")


def _typical(length: Column) -> tuple[Column, Column]:
    """Mean and deviation of the statistic of words, before any are seen."""
    return F.log(length.cast("double")) + 0.1, F.lit(0.35)


def calibrate(docs: DataFrame, text_column: str = "text", false_discoveries: float = FALSE_DISCOVERIES) -> tuple[dict, float]:
    """Per length band the statistic of ordinary words, and the p-value to stop at.

    All tokens of all texts are tested. Tokens of letters alone are the ordinary ones;
    in each band the mean and deviation of their statistic, with ten tokens' worth of
    a prior, give every token a p-value under "ordinary word". Benjamini and
    Hochberg's rule on those p-values, counted in bins, gives the largest one at which
    the share of false discoveries stays in bounds. What comes to the driver is a row
    per band and one number.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    tested = F.transform(
        _candidates(text, _base(text)),
        lambda x: F.struct(battery(x["found"]).alias("b"), x["found"].rlike("^[A-Za-z]+$").alias("word")),
    )
    tokens = docs.select(F.inline(tested))
    tokens = tables.settled(tokens.select("b.*", "word"), "tokens")
    mean, deviation = _typical(F.col("length"))
    seen = (
        tokens.where("word")
        .groupBy(_band(F.col("length")).alias("band"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("statistic") - mean).alias("off"),
            F.sum(F.pow(F.col("statistic") - mean, F.lit(2.0))).alias("square"),
        )
    )
    bands = {}
    for row in seen.collect():
        rows = row["n"] + _PRIOR_ROWS
        shift = row["off"] / rows
        variance = (row["square"] + _PRIOR_ROWS * 0.35**2) / rows - shift * shift
        bands[row["band"]] = (shift, sqrt(max(variance, 0.01)))
    place = F.least(F.floor(-F.log10(_ordinary(F.col("length"), F.col("statistic"), bands)) * _STEPS), F.lit(_BINS))
    counts = tokens.where(F.col("p") >= CONSISTENT).groupBy(place.cast("int").alias("bin")).count().collect()
    tested, better, limit = tokens.count(), 0, 0.0
    for bin_, n in sorted(((r["bin"], r["count"]) for r in counts), reverse=True):
        better += n
        largest = 10.0 ** (-bin_ / _STEPS)
        if largest * tested <= false_discoveries * better:
            limit = largest
    return bands, limit


def _ordinary(length: Column, statistic: Column, bands: dict) -> Column:
    """p-value of a statistic this small among ordinary words of the length."""
    mean, deviation = _typical(length)
    if bands:
        pick = lambda i: F.create_map(*[F.lit(x) for b, v in bands.items() for x in (b, v[i])])[_band(length)]
        mean, deviation = mean + F.coalesce(pick(0), F.lit(0.0)), F.coalesce(pick(1), deviation)
    return F.greatest(_normal((statistic - mean) / deviation), F.lit(1e-18))


def spans(docs: DataFrame, text_column: str = "text", false_discoveries: float = FALSE_DISCOVERIES) -> DataFrame:
    """Each row with `spans`: array of (start, end, kind), by start, then kind.

    Kinds assign, access and hex are the known forms, each leftmost and not
    overlapping; random are further tokens of 16 or more characters, touching none of
    those, that the battery takes for random and whose likeness to ordinary words of
    their length is below what `calibrate` allows. Places are code points, the end is
    exclusive. A missing or empty text has no spans. Other columns are kept; one named
    `spans` is replaced.

    Texts are read twice and never shuffled. No match crosses rows, so repeated rows
    and any keys do no harm.
    """
    bands, limit = calibrate(docs, text_column, false_discoveries)
    text = F.coalesce(F.col(text_column), F.lit(""))

    def is_random(x: Column) -> Column:
        return _let(
            battery(x["found"]),
            lambda b: (b["p"] >= CONSISTENT) & (_ordinary(b["length"], b["statistic"], bands) <= limit),
        )

    found = _let(
        _base(text), lambda base: _ordered(F.concat(base, F.filter(_candidates(text, base), is_random)))
    )
    return docs.drop("spans").withColumn(
        "spans",
        F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))),
    )


def listed(spans_column: Column) -> Column:
    """Spans as one text, kind:start:end joined by commas."""
    return F.array_join(
        F.transform(spans_column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def redacted(text: Column, spans_column: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mark."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        inside = x["start"] < a["at"]
        piece = F.concat(a["out"], text.substr(a["at"] + 1, x["start"] - a["at"]), F.lit(mark))
        return F.struct(
            F.greatest(a["at"], x["end"]).alias("at"), F.when(inside, a["out"]).otherwise(piece).alias("out")
        )

    end = lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.length(text)))
    return F.when(F.size(spans_column) > 0, F.aggregate(spans_column, zero, step, end)).otherwise(text)
