"""Scalar functions as Column expressions: parsing, cleaning, folding, formatting, geometry."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed


def parse_tags(value: Column) -> Column:
    """Comma lists, JSON-like lists (in order) and JSON-like dicts (keys by votes, most first); else no tags."""
    v = F.trim(F.coalesce(value, F.lit("")))
    options = {"allowSingleQuotes": "true"}
    votes = F.map_entries(F.from_json(v, "map<string,double>", options))
    keys = F.transform(F.array_sort(votes, lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1)), lambda e: e["key"])
    none = F.array().cast("array<string>")
    commas = F.filter(F.transform(F.split(v, ","), lambda t: F.trim(t)), lambda t: t != "")
    return (
        F.when(v.isin("", "[]", "{}", "nan", "NaN"), none)
        .when(v.startswith("{"), F.coalesce(keys, none))
        .when(v.startswith("["), F.coalesce(F.from_json(v, "array<string>", options), none))
        .otherwise(commas)
    )


def clean_html(value: Column) -> Column:
    """Tags become spaces, white space is folded, ends are trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), "<[^>]+>", " "), r"(?U)\s+", " "))


def build_text(name: Column, tags: Column, genres: Column, short: Column, long: Column, mask: Column | None = None, with_name: bool = True) -> Column:
    """The text to embed: name, 12 tags in lower case, genres, 600 characters of a description."""
    kept = F.slice(tags if mask is None else F.filter(tags, lambda t: ~t.eqNullSafe(mask)), 1, 12)
    body = F.substring(F.when(F.length(short) > 0, short).otherwise(long), 1, 600)
    parts = [
        F.when(F.length(name) > 0, F.concat(name, F.lit("."))) if with_name else F.lit(None).cast("string"),
        F.when(F.size(kept) > 0, F.concat(F.lit("Tags: "), F.lower(F.array_join(kept, ", ")), F.lit("."))),
        F.when(F.size(genres) > 0, F.concat(F.lit("Genres: "), F.lower(F.array_join(genres, ", ")), F.lit("."))),
        F.when(F.length(body) > 0, body),
    ]
    return F.concat_ws(" ", *parts)


def fold_text(value: str | None) -> str | None:
    """Without accents, lower case, runs of other characters than letters and digits as one space."""
    if value is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFD", value) if not unicodedata.combining(c)).lower()
    return " ".join("".join(c if c.isalnum() else " " for c in plain).split())


@F.pandas_udf(T.StringType())
def fold(values: pd.Series) -> pd.Series:
    """``fold_text`` of a column: a Python function, as Spark has none that decomposes characters."""
    return values.map(fold_text)


def year_of(value: Column) -> Column:
    """The first token of four digits, as a number."""
    tokens = F.filter(F.split(F.regexp_replace(value, ",", " "), " +"), lambda t: t.rlike("^[0-9]{4}$"))
    return F.try_element_at(tokens, F.lit(1)).try_cast("int")


def phrase(terms: Column, most: int = 3) -> Column:
    """Names of the first terms with a positive score; ``terms`` is an array of (term, score)."""
    good = F.slice(F.filter(terms, lambda t: t["score"] > 0), 1, most)
    return F.when(F.size(good) > 0, F.array_join(F.transform(good, lambda t: t["term"]), " / ")).otherwise("unnamed")


def lenient_int(value: Column) -> Column:
    return F.coalesce(value.try_cast("double").cast("long"), F.lit(0).cast("long"))


def utc_now() -> Column:
    """The query's time in UTC, as ISO text to the second; it isn't the same on every run."""
    return F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def terms_for_footprint(f: Column) -> Column:
    return F.when(f > 0.055, 3).when(f > 0.014, 2).otherwise(1)


def score_word(score: Column) -> Column:
    """Seven bands of a share of positive reviews."""
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, word in fixed.SCORE_WORDS[:-1]:
        out = out.when(score >= least, word)
    return out.otherwise(fixed.SCORE_WORDS[-1][1])


def score_class(score: Column) -> Column:
    return F.when(score >= 0.7, "good").when(score >= 0.4, "mixed").when(score.isNotNull(), "bad")


def price_text(price: Column) -> Column:
    return F.when(price.isNull(), F.lit(None).cast("string")).when(price == 0, "Free").otherwise(F.format_string("$%.2f", price))


def smoothstep(a: float, b: float, x: Column) -> Column:
    t = F.least(F.greatest((x - a) / (b - a), F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def level_from_scale(scale: Column, home: float, most: int) -> Column:
    return F.least(F.greatest(F.floor(F.log2(F.greatest(scale / home, F.lit(1.0))) + 0.4), F.lit(0)), F.lit(most)).cast("int")


def footprint(x0: Column, y0: Column, x1: Column, y1: Column, scale: float, width: float, height: float) -> Column:
    """Share of the viewport that a box covers at a scale of pixels a unit."""
    return ((x1 - x0) * scale) * ((y1 - y0) * scale) / (width * height)


def fit_scale(w: Column, h: Column, width: float, height: float, margin: float = 1.35) -> Column:
    return F.least(width / (w * margin), height / (h * margin))


def project(v: Column, centre: float, scale: float, size: float) -> Column:
    return (v - centre) * scale + size / 2


def unproject(p: Column, centre: float, scale: float, size: float) -> Column:
    return (p - size / 2) / scale + centre


def size_bin(n: Column) -> Column:
    out = F.when(n.isNull(), F.lit(None).cast("int"))
    for b in fixed.SIZE_BINS:
        out = out.when(n <= b, b)
    return out.otherwise(fixed.LAST_SIZE_BIN)


def l2_normalise(v: Column, least: float = 1e-9) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(least)))


def weighted_concat(a: Column, b: Column, alpha: float) -> Column:
    return F.concat(F.transform(a, lambda x: x * alpha), F.transform(b, lambda x: x * (1 - alpha)))


def effective_weight(alpha: float) -> float:
    return alpha**2 / (alpha**2 + (1 - alpha) ** 2)


def bic_gain(n: Column, d: int, sse_one: Column, sse_two: Column, n1: Column, n2: Column) -> Column:
    """Gain of two spherical Gaussians over one, in Bayes information."""
    one = -(n * d / 2) * F.log(2 * F.pi() * sse_one / (n * d)) - n * d / 2 - F.log(n) * (d + 1) / 2
    two = -(n * d / 2) * F.log(2 * F.pi() * sse_two / (n * d)) - n * d / 2 + n1 * F.log(n1 / n) + n2 * F.log(n2 / n) - F.log(n) * (2 * (d + 1) + 1) / 2
    return two - one
