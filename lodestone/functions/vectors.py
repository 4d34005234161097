"""Similarity of vectors, higher is better, and the hashing embedder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.ids import normalise_text

#: Words that carry no content for the embedder.
STOP_WORDS = "a an and are as at be by can do does for from how i in is it my of on or our the this to what when where which who why will with you your".split()
METRICS = ("cosine", "dot", "euclidean")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return fold(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(fold(F.transform(doubles(a), lambda x: x * x)))


def similarity(metric: str, a: Column, b: Column) -> Column:
    """Cosine (0 where a norm is 0), dot, or 1 / (1 + distance). An empty vector is near to nothing: 0. Other vectors of different widths are an error."""
    if metric == "cosine":
        norms = norm(a) * norm(b)
        score = F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
    elif metric == "dot":
        score = dot(a, b)
    elif metric == "euclidean":
        score = 1 / (1 + F.sqrt(fold(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 0.0).when(F.size(a) == F.size(b), score).otherwise(F.raise_error(F.lit("vectors have different widths")))


def word_counts(text: Column, dimensions: int) -> Column:
    """Signed feature hashing of the first five characters of each content word, as a dense array."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    content = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))

    def hashed(w: Column) -> Column:
        h = F.sha2(F.substring(w, 1, 5).cast("binary"), 256)
        at = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dimensions
        sign = F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 * 2 - 1
        return F.struct(at.alias("at"), sign.alias("sign"))

    sums = lambda marks: F.transform(positions(dimensions), lambda i: fold(F.transform(F.filter(marks, lambda m: m["at"] == i), lambda m: m["sign"].cast("double"))))
    return bound(F.transform(content, hashed), sums)


def positions(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though the body uses it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def jitter(text: Column, dimensions: int, salt: str = "") -> Column:
    """A stable unit vector from SHA-256 in counter mode."""
    seed = F.concat(F.lit(f"{salt}|"), text, F.lit("|"))
    blocks = F.transform(positions((dimensions - 1) // 8 + 1), lambda b: F.sha2(F.concat(seed, b.cast("string")).cast("binary"), 256))
    number = lambda h, i: F.conv(F.substring(h, i * 8 + 1, 8), 16, 10).cast("double") / float(2**31) - 1
    return unit(bound(F.array_join(blocks, ""), lambda h: F.transform(positions(dimensions), lambda i: number(h, i))))


def unit(v: Column) -> Column:
    return bound(v, lambda w: bound(norm(w), lambda n: F.transform(w, lambda x: x / n)))


def lexical_vector(clean: Column, dimensions: int = 256, salt: str = "") -> Column:
    """A unit vector of a normalised text; texts with similar words are near. A little jitter keeps it from being zero."""
    return unit(F.zip_with(word_counts(clean, dimensions), jitter(clean, dimensions, salt), lambda c, j: c + 0.05 * j))


def embedded(df: DataFrame, text: str, out: str, dimensions: int = 256, salt: str = "", compatibility: bool = True) -> DataFrame:
    """``df`` with the lexical vector of a text column."""
    clean = f"{out}_text"
    return df.withColumn(clean, normalise_text(F.col(text), compatibility)).withColumn(out, lexical_vector(F.col(clean), dimensions, salt)).drop(clean)
