"""Tokens, stable ids, label canonicalisation and hashed text vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 256


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def normalized_ocr(text: Column) -> Column:
    """Lower case; all but word characters, - . and / become single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\-./]+", " "))


def spaced_words(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[-_]+", " "), r"\s+", " "))


def slug(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"))


def relation_name(label: Column) -> Column:
    """Upper case with runs of other characters as one underscore, as a graph's edge type."""
    cleaned = F.regexp_replace(F.upper(F.trim(label)), "[^A-Z0-9]+", "_")
    return F.regexp_replace(cleaned, "^_+|_+$", "")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"[^/\\]*$", 0), r"\.[^.]*$", "")


def three_places(seconds: Column) -> Column:
    return F.format_string("%.3f", seconds.cast("double"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and the first 20 hex digits of SHA-1 over the parts joined by colons."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws(":", *parts)), 1, 20))


def canonical(df: DataFrame, column: str, synonyms: DataFrame, fallback_separator: str = " ") -> DataFrame:
    """Replaces a label by its canonical form in ``synonyms`` (words, canonical), else by its own words."""
    words = spaced_words(F.col(column))
    names = F.broadcast(synonyms.select(F.col("words").alias("__words"), F.col("canonical").alias("__canonical")))
    joined = df.join(names, words == F.col("__words"), "left")
    return joined.withColumn(column, F.coalesce("__canonical", F.regexp_replace(words, " ", fallback_separator))).drop("__words", "__canonical")


def hashed_entries(df: DataFrame, key: list[str], text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Sparse signed hashing vector of a text, L2-normalised: key, idx, val.

    A token adds +1 or -1 (by the parity of its digest's fifth byte) at its digest's first four bytes modulo ``dimensions``.
    """
    words = df.select(*key, F.explode(tokens(F.col(text))).alias("token"))
    digest = F.sha2(F.col("token"), 256)
    placed = words.select(*key, (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimensions).cast("int").alias("idx"), F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))
    summed = placed.groupBy(*key, "idx").agg(F.sum("sign").alias("x")).filter("x <> 0")
    norms = summed.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return summed.join(norms, key).select(*key, "idx", (F.col("x") / F.col("norm")).alias("val"))


def clipped_cosine(left: DataFrame, right: DataFrame, left_key: list[str], right_key: list[str], scope: list[str] | None = None) -> DataFrame:
    """Cosine of normalised sparse vectors that share an index (and scope), clipped to [0, 1]: keys, cosine."""
    on = ["idx", *(scope or [])]
    joined = left.withColumnRenamed("val", "__a").join(right.withColumnRenamed("val", "__b"), on)
    keys = [*dict.fromkeys([*left_key, *right_key])]
    return joined.groupBy(*keys).agg(F.sum(F.col("__a") * F.col("__b")).alias("dot")).select(*keys, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("dot"))).alias("cosine"))
