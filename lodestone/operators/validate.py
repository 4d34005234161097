"""Chunk validation: the first rule that fails decides; duplicates are looked for among the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.ids import SPACES, WHITE_SPACE, collapse, is_ascii, text_hash
from lodestone.functions.tokens import estimate_tokens


#: ASCII characters that are neither letters nor digits.
MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


@dataclass(frozen=True)
class Limits:
    most_tokens: int = 8192
    least_tokens: int = 8
    least_alphanumeric: float = 0.25


def rule_of(text: Column, tokens: Column, limits: Limits = Limits()) -> Column:
    """The first failing rule of a row: empty, too_long, too_short, boilerplate; null if none fails."""
    bare = F.length(F.translate(text, SPACES, ""))
    letters = F.length(F.when(is_ascii(text), F.translate(text, MARKS, "")).otherwise(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")))
    return (
        F.when(~text.rlike(f"[^{WHITE_SPACE}]"), "empty")
        .when(tokens > limits.most_tokens, "too_long")
        .when(tokens < limits.least_tokens, "too_short")
        .when(letters / bare < limits.least_alphanumeric, "boilerplate")
    )


def reason_of(rule: Column, tokens: Column, limits: Limits = Limits()) -> Column:
    """What is wrong with a chunk, in words."""
    n = tokens.cast("string")
    return (
        F.when(rule == "empty", "no text but white space")
        .when(rule == "too_long", F.concat(n, F.lit(f" tokens, at most {limits.most_tokens} fit")))
        .when(rule == "too_short", F.concat(n, F.lit(f" tokens, at least {limits.least_tokens} are wanted")))
        .when(rule == "boilerplate", f"under {limits.least_alphanumeric:g} of the characters are letters or digits")
        .when(rule == "duplicate", "an earlier chunk of the document has the same text")
    )


def excerpt(text: Column) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) > 120, F.concat(F.substring(flat, 1, 120), F.lit("..."))).otherwise(flat)


def validated(chunks: DataFrame, limits: Limits = Limits(), compatibility: bool = True) -> DataFrame:
    """(document_id, index, text, ...) with rule (null: accepted), disposition, quarantined (of the document), reason and excerpt.

    A chunk that is too long puts its whole document into quarantine; other
    failures drop the chunk. Rows are shuffled once, by document; both windows use that.
    """
    tokens = F.coalesce(F.col("token_count"), estimate_tokens(F.col("text"))) if "token_count" in chunks.columns else estimate_tokens(F.col("text"))
    rows = chunks.withColumns({"rule": rule_of(F.col("text"), tokens, limits), "text_hash": text_hash(F.col("text"), compatibility)})
    rows = rows.repartition("document_id")
    same = Window.partitionBy("document_id", "text_hash", F.col("rule").isNull()).orderBy("index")
    rows = rows.withColumn("rule", F.when(F.col("rule").isNull() & (F.row_number().over(same) > 1), "duplicate").otherwise(F.col("rule")))
    disposition = F.when(F.col("rule") == "too_long", "quarantine_document").when(F.col("rule").isNotNull(), "drop")
    document = Window.partitionBy("document_id")
    return rows.withColumns({"disposition": disposition, "quarantined": F.bool_or(F.coalesce(F.col("rule") == "too_long", F.lit(False))).over(document), "reason": reason_of(F.col("rule"), tokens, limits), "excerpt": F.when(F.col("rule").isNotNull(), excerpt(F.col("text")))})


def accepted(validation: DataFrame) -> DataFrame:
    return validation.where(F.col("rule").isNull() & ~F.col("quarantined"))


def rejections(validation: DataFrame) -> DataFrame:
    """Why chunks were dropped; chunk_id and source_uri where the chunks have them."""
    known = [c for c in ("chunk_id", "source_uri") if c in validation.columns]
    return validation.where(F.col("rule").isNotNull()).select("document_id", *known, "index", "rule", "disposition", "reason", "excerpt")
