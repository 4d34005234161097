"""Parsers: bytes to text and blocks.

A block is (kind, text, level, start, end), with places in characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "array<struct<kind:string,text:string,level:int,start:int,end:int>>"
PARAGRAPH_BREAK = r"\n[ \t]*\n"
TEXT_TYPES = ("text/plain", "text/x-rst", "application/octet-stream")
MARKDOWN_TYPES = ("text/markdown",)


def decoded(content: Column) -> Column:
    """UTF-8, or else Latin-1 with a warning: a struct of text and warnings."""
    text = content.cast("string")
    good = F.is_valid_utf8(text)
    warning = F.array(F.lit("not UTF-8; read as Latin-1"))
    return F.struct(F.when(good, text).otherwise(F.decode(content, "ISO-8859-1")).alias("text"), F.when(good, F.array().cast("array<string>")).otherwise(warning).alias("warnings"))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines. A block's place is that of the whole piece, its text is stripped."""
    pieces, gaps = F.split(text, PARAGRAPH_BREAK, -1), F.regexp_extract_all(text, F.lit(PARAGRAPH_BREAK), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(BLOCKS).alias("blocks"))

    def add(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["piece"])
        body = F.btrim(x["piece"], F.lit(" \t\n\x0b\f\r"))
        block = F.struct(F.lit("paragraph").alias("kind"), body.alias("text"), F.lit(None).cast("int").alias("level"), acc["at"].alias("start"), end.alias("end"))
        return F.struct((end + F.coalesce(F.length(x["gap"]), F.lit(0))).alias("at"), F.when(body == "", acc["blocks"]).otherwise(F.concat(acc["blocks"], F.array(block))).alias("blocks"))

    return F.aggregate(F.zip_with(pieces, gaps, lambda p, g: F.struct(p.alias("piece"), g.alias("gap"))), start, add, lambda acc: acc["blocks"])


MARK = re.compile(r"(?P<fence>\s*(?:```|~~~))|(?P<level>\#{1,6})[ \t]+(?P<title>.*?)[ \t]*\#*[ \t]*$|(?P<under>(?:=+|-+)[ \t]*$)|(?P<blank>\s*$)")
ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+")


def markdown(text: str) -> list[tuple]:
    """Headings, fences, lists and paragraphs, told apart by the first characters of each line."""
    found: list[tuple] = []
    run: list[tuple[int, str]] = []  # lines of the block that is open, with their places
    fenced = False

    def close(kind: str | None = None, level: int | None = None, end: int | None = None) -> None:
        body = "".join(x for _, x in run).strip()
        if body:
            found.append((kind or ("list" if ITEM.match(run[0][1]) else "paragraph"), body, level, run[0][0], run[-1][0] + len(run[-1][1]) if end is None else end))
        run.clear()

    at = 0
    for line in text.splitlines(keepends=True):
        here, at = (at, line), at + len(line)
        mark = MARK.match(line.rstrip("\r\n"))
        if fenced or mark and mark["fence"]:
            if not fenced:
                close()
            run.append(here)
            if fenced and mark and mark["fence"]:
                close("code")
                fenced = False
            else:
                fenced = True
        elif mark and mark["level"]:
            close()
            found.append(("heading", mark["title"].strip(), len(mark["level"]), here[0], at))
        elif mark and mark["under"] and run:
            title = run.pop()
            close()
            run.append(title)
            close("heading", 1 if "=" in line else 2, at)
        elif mark and mark["blank"] is not None:
            close()
        else:
            run.append(here)
    close("code" if fenced else None, end=len(text) if fenced else None)
    return found


def markdown_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a further column ``blocks``."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(blocks=[[dict(zip(("kind", "text", "level", "start", "end"), b)) for b in markdown(t or "")] for t in frame[text]])

    return docs.mapInPandas(scan, docs.withColumn("blocks", F.lit(None).cast(BLOCKS)).schema)


def parsed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document rows with content and media_type) -> (rows with text, warnings, blocks; quarantined rows with rule and reason)."""
    known = F.col("media_type").isin(*TEXT_TYPES, *MARKDOWN_TYPES)
    read = docs.withColumn("_read", decoded(F.col("content"))).withColumns({"text": F.col("_read.text"), "parse_warnings": F.col("_read.warnings")}).drop("_read")
    empty = F.col("text").rlike(r"^\s*$")
    bad = read.where(~known | empty).withColumns({"rule": F.lit("parse"), "reason": F.when(~known, F.concat(F.lit("No parser handles media type "), F.col("media_type"))).otherwise("The document is empty")})
    good = read.where(known & ~empty)
    plain = good.where(F.col("media_type").isin(*TEXT_TYPES)).withColumn("blocks", paragraphs(F.col("text")))
    marked = markdown_blocks(good.where(F.col("media_type").isin(*MARKDOWN_TYPES)))
    no_headings = ~F.exists("blocks", lambda b: b["kind"] == "heading")
    marked = marked.withColumn("parse_warnings", F.when(no_headings, F.concat("parse_warnings", F.array(F.lit("no headings")))).otherwise(F.col("parse_warnings")))
    return plain.unionByName(marked), bad


def tolerant_json(text: Column) -> Column:
    """A VARIANT of JSON that may stand in one code fence; null if it isn't JSON."""
    return F.try_parse_json(F.regexp_replace(text, r"^\s*```(?:json)?\s*\n?|\n?\s*```\s*$", ""))
