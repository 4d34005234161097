"""Chunking: blocks are cut into pieces, pieces are packed into chunks.

The packing of a document is a fold over its pieces, in order, so it is done by
a small kernel for each document; ids, prefixes and counts are Columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.ids import NAMESPACE, chunk_id
from lodestone.functions.tokens import estimate, estimate_length, estimate_tokens

TRAIL = " > "
SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True)
class ChunkSize:
    target: int = 512
    overlap: int = 64
    least: int = 16

    def __post_init__(self) -> None:
        if self.overlap >= self.target:
            raise ValueError("the overlap must be smaller than the target")


def packed(units: list[str], glue: str, most: int) -> list[str]:
    """Units joined in order, each result of at most ``most`` tokens or a single unit."""
    runs: list[list[str]] = []
    length = 0
    for unit in units:
        length += len(glue) + len(unit)
        if runs and estimate_length(length) <= most:
            runs[-1].append(unit)
        else:
            runs.append([unit])
            length = len(unit)
    return [glue.join(run) for run in runs]


def pieces_of(block: dict, most: int) -> list[str]:
    """A block's text, cut by sentences (code: by lines), then by words, if it is too long."""
    text = block["text"]
    if estimate(text) <= most:
        return [text]
    code = block["kind"] == "code"
    units = [u for u in (text.splitlines() if code else SENTENCE.split(text)) if u.strip()]
    parts = packed(units, "\n" if code else " ", most)
    return [x for part in parts for x in ([part] if estimate(part) <= most else packed(part.split(), " ", most))]


def chunks_of(blocks: list[dict], size: ChunkSize) -> list[dict]:
    """The chunks of one document: body, start, end, and the heading trail."""
    trail: list[str] = []
    groups: list[list[tuple]] = []  # pieces: (text, tokens, start, end, trail)
    tokens = 0
    for block in blocks:
        heading = block["kind"] == "heading"
        if heading:
            trail = [*trail[: int(block["level"]) - 1], block["text"]]
        for text in [block["text"]] if heading else pieces_of(block, size.target):
            piece = (text, estimate(text), block["start"], block["end"], tuple(trail))
            if not groups or heading:
                groups.append([])
                tokens = 0
            elif tokens + piece[1] > size.target:
                again: list[tuple] = []
                room = size.overlap
                for old in reversed(groups[-1]):
                    if old[1] > room:
                        break
                    again.insert(0, old)
                    room -= old[1]
                groups.append(again)
                tokens = sum(p[1] for p in again)
            groups[-1].append(piece)
            tokens += piece[1]
    out: list[dict] = []
    for group in groups:
        body = "\n\n".join(p[0] for p in group)
        if out and estimate(body) < size.least and out[-1]["trail"] == list(group[0][4]):
            out[-1]["body"] += f"\n\n{body}"
            out[-1]["end"] = group[-1][3]
        else:
            out.append({"body": body, "start": group[0][2], "end": group[-1][3], "trail": list(group[0][4])})
    return out


def chunked(docs: DataFrame, size: ChunkSize = ChunkSize(), heading_path: bool = True, compatibility: bool = True, namespace: str = NAMESPACE) -> DataFrame:
    """(document_id, blocks, ...) -> one row for each chunk: document_id, index, chunk_id, text, start, end, heading_path, trust, token_count."""

    kind = docs.schema["document_id"].dataType
    columns = pa.schema([("index", pa.int32()), ("body", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("trail", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                found = [(at, {"index": n, **c}) for at, blocks in enumerate(part.column(1).to_pylist()) for n, c in enumerate(chunks_of(blocks or [], size))]
                names = part.column(0).take(pa.array([at for at, _ in found], pa.int32()))
                chunks = pa.RecordBatch.from_pylist([c for _, c in found], columns)
                yield pa.RecordBatch.from_arrays([names.cast(to_arrow_type(kind)), *chunks.columns], ["document_id", *columns.names])

    types = T.StructType([T.StructField("document_id", kind), *T.StructType.fromDDL("index int, body string, start int, end int, trail array<string>").fields])
    rows = docs.select("document_id", "blocks").mapInArrow(run, types)
    own = F.when(F.size("trail") > 0, F.expr("startswith(body, element_at(trail, -1))")).otherwise(False)
    prefix = F.array_join(F.when(own, F.slice("trail", 1, F.greatest(F.size("trail") - 1, F.lit(0)))).otherwise(F.col("trail")), TRAIL)
    text = F.when((prefix != "") & ~F.col("body").startswith(prefix), F.concat_ws("\n\n", prefix, F.col("body"))).otherwise(F.col("body")) if heading_path else F.col("body")
    rows = rows.withColumn("text", text)
    return rows.select(
        "document_id",
        "index",
        chunk_id(F.col("document_id"), F.col("index"), F.col("text"), compatibility, namespace).alias("chunk_id"),
        "text",
        "start",
        "end",
        F.array_join("trail", TRAIL).alias("heading_path"),
        F.lit("untrusted").alias("trust"),
        estimate_tokens(F.col("text")).alias("token_count"),
    )
