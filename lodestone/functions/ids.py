"""Deterministic identity: hashes of normalised text and of ordered parts.

A digest is the SHA-256 of a domain label and its parts, each followed by the
next after a NUL, so parts cannot run together. Nulls count as empty.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = "lodestone"
#: The white space that normalisation collapses (Java's \s is ASCII only).
WHITE_SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
#: The characters of that class.
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(WHITE_SPACE, c))
#: A run of white space other than a single space, which needs no replacing.
UNEVEN_SPACE = f" {WHITE_SPACE}+|[{WHITE_SPACE}&&[^ ]]{WHITE_SPACE}*"


def compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def nfkc(text: Column) -> Column:
    """Spark has no compatibility normalisation, so this is a vectorised function of Python. ASCII is not sent to it."""
    return F.coalesce(F.when(is_ascii(text), text), F.pandas_udf(compatible, "string")(F.when(~is_ascii(text), text)))


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, UNEVEN_SPACE, " "))


def normalise_text(text: Column, compatibility: bool = True) -> Column:
    """NFKC, then collapsed white space. Without ``compatibility`` all stays in the JVM, for text that is NFKC already."""
    return collapse(nfkc(text) if compatibility else text)


def digest(domain: str, *parts: Column, namespace: str = NAMESPACE) -> Column:
    whole = F.concat_ws("\u0000", F.lit(f"{namespace}/{domain}/v1"), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.sha2(whole.cast("binary"), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def text_hash(text: Column, compatibility: bool = True, namespace: str = NAMESPACE) -> Column:
    return digest("text", normalise_text(text, compatibility), namespace=namespace)


def document_id(source_id: Column, entry_id: Column, namespace: str = NAMESPACE) -> Column:
    return F.concat(F.lit("doc_"), F.substring(digest("document", source_id, entry_id, namespace=namespace), 1, 24))


def chunk_id(document: Column, index: Column, text: Column, compatibility: bool = True, namespace: str = NAMESPACE) -> Column:
    """Null for a negative index."""
    whole = digest("chunk", document, index, normalise_text(text, compatibility), namespace=namespace)
    return F.when(index >= 0, F.concat(F.lit("chk_"), F.substring(whole, 1, 24)))


def stable_hash(value: object, namespace: str = NAMESPACE) -> str:
    """Of a JSON value on the driver (configurations, filters); 1 and 1.0 differ, key order doesn't matter."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return hashlib.sha256(f"{namespace}/stable/v1\0{text}".encode()).hexdigest()


def prompt_version(template: Column) -> Column:
    return F.substring(F.sha2(template.cast("binary"), 256), 1, 12)


def embed_key(model: str, kind: str, text: Column, compatibility: bool = True) -> Column:
    return F.concat_ws(":", F.lit("embed"), F.lit(model), F.lit(kind), F.sha2(normalise_text(text, compatibility).cast("binary"), 256))


def retrieval_key(index: str, epoch: Column, model: str, query: Column, filter_hash: str, params_hash: str, compatibility: bool = True) -> Column:
    body = F.concat_ws("\u0000", normalise_text(query, compatibility), F.lit(filter_hash), F.lit(params_hash))
    return F.concat_ws(":", F.lit("retr"), F.lit(index), epoch.cast("string"), F.lit(model), F.sha2(body.cast("binary"), 256))


def generation_key(model: str, params_hash: str, version: Column, prompt: Column) -> Column:
    return F.concat_ws(":", F.lit("gen"), F.lit(model), F.lit(params_hash[:16]), version, F.sha2(prompt.cast("binary"), 256))


def rerank_key(model: str, query: Column, ids: Column, compatibility: bool = True) -> Column:
    body = F.concat_ws("\u0000", normalise_text(query, compatibility), F.array_join(ids, "\u0000"))
    return F.concat_ws(":", F.lit("rr"), F.lit(model), F.sha2(body.cast("binary"), 256))
