"""Byte-level BPE by corpus-level merge replay.

The distinct words of many texts are laid out as one sequence of byte tokens.
An inverted index leads from the rank of a token pair to the places where such
a pair stands, in all words at once. Merges are replayed in rank order: a merge
touches the places in its entry of the index, joins the two tokens there, and
enters the two pairs that each new token makes with its neighbours. Words that
were merged before are kept (a bounded number), so in the long run a text costs
a look-up for each word.

Replaying is done per task, over the words of the slices that the task reads:
mapping a vocabulary of the whole corpus back to the texts would shuffle every
word of the corpus, or broadcast a table that grows with it, and give the same ids.

Defined results: a null or empty text has no tokens, and decodes to an empty
text; rows are encoded one by one, so repeated rows give equal ids; a very long
text is a slice of its own, whose memory is a multiple of it; names that are
taken get underscores.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrowtext import pieces, ragged
from lodestone.llm.shared import unused

#: The characters of Unicode's White_Space, which the pattern's \s and \S are about.
WHITE_SPACE = r"\t-\r\x20\x85\xa0  -     　"


def explicit_spaces(pattern: str) -> str:
    """The pattern with \\s and \\S written out, in and out of brackets, so that engines agree on them."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(WHITE_SPACE if inside else f"[{WHITE_SPACE}]")
        elif two == r"\S" and not inside:
            out.append(f"[^{WHITE_SPACE}]")
        else:
            if two[0] == "\\":
                out.append(two)
            else:
                inside = two[0] == "[" or inside and two[0] != "]"
                out.append(two[0])
                two = two[0]
        i += len(two)
    return "".join(out)


class MergeReplay:
    """Encodes and decodes by the ranks of a tiktoken file's content."""

    def __init__(self, content: bytes, pattern: str, keep_words: int = 150_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        self.find = regex.compile(explicit_spaces(pattern)).findall
        self.keep_words = keep_words
        self.words: dict[str, bytes] = {}  # ids as bytes of int32
        self.end = max(self.ranks.values()) + 1  # stands between words, merges with nothing
        self.stride = self.end + 1
        #: each way to cut a token in two tokens -> the token, as sorted keys and their values
        merged = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    merged[a * self.stride + b] = rank
        self.pair_keys = np.array(sorted(merged), np.int64)
        self.pair_values = np.array([merged[k] for k in self.pair_keys.tolist()], np.int64)
        #: ranks after whose merge a pair of a lower rank can stand
        self.unruly = {x for k, v in merged.items() for x in divmod(k, self.stride) if v < x}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    def pair_ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The id of the merge of each pair of ids; ``end`` where there is none."""
        keys = x * self.stride + y
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_values[at], self.end)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as bytes of int32, all words merged together in rank order.

        All places of a rank are merged at once; where places overlap, from the
        left. Only for a rank after whose merge a lower rank can come up, one
        place of a word is merged at a time, as the lower one goes first then.
        """
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(sizes + 1) - sizes - 1
        n = int(sizes.sum()) + len(words)
        end, gone = self.end, -1
        tok = np.full(n, end, np.int64)
        tok[ragged(begins, sizes)] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(ranks: np.ndarray, places: np.ndarray) -> None:
            some = np.flatnonzero(ranks != end)
            ranks, places = ranks[some], places[some]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            for r, i, j in zip(ranks[bounds[:-1]].tolist() if len(ranks) else (), bounds, bounds[1:]):
                if r in index:
                    index[r].append(places[i:j])
                else:
                    index[r] = [places[i:j]]
                    heappush(heap, r)

        enter(self.pair_ranks(tok[:-1], tok[1:]), np.arange(n - 1))
        while heap:
            rank = heappop(heap)
            entry = index.pop(rank)
            i = np.unique(np.concatenate(entry)) if len(entry) > 1 else entry[0]
            i = i[tok[i] != gone]
            j = after[i]
            right = self.pair_ranks(tok[i], tok[j]) == rank
            i, j = i[right], j[right]
            if not len(i):
                continue
            chained = np.concatenate([[False], j[:-1] == i[1:]])  # the place before takes its first token
            if chained.any():
                run = np.arange(len(i)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(i))))
                i, j = i[run % 2 == 0], j[run % 2 == 0]
            if rank in self.unruly and len(i) > 1:
                word = np.searchsorted(begins, i, "right")
                first = np.concatenate([[True], word[1:] != word[:-1]])
                if not first.all():
                    index[rank] = [i[~first]]
                    heappush(heap, rank)
                    i, j = i[first], j[first]
            k = after[j]
            tok[i], tok[j] = rank, gone
            after[i], before[k] = k, i
            p = before[i]
            left = np.where(p >= 0, tok[p], end)
            enter(
                np.concatenate([self.pair_ranks(left, np.full(len(i), rank)), self.pair_ranks(np.full(len(i), rank), tok[k])]),
                np.concatenate([p, i]),
            )
        flat = tok[tok != gone]
        bounds = np.concatenate([[0], np.flatnonzero(flat == end) + 1]).tolist()
        ids = flat.astype(np.int32).tobytes()
        return [ids[4 * x : 4 * y - 4] for x, y in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of int32."""
        split = [self.find(t) for t in texts]
        new = {w for ws in split for w in ws if w not in self.words}
        if new:
            if len(self.words) + len(new) > self.keep_words:
                used = {w for ws in split for w in ws}
                self.words = {w: ids for w, ids in self.words.items() if w in used}
            whole, parts = [], []
            for w in new:
                raw = w.encode()
                if (rank := self.ranks.get(raw)) is not None:
                    self.words[w] = rank.to_bytes(4, sys.byteorder)
                else:
                    whole.append(w)
                    parts.append(raw)
            self.words.update(zip(whole, self.replay(parts)))
        ids = self.words.__getitem__
        return [b"".join(map(ids, ws)) for ws in split]


class Vocabulary:
    """The bytes of each id of a tiktoken file's content."""

    def __init__(self, content: bytes, pattern: str):
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, content.splitlines()) if a}
        tokens = [ranks.get(k, b"") for k in range(max(ranks) + 1)]
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_sizes = np.array([len(t) for t in tokens], np.int64)
        self.token_begins = np.cumsum(self.token_sizes) - self.token_sizes

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes[ragged(self.token_begins[ids], self.token_sizes[ids])].tobytes()


class Tokenizer:
    """A vocabulary as executors get it: broadcast content (of a fixed size), built once for each worker."""

    built: dict[tuple, object] = {}

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            self.content = spark.sparkContext.broadcast((f.read(), pattern))

    def get(self, kind):
        """A MergeReplay or a Vocabulary of the content."""
        content, pattern = self.content.value
        key = (kind.__name__, hash((content, pattern)))
        if key not in Tokenizer.built:
            # one of each kind: a worker that encodes may decode next
            Tokenizer.built = {k: x for k, x in Tokenizer.built.items() if k[0] != key[0]} | {key: kind(content, pattern)}
        return Tokenizer.built[key]


def default_tokenizer(spark: SparkSession) -> Tokenizer:
    import public_tokenizers  # only the driver needs it: executors get the content

    return Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def encode(df: DataFrame, tokenizer: Tokenizer, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of a text column (array<int>) in its place, underscores in front of their name where it is taken."""
    at = df.columns.index(text)
    (ids,) = unused(df.drop(text), ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer.get(MergeReplay)
        for batch in pieces(batches, at):
            coded = bpe.encode(batch.column(at).fill_null("").to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(coded), np.int32))
            columns = [c if k != at else pa.ListArray.from_arrays(pa.array(offsets), flat) for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, [x if k != at else ids for k, x in enumerate(batch.schema.names)])
        bpe.words = {}  # an idle worker keeps the tables only

    schema = T.StructType([f if k != at else T.StructField(ids, T.ArrayType(T.IntegerType())) for k, f in enumerate(df.schema.fields)])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: Tokenizer, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the token ids stand for in a further column, underscores in front of its name where it is taken."""
    at = df.columns.index(ids)
    (out,) = unused(df, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer.get(Vocabulary)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                lists = part.column(at)
                offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                raw = [words.decode(flat[a:b]) for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def token_report(documents: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    coded = decode(encode(documents.select("doc_id", "text"), tokenizer), tokenizer)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return token_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(spark))
