"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features are the presence of words and of word beginnings, and in how many more
distinct words of the text a beginning is. Those that go with
the label far beyond chance (chi-squared over a bounded sample of labelled
documents) are the model's; all ordered thresholds share their weights:

    P(severity > k) = 1 / (1 + exp(cut[k] - weights . features)),  cut[0] < cut[1] < ...

The labels say only whether a document is toxic, so the severity grades of
toxic training documents are thirds by how many of the features that point to
the label they hold; others have grade 0. So the expected severity says whether a
document is toxic as the labels do, and beyond that how much of what goes with
toxic documents it holds; it is no judgement that a label has made. It rises with
every feature of positive weight. The fit (a bounded matrix) runs on the
driver; counting features and scoring every whole text run on the executors.

Defined results: null and empty texts have no features; without labels, or
with labels of one kind only, every severity is 0; labels with null fields are
left out, a doc_id that is labelled more than once is toxic if any label says so,
and of documents that share a labelled doc_id one (the least text) is fitted; rows
are scored one by one, so repeated rows get equal scores; very long texts are
slices of their own; names that are taken get underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.arrowtext import ALNUM, pieces, words_of
from lodestone.llm.shared import unused, written

GRADES = 4
#: Kinds of features: 0 is the word, others are that many first characters of longer words.
KINDS = (0, 3, 4, 5)
#: A beginning counts for so many words at most.
MOST_WORDS = 6


def of_kind(words: pa.Array, kind: int) -> pa.Array:
    """Each word's feature of a kind, null if it has none."""
    if kind == 0:
        return words
    return pc.if_else(pc.greater(pc.utf8_length(words), kind), pc.utf8_slice_codeunits(words, 0, kind), pa.scalar(None, words.type))


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a batch, and each pair of (text, word's index) once."""
    words = words_of(texts, ALNUM)
    coded = words.array().dictionary_encode()
    n = len(coded.dictionary)
    row = np.repeat(np.arange(len(texts)), np.diff(words.texts))
    pairs = np.unique(row * max(1, n) + coded.indices.to_numpy(zero_copy_only=False))
    return coded.dictionary, pairs // max(1, n), pairs % max(1, n)


def feature_counts(sample: DataFrame) -> DataFrame:
    """(text, toxic) -> (kind, feature, n, n_toxic): in how many documents each feature is. Summed for each slice first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            toxic = batch.column(1).to_numpy(zero_copy_only=False) > 0
            words, row, word = distinct_words(batch.column(0))
            for kind in KINDS:
                coded = of_kind(words, kind).dictionary_encode()
                code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[word]
                some = code >= 0
                n = max(1, len(coded.dictionary))
                pairs = np.unique(row[some] * n + code[some])
                total = np.bincount(pairs % n, minlength=n)[: len(coded.dictionary)]
                bad = np.bincount(pairs[toxic[pairs // n]] % n, minlength=n)[: len(coded.dictionary)]
                names = ["kind", "feature", "n", "n_toxic"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), kind, np.int32)), coded.dictionary.cast(pa.string()), pa.array(total), pa.array(bad)], names)

    parts = sample.select("text", "toxic").mapInArrow(count, "kind int, feature string, n long, n_toxic long")
    return parts.groupBy("kind", "feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def telling_features(counts: DataFrame, rows: int, toxic: int, min_docs: int, min_chi2: float, max_features: int) -> DataFrame:
    """(kind, feature, raises): the features that go with the label, or its absence, beyond chance."""
    n, a = F.col("n").cast("double"), F.col("n_toxic").cast("double")
    clean = rows - toxic
    chi2 = rows * F.pow(a * (clean - (n - a)) - (n - a) * (toxic - a), 2) / (n * (rows - n) * toxic * clean)
    strong = counts.where((F.col("n") >= min_docs) & (F.col("n") < rows)).withColumn("chi2", chi2).where(F.col("chi2") >= min_chi2)
    top = strong.orderBy(F.desc("chi2"), "kind", "feature").limit(max_features)
    return top.select("kind", "feature", (a * rows > n * toxic).alias("raises"))


@dataclass
class OrdinalModel:
    """Features by kind, their weights (through the kinds in order, for presence and then for further words), and the ordered thresholds."""

    features: dict[int, list[str]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, 50.0))

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each pair of (text, feature's index) that is present, once, and its value.

        The first half of the indexes is for presence, the second for further words.
        """
        words, row, word = distinct_words(texts)
        found, values, begin = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        half = len(self.weights) // 2
        total = max(1, half)
        for kind, names in self.features.items():
            index = pc.index_in(of_kind(words, kind), pa.array(names, words.type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            here = index[word]
            some = here >= 0
            pairs, times = np.unique(row[some] * total + begin + here[some], return_counts=True)
            found.append(pairs)
            values.append(times)
            begin += len(names)
        found, more = np.concatenate(found), np.minimum(np.concatenate(values), MOST_WORDS) - 1
        row, feature = found // total, found % total
        again = more > 0
        return np.concatenate([row, row[again]]), np.concatenate([feature, half + feature[again]]), np.concatenate([np.ones(len(row)), more[again]])

    def above(self, texts: pa.Array) -> np.ndarray:
        """P(severity > k) of each text, a column for each k."""
        row, feature, value = self.pairs(texts)
        score = np.bincount(row, self.weights[feature] * value, minlength=len(texts))
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -500, 500)))


def likelihood(params: np.ndarray, rows: np.ndarray, features: np.ndarray, values: np.ndarray, grades: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The mean log-likelihood of the grades less a ridge on the weights, and its gradient.

    ``params``: the weights, the first cut, and the logarithms of the gaps between cuts.
    """
    n, n_features = len(grades), len(params) - GRADES + 1
    w, cuts = params[:n_features], cuts_of(params[n_features:])
    score = np.bincount(rows, w[features] * values, minlength=n)
    above = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -500, 500)))  # (n, cuts)
    edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
    p = np.maximum(edge[np.arange(n), grades] - edge[np.arange(n), grades + 1], 1e-12)
    slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
    low, high = slope[np.arange(n), grades] / p, slope[np.arange(n), grades + 1] / p
    d_score = (low - high) / n
    d_cuts = np.array([(high[grades == k].sum() - low[grades == k + 1].sum()) / n for k in range(GRADES - 1)])
    d_gaps = np.cumsum(d_cuts[::-1])[::-1][1:] * np.exp(params[n_features + 1 :])
    up = np.concatenate([np.bincount(features, d_score[rows] * values, minlength=n_features) - ridge * w, [d_cuts.sum()], d_gaps])
    return float(np.log(p).mean() - ridge / 2 * (w**2).sum()), up


def cuts_of(params: np.ndarray) -> np.ndarray:
    """The ordered cuts: the first, and each further one by a gap that is above zero."""
    return params[0] + np.concatenate([[0.0], np.cumsum(np.exp(params[1:]))])


def fit_weights(rows: np.ndarray, features: np.ndarray, values: np.ndarray, n_features: int, grades: np.ndarray, steps: int = 400, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts of the cumulative-link model, by Adam on the likelihood."""
    params = np.zeros(n_features + GRADES - 1)
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        _, up = likelihood(params, rows, features, values, grades, ridge)
        mean, square = 0.9 * mean + 0.1 * up, 0.999 * square + 0.001 * up**2
        params = params + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return params[:n_features], cuts_of(params[n_features:])


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = 8000, min_docs: int = 5, min_chi2: float = 40.0, max_features: int = 4000) -> OrdinalModel:
    """A model from at most ``sample_rows`` labelled documents, chosen by the hash of doc_id."""
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # one row for each chosen doc_id, however often it is repeated in the documents
    rows_of = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = written(rows_of.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "toxicity_sample")
    rows, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < rows:
        return OrdinalModel()
    top = telling_features(feature_counts(sample), rows, toxic, min_docs, min_chi2, max_features).collect()
    features = {k: sorted(r.feature for r in top if r.kind == k) for k in KINDS if any(r.kind == k for r in top)}
    raises = {(r.kind, r.feature): r.raises for r in top}
    model = OrdinalModel(features, np.zeros(2 * len(top)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            row, feature, value = model.pairs(batch.column(1))
            order = np.argsort(row, kind="stable")
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order].astype(np.int32))) for x in (feature, value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], ["doc_id", "toxic", "found", "times"])

    got = sample.mapInArrow(find, T.StructType([sample.schema["doc_id"], sample.schema["toxic"], T.StructField("found", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType()))]))
    got = sorted(tuple(r) for r in got.collect())  # at most sample_rows
    row = np.repeat(np.arange(len(got)), [len(r[2]) for r in got])
    feature, value = (np.array([x for r in got for x in r[k]], np.int64) for k in (2, 3))
    label = np.array([r[1] for r in got])
    up = np.array([raises[k, name] for k, names in features.items() for name in names], float)
    evidence = np.bincount(row, np.concatenate([up, up])[feature] * value, minlength=len(got))
    thirds = np.quantile(evidence[label > 0], [1 / 3, 2 / 3])
    grades = np.where(label > 0, 1 + np.searchsorted(thirds, evidence, "left"), 0)
    model.weights, model.cuts = fit_weights(row, feature, value.astype(np.float64), 2 * len(top), grades)
    return model


def score(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """``documents`` with expected_severity (0 to 3), grade (the likeliest) and toxic (more likely above 0 than not)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most max_features features
    at = documents.columns.index("text")
    names = unused(documents, "expected_severity", "grade", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            above = shared.value.above(batch.column(at))
            steps = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            grade = np.argmax(steps[:, :-1] - steps[:, 1:], axis=1)
            new = [pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0] > 0.5)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    kinds = (T.DoubleType(), T.IntegerType(), T.BooleanType())
    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_severity, grade, toxic of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(documents, model).select("doc_id", F.round("expected_severity", 6).alias("expected_severity"), "grade", "toxic")
