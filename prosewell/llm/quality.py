"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Class means and covariances come from sums over every labelled training row, so fitting is one aggregation of a fixed number of
values and never gathers rows.  Covariances are shrunk towards their pooled diagonal; a score is the difference of two Gaussian
log densities.  Each needs the inverse of a Cholesky factor, which is made once, by forward substitution, and kept with the model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from prosewell.llm.scratch import Scratch, plainly_named
from prosewell.llm.tokens import BLANKS, SLICE, slices, text_bytes, words

#: A document is accepted from this probability of label 1 on.
THRESHOLD = 0.3
SHRINKAGE = 0.1
#: Of five folds of crc32(doc_id), fold 0 is held out.
FOLDS = 5

_LETTER, _UPPER, _BANG, _SYMBOL = range(4)


def _byte_classes() -> np.ndarray:
    table = np.zeros((256, 4), np.uint8)
    for b in range(33, 256):
        c = chr(b)
        if b >= 128 or c.isalpha():
            table[b, _LETTER] = 1
            table[b, _UPPER] = b < 128 and c.isupper()
        elif c in "!?":
            table[b, _BANG] = 1
        elif not c.isdigit() and c not in ".,;:'\"()-":
            table[b, _SYMBOL] = 1
    return table


_CLASSES = _byte_classes()
#: Digits, line lengths and repeated lines are left out on purpose: they vary widely among good documents, and a Gaussian takes
#: every outlier for the broader class.
FEATURES = ("words", "upper", "bangs", "symbols", "echo")


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text: counts and lengths as logarithms, shares through the arcsine of their root.

    Shares are damped by a few counts, so one odd word of a very short text isn't a high share.
    """
    w = words(raw, offsets, BLANKS)
    n = np.diff(w.bounds)
    byte = {k: _per_text(_CLASSES[raw, k], offsets) for k in range(4)}
    share = lambda part, whole, damp=4: np.arcsin(np.sqrt(part / (np.maximum(whole, part) + damp)))
    same = np.zeros(len(w.hashes), bool)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[w.bounds[:-1][w.bounds[:-1] < len(same)]] = False
    return np.column_stack([np.log1p(n), share(byte[_UPPER], byte[_LETTER], 20), share(byte[_BANG], n), share(byte[_SYMBOL], n), share(_per_text(same, w.bounds), n)])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray  # class, feature
    half: np.ndarray  # class, feature, feature: inverses of the Cholesky factors, lower triangles
    log_det: np.ndarray  # of the factors
    log_prior: np.ndarray
    center: np.ndarray
    scale: np.ndarray

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        out = []
        for k in (0, 1):
            u = (z - self.mean[k]) @ self.half[k].T
            out.append(self.log_prior[k] - 0.5 * (u * u).sum(1) - self.log_det[k])
        return np.column_stack(out)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        d = self.log_density(x)
        return 1 / (1 + np.exp(np.clip(d[:, 0] - d[:, 1], -500, 500)))


def inverse_factor(chol: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangle, row by row."""
    out = np.zeros_like(chol)
    for i in range(len(chol)):
        out[i, : i + 1] = (np.eye(len(chol))[i, : i + 1] - chol[i, :i] @ out[:i, : i + 1]) / chol[i, i]
    return out


def fit_sums(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Model:
    """Model from count, sum and sum of outer products of each class.  A class without rows gets the other's shape and an even prior."""
    d = len(FEATURES)
    none = (0.0, np.zeros(d), np.zeros((d, d)))
    parts = [sums.get(k, none) for k in (0, 1)]
    n = sum(p[0] for p in parts)
    center = sum(p[1] for p in parts) / max(n, 1)
    pooled = sum(p[2] for p in parts) / max(n, 1) - np.outer(center, center)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9)) if n else np.ones(d)
    mean, chol = np.zeros((2, d)), np.zeros((2, d, d))
    for k, (count, first, second) in enumerate(parts):
        if count:
            m = first / count
            mean[k] = (m - center) / scale
            cov = (second / count - np.outer(m, m)) / np.outer(scale, scale)
        else:
            cov = np.eye(d)
        cov = (1 - shrinkage) * cov + shrinkage * np.eye(d) * max(np.trace(cov) / d, 0.05)
        chol[k] = np.linalg.cholesky((cov + cov.T) / 2 + 1e-6 * np.eye(d))
    prior = np.log(np.array([p[0] + 1.0 for p in parts]) / (n + 2))
    return Model(mean, np.stack([inverse_factor(c) for c in chol]), np.array([np.log(np.diag(c)).sum() for c in chol]), prior, center, scale)


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and the feature vector of ``text``."""

    def run(batches):
        for part in slices(batches, limit=SLICE):
            x = features(*text_bytes(part.column("text")))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows], names=["doc_id", "__x"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("__x", T.ArrayType(T.DoubleType()))]))


def crc_fold(doc_id, folds: int):
    """crc32 of the id's text modulo ``folds``; a null id counts as empty text, so it is in fold 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def fit(vectors: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """vectors: doc_id, __x.  Every label row of a training document counts once; null labels and ids are left out."""
    d = len(FEATURES)
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("y"))
    train = vectors.filter(crc_fold(F.col("doc_id"), FOLDS) != 0).join(known, "doc_id").select("y", "__x")
    x = [F.col("__x")[i] for i in range(d)]
    low = [(i, j) for i in range(d) for j in range(i + 1)]
    # Built-in sums: where the join is a broadcast one, a second Python function would keep a second worker for each core, from then on.
    rows = train.groupBy("y").agg(F.count("*"), *(F.sum(c) for c in x), *(F.sum(x[i] * x[j]) for i, j in low)).collect()  # a row a class
    sums = {}
    for y, count, *values in map(tuple, rows):
        second = np.zeros((d, d))
        for (i, j), v in zip(low, values[d:], strict=True):
            second[i, j] = second[j, i] = v
        sums[y] = (float(count), np.array(values[:d]), second)
    return fit_sums(sums, shrinkage)


def _scored(docs: DataFrame, model: Model, keep: list[str], threshold: float, vectors_of) -> DataFrame:
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b, x in vectors_of(batches):
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def score_vectors(vectors: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of stored vectors."""
    return _scored(vectors, model, ["doc_id"], threshold, lambda batches: ((b, b.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))) for b in batches))


def score_texts(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns of texts with score and predicted."""
    return _scored(docs.select(*dict.fromkeys([*keep, "text"])), model, keep, threshold, lambda batches: ((b, features(*text_bytes(b.column("text")))) for b in slices(batches, limit=SLICE)))


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with held_out, score (0 to 1) and predicted.

    Null and empty texts get the score of a text without words; repeated rows score alike; an input column named like an output
    is replaced.  Without usable labels the score is an even one.  An empty table gives an empty result.
    """
    names = [c for c in (keep or docs.columns) if c not in {"held_out", "score", "predicted"}]
    docs = plainly_named(docs, list(dict.fromkeys([*names, "doc_id", "text"])))
    keep = docs.columns[: len(names)]
    scratch = Scratch(docs.sparkSession)
    if keep == ["doc_id"]:  # every text is taken apart once, for the fit and the scores
        vectors = scratch.table(with_features(docs), "vectors")
        scored = score_vectors(vectors, fit(vectors, labels))
    else:  # texts with other columns stay where they are: only training rows are taken apart for the fit
        scored = score_texts(docs, fit(with_features(docs.filter(crc_fold(F.col("doc_id"), FOLDS) != 0)), labels), list(dict.fromkeys([*keep, "doc_id"])))
    return scored.withColumn("held_out", crc_fold(F.col("doc_id"), FOLDS) == 0).select(*keep, "held_out", "score", "predicted").toDF(*names, "held_out", "score", "predicted")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, ["doc_id"]).select("doc_id", "held_out", "score", "predicted")
