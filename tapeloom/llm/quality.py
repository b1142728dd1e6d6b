"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are 0 (low quality), 1 (good but toxic) and 2 (good and clean). A document is the set of hashes of its tokens (lower-cased
runs of letters, digits or signs) and a token for the share of tokens that repeat the one before. One weight vector is shared by all
grades: P(grade > k) = sigmoid(w.x - threshold_k) with ordered thresholds, which gives the expected grade and the
tail probability P(grade = 2) used for selection. Only hashes whose presence moves the grades away from their base rates are
given weights (``LEAST_GAIN``, in nats; ``LEAST_DOCS`` documents), so that chance words of single documents carry none.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, chosen by a hash of doc_id); every
document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ASCII_LOWER, LETTERS_DIGITS_SIGNS, hash_batches

BUCKETS = 1 << 18
REPEAT_BINS = 5
SAMPLE_ROWS = 16_000
LEAST_GAIN, LEAST_DOCS, RIDGE, STEPS, RATE = 0.25, 8, 1e-5, 300, 0.2
GRADES = 3
CUT = 0.5


def _features(texts: list[bytes | None]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The feature ids of each text, in runs of texts; a text without tokens has none."""
    lowered = [(t or b"").translate(ASCII_LOWER) for t in texts]
    for first, last, tokens, offsets in hash_batches(lowered, LETTERS_DIGITS_SIGNS):
        out = []
        for i in range(last - first):
            own = tokens[offsets[i] : offsets[i + 1]]
            ids = np.unique(own % np.uint64(BUCKETS)).astype(np.int32)
            if len(own):
                share = (own[1:] == own[:-1]).mean() if len(own) > 1 else 0.0
                ids = np.append(ids, np.int32(BUCKETS + min(int(share * 10), REPEAT_BINS - 1)))
            out.append(ids)
        yield first, out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, own in _features(batch.column("text").to_pylist()):
            yield pa.record_batch([batch.column("grade").slice(first, len(own)), pa.array([x.tolist() for x in own], pa.list_(pa.int32()))], names=["grade", "ids"])


class Model:
    """Weights by feature id (0 for those left out) and ordered thresholds."""

    def __init__(self, weights: np.ndarray, used: np.ndarray, thresholds: np.ndarray):
        self.weights, self.used, self.thresholds = weights, used, thresholds

    def tails(self, ids: list[np.ndarray]) -> np.ndarray:
        """P(grade > k) for k = 0 .. GRADES - 2, one row a document."""
        f = np.empty(len(ids))
        for i, own in enumerate(ids):
            own = own[self.used[own]]
            f[i] = self.weights[own].sum() / np.sqrt(max(1, len(own)))
        return 1 / (1 + np.exp(-np.clip(f[:, None] - self.thresholds[None, :], -40, 40)))


def fit(grades: np.ndarray, ids: list[np.ndarray]) -> Model | None:
    """Ridge-penalised maximum likelihood by full-batch Adam; None unless two grades are present."""
    if len(np.unique(grades)) < 2:
        return None
    width = BUCKETS + REPEAT_BINS
    base = np.bincount(grades, minlength=GRADES) / len(grades)
    flat, owner = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    seen = np.bincount(flat.astype(np.int64) * GRADES + grades[owner], minlength=width * GRADES).reshape(width, GRADES)
    docs = seen.sum(axis=1)
    share = (seen + 5 * base) / (docs[:, None] + 5)
    gain = np.where(share > 0, share * np.log(np.maximum(share, 1e-12) / np.maximum(base, 1e-12)), 0).sum(axis=1)
    used = (gain > LEAST_GAIN) & (docs >= LEAST_DOCS)
    keep = used[flat]
    flat, owner = flat[keep], owner[keep]
    number = np.cumsum(used) - 1
    column, n_used = number[flat], int(used.sum())
    counts = np.bincount(owner, minlength=len(ids))
    value = 1 / np.sqrt(np.maximum(1, counts))[owner]
    at_least = np.clip(np.array([base[k + 1 :].sum() for k in range(GRADES - 1)]), 1e-3, 1 - 1e-3)
    params = np.concatenate((np.zeros(n_used), -np.log(at_least / (1 - at_least))))
    m, v, rows = np.zeros_like(params), np.zeros_like(params), np.arange(len(ids))
    for step in range(1, STEPS + 1):
        w, theta = params[:n_used], params[n_used:]
        f = np.bincount(owner, w[column] * value, len(ids))
        tail = 1 / (1 + np.exp(-np.clip(f[:, None] - theta[None, :], -40, 40)))
        upper = np.concatenate((np.ones((len(ids), 1)), tail, np.zeros((len(ids), 1))), axis=1)
        slope = upper * (1 - upper)
        p = np.maximum(upper[rows, grades] - upper[rows, grades + 1], 1e-9)
        pull = -(slope[rows, grades] - slope[rows, grades + 1]) / p
        grad_w = np.bincount(column, pull[owner] * value, n_used) / len(ids) + RIDGE * w
        grad_t = [(slope[:, k + 1] / p * ((grades == k + 1).astype(float) - (grades == k))).sum() / len(ids) for k in range(GRADES - 1)]
        grad = np.concatenate((grad_w, grad_t))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        params[n_used:].sort()
    weights = np.zeros(width)
    weights[used] = params[:n_used]
    return Model(weights, used, params[n_used:])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on about ``sample_rows`` labelled documents; a document labelled more than once takes its lowest grade.

    A label without doc_id or quality teaches nothing, one without toxic counts as clean. Of rows that share a labelled doc_id one is taken, so the
    sample is bounded in rows.
    """
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    rated = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    n = rated.count()
    if n > sample_rows:
        rated = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
    named = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(rated), "doc_id")
    sample = named.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("grade", "text")
    got = sample.mapInArrow(_extract, "grade int, ids array<int>").toArrow()
    if not got.num_rows:
        return None
    ids = got.column("ids").combine_chunks()
    flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
    return fit(got.column("grade").to_numpy().astype(np.int64), [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)])


def _scored(docs: DataFrame, model: Model | None) -> tuple[DataFrame, list[str]]:
    """The columns of ``docs`` under neutral names, which are returned too, with ``expected_grade`` and ``p_high``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    if model is None:
        return docs.toDF(*names).withColumns({"expected_grade": F.lit(None).cast("double"), "p_high": F.lit(None).cast("double")}), names
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids in _features([None if t is None else t.encode() for t in batch.column(text).to_pylist()]):
                tails = shared.value.tails(ids)
                part = batch.slice(first, len(ids))
                yield pa.record_batch([*part.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], names=[*names, "expected_grade", "p_high"])

    fields = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True)]
    return docs.toDF(*names).mapInArrow(run, ", ".join([*fields, "expected_grade double", "p_high double"])), names


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``expected_grade``, ``p_high`` and ``kept``; columns of ``docs`` with these names are replaced.

    Without a model (no labels, or of one grade only) both figures are null and all documents are kept. Null, empty and wordless texts
    have no features and score by the thresholds alone. Repeated rows score alike.
    """
    docs = docs.drop("expected_grade", "p_high", "kept")
    scored, names = _scored(docs, train(docs, labels))
    kept = F.coalesce(F.col("p_high") >= CUT, F.lit(True)).alias("kept")
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)], "expected_grade", "p_high", kept)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with all their columns and no other."""
    scored, names = _scored(docs, train(docs, labels))
    good = scored.where(F.coalesce(F.col("p_high") >= CUT, F.lit(True)))
    return good.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
