"""Language identification by string kernels.

A text is the set of its character n-grams, n = 1 to 3, hashed to ``WIDTH`` presence bits. The blended-spectrum presence
kernel of two texts is the number of common bits over the geometric mean of their numbers. Nystroem landmarks (some texts of each language) turn kernel values
into features, on which one-versus-rest kernel ridge regression is solved in closed form. A batch of texts is scored by two matrix
products: presence by landmarks, and kernel values by coefficients.

The model is fitted on a bounded sample: ``TRAIN_PER_LANGUAGE`` texts a language, or fewer so that there are ``MAX_TEXTS`` in all, but one of each
language at least, chosen by a hash of doc_id and text. Every language is learned. Every text is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key

WIDTH_BITS, ORDERS = 14, 3
WIDTH = 1 << WIDTH_BITS
LANDMARKS, TRAIN_PER_LANGUAGE, MAX_TEXTS = 128, 500, 20_000
RIDGE = 1e-2
#: Hashes that choose training rows fall below this.
RANGE = 1_000_000_000
#: Characters taken at a time, and texts of a batch.
PIECE, BATCH = 1 << 19, 128
UNKNOWN = "und"
_MULTIPLIERS = (2_654_435_761, 2_246_822_519, 3_266_489_917)


def _mark(row: np.ndarray, text: str) -> None:
    """Set the presence bits of ``text`` in ``row``, piece by piece."""
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[max(0, at - ORDERS + 1) : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(c), np.uint32)
        for n in range(ORDERS):
            h = (h[: len(c) - n] + c[n:] + np.uint32(n + 1)) * np.uint32(_MULTIPLIERS[n])
            h ^= h >> np.uint32(15)
            row[(h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - WIDTH_BITS)] = True


def presence(texts: list[str | None]) -> np.ndarray:
    bits = np.zeros((len(texts), WIDTH), bool)
    for i, text in enumerate(texts):
        if text:
            _mark(bits[i], text)
    return bits


def _presence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            bits = np.packbits(presence(part.column("text").to_pylist()), axis=1)
            yield pa.record_batch([part.column("lang"), part.column("r"), pa.array([b.tobytes() for b in bits], pa.binary())], names=["lang", "r", "bits"])


class Model:
    """Landmark bits, their norms, and the coefficients of each language."""

    def __init__(self, landmarks: np.ndarray, coefficients: np.ndarray, languages: list[str]):
        self.landmarks, self.coefficients, self.languages = landmarks, coefficients, languages
        self.norms = np.sqrt(np.maximum(1, landmarks.sum(axis=0)))

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        x = bits.astype(np.float32)
        own = np.sqrt(np.maximum(1, x.sum(axis=1)))
        return (x @ self.landmarks) / own[:, None] / self.norms[None, :]

    def predict(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language (the first by name on a tie) and its score from 0 to 1."""
        f = self.kernel(bits) @ self.coefficients[:-1] + self.coefficients[-1]
        best = f.argmax(axis=1)
        return best, np.clip((1 + f[np.arange(len(f)), best]) / 2, 0, 1)


def fit(bits: np.ndarray, names: list[str], rank: list[int]) -> Model | None:
    """Closed-form one-versus-rest ridge regression on Nystroem features; ``rank`` orders the texts of a language.

    Landmarks are the first texts of each language, as many as make ``LANDMARKS`` in all, and one at least.
    """
    languages = sorted(set(names))
    if not languages:
        return None
    share = max(1, LANDMARKS // len(languages))
    marks = bits[np.array(rank) <= share].astype(np.float32).T
    model = Model(marks, np.zeros((marks.shape[1] + 1, len(languages))), languages)
    values, vectors = np.linalg.eigh(model.kernel(marks.T > 0).astype(np.float64))
    good = values > values.max() * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate((model.kernel(bits) @ root, np.ones((len(bits), 1))), axis=1)
    target = np.where(np.array(names)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    penalty = RIDGE * np.eye(features.shape[1])
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(features.T @ features + penalty, features.T @ target)
    model.coefficients = np.concatenate((root @ weights[:-1], weights[-1:]))
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame) -> Model | None:
    """Fit on (doc_id, text, lang); rows without language or letters teach nothing. None if nothing is left."""
    usable = docs.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = [(r[0], r[1]) for r in usable.groupBy("lang").agg(F.approx_count_distinct(row_key()[1])).collect()]  # a row a language
    if not counts:
        return None
    each = min(TRAIN_PER_LANGUAGE, max(1, MAX_TEXTS // len(counts)))
    # the rows of least hash are taken: about four times as many (of repeated rows one) pass a bound on the hash, and only these are ranked, without their texts
    enough = max(64, 4 * each)
    bounds = docs.sparkSession.createDataFrame([(name, enough * RANGE // n if n > enough else RANGE) for name, n in counts], "lang string, below long")
    keyed = usable.select("doc_id", "text", "lang", *row_key()).join(F.broadcast(bounds), "lang")
    keyed = keyed.withColumn("u", F.pmod("k2", F.lit(RANGE))).where("u < below")
    order = Window.partitionBy("lang").orderBy("u", "k1", "k2")
    ranked = keyed.select("lang", "u", "k1", "k2").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= each)
    chosen = keyed.join(F.broadcast(ranked.groupBy("k1", "k2").agg(F.min("r").alias("r"))), ["k1", "k2"])
    got = chosen.dropDuplicates(["k1", "k2"]).select("lang", "r", "text").mapInArrow(_presence_rows, "lang string, r int, bits binary").toArrow()
    bits = np.unpackbits(np.frombuffer(b"".join(got.column("bits").to_pylist()), np.uint8).reshape(got.num_rows, -1), axis=1).astype(bool)
    return fit(bits, got.column("lang").to_pylist(), got.column("r").to_pylist())


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with ``lang_pred`` and ``score``.

    A null text, one without letters, or any text without a model is ``und`` with score 0. Texts of any length are read whole,
    in pieces; repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(keep))]
    renamed = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], "text", has_letter(F.col("text")).alias("has_letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                known = np.array(part.column("has_letter").to_pylist(), bool) & (own is not None)
                pred, score = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if known.any():
                    texts = part.column("text").to_pylist()
                    best, score[known] = own.predict(presence([texts[i] for i in np.flatnonzero(known)]))
                    pred[known] = [own.languages[b] for b in best]
                columns = [part.column(n) for n in names]
                yield pa.record_batch([*columns, pa.array(pred.tolist(), pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    fields = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)]
    out = renamed.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double"]))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "lang_pred", "score")


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id's text falls into the held-out part; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))
