"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its words (hashed to ``TERMS`` places, weighted by their rarity in the sample) and
its byte-class bigrams, which stand for words not seen before; a few shape figures join them. A
bounded sample of labelled rows (``SAMPLE`` at most) gives the rarities, a truncated SVD and the
labelled vectors, which are sent to all tasks. Every whole text is projected and compared with all of
them by exact cosine products, block by block; its nearest neighbours, ties by the smaller doc_id,
vote with their similarity as weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textkit import string_slices, word_hashes, word_spans

SAMPLE = 3072
DIMENSIONS = 48
NEIGHBOURS = 15
SHARPNESS = 8
BLOCK = 512
_CLASSES = 64
SHAPES = 8
TERMS = 1 << 11
TERM_WEIGHT = 0.5
WIDTH = TERMS + _CLASSES * _CLASSES + SHAPES


def _byte_classes() -> np.ndarray:
    """a-z apart, A-Z as one, digits as one, each ASCII mark apart, line end, other space, other bytes by two bits."""
    table = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        if "a" <= c <= "z":
            table[b] = b - 97
        elif "A" <= c <= "Z":
            table[b] = 26
        elif "0" <= c <= "9":
            table[b] = 27
        elif c == "\n":
            table[b] = 28
        elif b <= 32 or b == 127:
            table[b] = 29
        elif b >= 128:
            table[b] = 30 + (b >= 192)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    table[marks] = 32 + np.arange(len(marks))
    return table


_CLASS = _byte_classes()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``WIDTH`` features for each text: square roots of word and of bigram shares, then shape figures."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)
    cls = _CLASS[data]
    starts, ends, first = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends)
    for i in range(n):
        a, b = offsets[i], offsets[i + 1]
        if b - a < 1:
            continue
        c = cls[a:b]
        pair = np.bincount(c[:-1] * _CLASSES + c[1:], minlength=_CLASSES * _CLASSES)
        out[i, TERMS:-SHAPES] = np.sqrt(pair / max(1, pair.sum()))
        one = np.bincount(c, minlength=_CLASSES) / (b - a)
        lo, hi = first[i], first[i + 1]
        m = hi - lo
        term = np.bincount((hashes[lo:hi] & np.uint64(TERMS - 1)).astype(np.int64), minlength=TERMS)
        out[i, :TERMS] = np.sqrt(term / max(1, m))
        grams = hashes[lo : hi - 2] + 3 * hashes[lo + 1 : hi - 1] + 9 * hashes[lo + 2 : hi] if m > 2 else np.zeros(0, np.uint64)
        repeated = 1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0
        length = (ends[lo:hi] - starts[lo:hi]).mean() if m else 0.0
        out[i, -SHAPES:] = (repeated, one[26], one[27], one[32:].sum(), one[28], min(length, 20) / 20, 1 - len(np.unique(hashes[lo:hi])) / max(1, m), min(np.log1p(m), 12) / 12)
    return out


class NeighbourModel:
    """Projection, labelled unit vectors and labels; a prior for texts without features. ``rows`` are taken over and changed."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        seen = (rows[:, :TERMS] > 0).sum(0)
        rarity = np.log((1 + len(rows)) / (1 + seen)) / max(np.log(1 + len(rows)), 1.0)
        self.scale = np.concatenate((TERM_WEIGHT * rarity, np.ones(WIDTH - TERMS))).astype(np.float32)
        rows *= self.scale  # in place: the rows are the largest thing on the driver
        self.mean = rows.mean(0) if len(rows) else np.zeros(WIDTH, np.float32)
        rows -= self.mean
        self.labels = labels.astype(np.float32)
        self.basis = self._basis(rows)
        self.vectors = self._unit(rows)

    @staticmethod
    def _basis(rows: np.ndarray) -> np.ndarray:
        """The leading right singular vectors, by subspace iteration from a seeded start."""
        k = min(DIMENSIONS, len(rows))
        q = np.random.default_rng(7).standard_normal((rows.shape[1], k + 16)).astype(np.float32)
        for _ in range(4):
            q, _ = np.linalg.qr(rows.T @ (rows @ q)) if len(rows) else (q, 0)
        if not len(rows):
            return q[:, :0]
        _, _, v = np.linalg.svd(rows @ q, full_matrices=False)
        return (q @ v[:k].T).astype(np.float32)

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Unit vectors of rows of features."""
        return self._unit(rows * self.scale - self.mean)

    def _unit(self, centred: np.ndarray) -> np.ndarray:
        v = centred @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(rows), BLOCK):
            block = rows[at : at + BLOCK]
            cosine = self.project(block) @ self.vectors.T
            least = np.partition(cosine, -k, axis=1)[:, -k, None]
            above, tied = cosine > least, cosine == least
            near = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(1, keepdims=True)))
            weight = np.where(near, np.maximum(cosine, 1e-3) ** SHARPNESS, 0)
            vote = (weight * self.labels).sum(1) / weight.sum(1)
            full = np.abs(block).sum(1) > 0
            out[at : at + BLOCK][full] = vote[full]
        return np.clip(out, 0.0, 1.0)


def _fold():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> NeighbourModel:
    """Learn from at most ``SAMPLE`` labelled rows outside the held-out fold, chosen by hash of the id.

    Rows of ``labels`` (doc_id, quality) with a null are passed over; of repeated ids one counts, chosen
    where the rows are, so that no more than the sample comes to the driver.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().filter(~_fold())
    own = own.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def featured(batches):
        for batch in batches:
            for row, end, data, offsets in string_slices(batch.column(2)):
                rows = features(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary())], ["doc_id", "quality", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id").select("doc_id", "quality", "text")
    one = rows.mapInArrow(featured, "doc_id long, quality int, x binary").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("x").alias("x"))
    got = one.toPandas().sort_values("doc_id", kind="stable")  # at most SAMPLE rows
    x = np.stack([np.frombuffer(v, np.float16) for v in got["x"]]).astype(np.float32) if len(got) else np.zeros((0, WIDTH), np.float32)
    return NeighbourModel(x, got["quality"].to_numpy())


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: quality 1 likelier), predicted of every row of ``docs``.

    Null and empty texts get the sample's share of label 1. Null ids count as not held out; repeated
    rows are scored alike; other columns are ignored; without labels every score is 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def score(batches):
        for batch in batches:
            for row, end, data, offsets in string_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(model.value.scores(features(data, offsets)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", _fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores at least ``threshold``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            for row, end, data, offsets in string_slices(batch.column(at)):
                yield batch.slice(row, end - row).filter(pa.array(model.value.scores(features(data, offsets)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
