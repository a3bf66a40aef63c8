"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words, lower-cased and hashed into ``WORD_BINS`` places
and weighted by how few of all documents hold the place; the triples of its
character classes (letters by case, digits, blanks, line ends and the common
marks each have a class); and how often words repeat at once and how few
distinct words there are.  Weights are square roots of frequencies, as usual for
latent semantics, and a truncated singular value decomposition of the labelled
rows gives the space.  The labelled vectors are broadcast (``GOOD_ROWS`` +
``BAD_ROWS`` at most), every document's cosine with each of them is computed in
blocks, and the ``VOTES`` nearest vote with their label, weighted by similarity.

Defined results: a null or empty text has no direction and gets the share of
good labels; with no labels at all the score is 0.5; repeated rows get the same
score; of neighbours that are equally near the one that was fitted first votes
(fitted rows are ordered by label, then weights); other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import labelled
from .arrowtext import BYTE_VALUE, prefix_hashes, span_hashes, text_runs, word_spans
from .tables import read

#: Labelled rows to fit on, of each label.
GOOD_ROWS, BAD_ROWS = 3500, 700
DIMENSIONS = 48
VOTES = 7
SHARPNESS = 8
THRESHOLD = 0.3
#: Documents whose weights are held at a time.
BLOCK_ROWS = 256

#: Marks with a class of their own.
MARKS = ".,!|%$&#"
CLASSES = 5 + len(MARKS) + 1
TRIPLES = CLASSES**3
STYLE = 24
#: Places of hashed words, and how much they weigh beside the other terms.
WORD_BINS = 2048
WORD_SHARE = 1.0
TERMS = TRIPLES + STYLE + WORD_BINS

_classes = np.full(256, CLASSES - 1, np.int64)
_classes[[9, 32]] = 3
_classes[[10, 13]] = 4
_classes[48:58] = 2
_classes[65:91] = 1
_classes[97:123] = 0
_classes[128:] = 0
for _i, _c in enumerate(MARKS, 5):
    _classes[ord(_c)] = _i
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_separators = np.ones(256, bool)
_separators[[32, 9, 10, 11, 12, 13]] = False


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words as they are and of their places, and the first word of each text."""
    start, stop, words = word_spans(data, offsets, _separators)
    hashes = span_hashes(prefix_hashes(BYTE_VALUE[data]), start, stop)
    low = span_hashes(prefix_hashes(BYTE_VALUE[_lower[data]]), start, stop)
    return hashes, (low % np.uint64(WORD_BINS)).astype(np.int64), words


def word_rarity(docs: DataFrame) -> np.ndarray:
    """For each place of hashed words the logarithm of how few of all documents hold it, 1 on average."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(WORD_BINS, np.int64), 0
        for batch in batches:
            for first, end, data, offsets in text_runs(batch.column(0)):
                _, bins, words = _words(data, offsets)
                owner = np.repeat(np.arange(end - first), np.diff(words))
                held += np.bincount(np.unique(owner * WORD_BINS + bins) % WORD_BINS, minlength=WORD_BINS)
                n += end - first
        yield pa.RecordBatch.from_arrays([pa.array(range(WORD_BINS + 1), pa.int64()), pa.array(np.append(held, n))], ["place", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(WORD_BINS + 1)
    total[found["place"].to_numpy(np.int64)] = found["n"]
    rarity = np.log((total[-1] + 1) / (total[:-1] + 1)) + 0.1
    return (rarity / rarity.mean()).astype(np.float32)


def term_weights(column: pa.Array, rarity: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of term weights, a block of documents at a time."""
    for first, end, data, offsets in text_runs(column, rows=BLOCK_ROWS):
        kinds = _classes[data]
        triples = (kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:] if len(kinds) > 2 else kinds[:0]
        hashes, bins, words = _words(data, offsets)
        out = np.zeros((end - first, TERMS), np.float32)
        for i in range(end - first):
            a, b = offsets[i], offsets[i + 1]
            if b - a > 2:
                out[i, :TRIPLES] = np.bincount(triples[a : b - 2], minlength=TRIPLES)
                out[i, :TRIPLES] /= b - a
            own = hashes[words[i] : words[i + 1]]
            if len(own):
                again = np.mean(own[1:] == own[:-1]) if len(own) > 1 else 0.0
                _, counts = np.unique(own, return_counts=True)
                style = out[i, TRIPLES : TRIPLES + STYLE]
                style[0] = again
                style[1 + min(6, int(again * 7))] = 0.1 if again else 0.0
                style[8 + min(7, int(len(counts) / len(own) * 8))] = 0.05
                style[16 + min(7, int(counts.max() / len(own) * 8))] = 0.05
                out[i, TRIPLES + STYLE :] = np.bincount(bins[words[i] : words[i + 1]], minlength=WORD_BINS) / len(own)
        out = np.sqrt(out)
        out[:, TRIPLES + STYLE :] *= WORD_SHARE * rarity
        yield out


class LatentNeighbours:
    """The fitted space, its labelled vectors and their labels."""

    def __init__(self, weights: np.ndarray, labels: np.ndarray, rarity: np.ndarray, dimensions: int = DIMENSIONS) -> None:
        self.rarity = rarity
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        self.axes = self._axes(weights, dimensions)
        self.vectors = self.project(weights)

    @staticmethod
    def _axes(weights: np.ndarray, dimensions: int) -> np.ndarray:
        """Leading right singular vectors, by subspace iteration from a fixed start."""
        width = weights.shape[1]
        k = min(dimensions, *weights.shape)
        if not k:
            return np.zeros((width, 1), np.float32)
        basis = np.random.default_rng(7).standard_normal((width, k)).astype(np.float32)
        for _ in range(6):
            basis, _ = np.linalg.qr(weights.T @ (weights @ basis))
        return basis.astype(np.float32)

    def project(self, weights: np.ndarray) -> np.ndarray:
        at = weights @ self.axes
        return at / np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-12)

    @staticmethod
    def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
        """Numbers of the ``k`` greatest of each row; of equals the least numbers."""
        least = -np.partition(-cosine, k - 1, axis=1)[:, [k - 1]]
        above = cosine > least
        room = k - above.sum(1, keepdims=True)
        equal = cosine == least
        chosen = above | (equal & (np.cumsum(equal, axis=1) <= room))
        return np.nonzero(chosen)[1].reshape(len(cosine), k)

    def vote(self, weights: np.ndarray, votes: int = VOTES, block: int = 512) -> np.ndarray:
        scores = np.full(len(weights), self.prior)
        if not len(self.labels):
            return scores
        k = min(votes, len(self.labels))
        for a in range(0, len(weights), block):
            cosine = self.project(weights[a : a + block]) @ self.vectors.T
            nearest = self.nearest(cosine, k)
            weight = np.clip(np.take_along_axis(cosine, nearest, 1), 0, 1).astype(float) ** SHARPNESS
            total = weight.sum(1)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = (weight * self.labels[nearest]).sum(1) / total
            scores[a : a + block] = np.where(total > 0, np.clip(mean, 0, 1), self.prior)
        return scores


def fit(docs: DataFrame, labels: DataFrame, good_rows: int = GOOD_ROWS, bad_rows: int = BAD_ROWS) -> LatentNeighbours:
    """Fit on a sample of at most ``good_rows`` + ``bad_rows`` labelled rows (the driver holds their term weights)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in term_weights(batch.column(0), rarity):
                yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in block], pa.binary()), batch.column(1).slice(at, len(block))], ["weights", "label"])
                at += len(block)

    rarity = word_rarity(docs)
    rows = labelled.sample(docs, labels, "quality", {1: good_rows, 0: bad_rows}).select("text", "label")
    rows = rows.mapInArrow(weigh, "weights binary, label int").toPandas().sort_values(["label", "weights"])
    weights = np.array([np.frombuffer(x, np.float32) for x in rows["weights"]], np.float32).reshape(len(rows), TERMS)
    return LatentNeighbours(weights, rows["label"].to_numpy(), rarity)


def score(docs: DataFrame, model: LatentNeighbours, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [shared.value.vote(block) for block in term_weights(batch.column(2), shared.value.rarity)]
            found = np.concatenate(blocks) if blocks else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), labelled.held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(judge, "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
