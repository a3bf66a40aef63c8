"""Importance resampling: documents drawn in proportion to how much more likely the target tables make their n-grams.

Features are runs of one to three words, hashed (CRC-32) into ``BUCKETS``
places.  A first pass over each table counts features by place: every task
adds up one vector with ``np.bincount``, and ``treeReduce`` merges the vectors,
80 KB each, whatever the input.  The gain of a place is the logarithm of its share in the
target against its share in the documents; a second pass gathers the broadcast
gains and sums them by document.  With Gumbel noise from a hash of the
document's id, the greatest scores are a draw without replacement.

Word and n-gram checksums are array operations: a word's CRC goes byte by byte
through all words at once, and the CRC of joined texts follows from those of
its parts, by one table for each length.

Defined results: null and empty texts have no words, no features and weight 0;
a null doc_id counts as an empty one in the noise; repeated rows are scored
alike and each is ranked (of equal rows, the earlier stored one first); documents with fewer
than ``LEAST_WORDS`` words are never drawn; with an empty target the gains
follow from its zero counts; an empty table gives no rows; other columns are
not carried.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialise, numbered
from .arrowtext import text_runs, word_spans
from .tables import read

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
#: Documents of a hundred long enough ones that are drawn.
PERCENT = 5
SEED = 42

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_is_word = np.zeros(256, bool)
_is_word[0x30:0x3A] = _is_word[0x61:0x7B] = _is_word[0x80:] = True
#: Words up to this length have a table of their own that moves a checksum over them.
_TABLED = 48


def _byte_table() -> np.ndarray:
    """CRC-32's table for one byte, from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_byte = _byte_table()


def _zeros_table(n: int) -> np.ndarray:
    """4 tables of 256: what each byte of a checksum becomes when ``n`` zero bytes follow."""
    out = np.empty((4, 256), np.uint32)
    for k in range(4):
        crc = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(n):
            crc = _byte[crc & 255] ^ (crc >> np.uint32(8))
        out[k] = crc
    return out


_zeros = np.stack([_zeros_table(n) for n in range(_TABLED + 1)]).reshape(-1)


def _over(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``crc`` moved over ``n`` zero bytes, element by element."""
    base = np.minimum(n, _TABLED).astype(np.int32) << 10
    out = _zeros[base + (crc & 255)]
    for k in (1, 2, 3):
        out ^= _zeros[base + ((k << 8) + ((crc >> np.uint32(8 * k)) & 255))]
    more = np.flatnonzero(n > _TABLED)
    if len(more):
        out[more] = _over(out[more], n[more] - _TABLED)
    return out


def joined(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 of texts put together, from those of both parts and the second one's length."""
    return _over(first, n) ^ second


def word_checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray, first: int = 0xFFFFFFFF) -> np.ndarray:
    """CRC-32 of many spans; ``first`` is the register before them."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order], size[order]
    crc = np.full(len(order), first, np.uint32)
    long = int(np.searchsorted(-left, -256, "right"))
    for i in range(long):  # a few words of 256 bytes and more
        text = data[at[i] : at[i] + left[i]].tobytes()
        crc[i] = zlib.crc32(text, first ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    live = len(order)
    for k in range(256):
        live = int(np.searchsorted(-left[:live], -k, "left"))
        if live <= long:
            break
        some = slice(long, live)
        crc[some] = _byte[(crc[some] ^ data[at[some] + k]) & 255] ^ (crc[some] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def features(data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each feature, its text's number, number of words of each text) of a run of texts."""
    low = _lower[data]
    start, end, words = word_spans(low, offsets, _is_word)
    size = end - start
    owner = np.repeat(np.arange(len(words) - 1), np.diff(words))
    plain = word_checksums(low, start, size)
    # with the blank before it
    spaced = joined(np.full(len(plain), zlib.crc32(b" "), np.uint32), plain, size)
    places, owners, crc = [plain % np.uint32(buckets)], [owner], plain
    for k in range(1, longest):
        crc = joined(crc[:-1], spaced[k:], size[k:] + 1) if len(crc) else crc
        inside = owner[k:] == owner[: len(owner) - k] if len(owner) > k else np.zeros(0, bool)
        places.append((crc % np.uint32(buckets))[inside])
        owners.append(owner[: len(inside)][inside])
    return np.concatenate(places).astype(np.int64), np.concatenate(owners), np.diff(words)


def feature_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> np.ndarray:
    """How often each place occurs in all texts of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_runs(batch.column(0)):
                held += np.bincount(features(data, offsets, longest, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select(F.col("text").cast("string")).mapInArrow(count, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return vectors.map(lambda row: np.frombuffer(row[0], np.int64)).treeReduce(np.add)


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each place is in the target, rounded down; one is added to all counts."""
    t, s, n = int(target.sum()), int(source.sum()), len(target)
    ratio = [((a + 1.0) * (s + n)) / ((b + 1.0) * (t + n)) for a, b in zip(target.tolist(), source.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.float64)


def weigh(docs: DataFrame, by: np.ndarray, longest: int = LONGEST_RUN) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of gains) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(by)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            out = []
            for _, _, data, offsets in text_runs(batch.column(1)):
                place, owner, words = features(data, offsets, longest, len(gain))
                out.append((words, np.bincount(owner, minlength=len(words)), np.bincount(owner, gain[place], len(words)).astype(np.int64)))
            columns = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``weighed`` with score and rank: the highest scores of long enough documents are drawn, without replacement.

    Rows are dealt in order into ranges; each numbers its own, and what stands
    before it comes from one count for each range.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("long", F.col("n_words") >= least_words)
    scored = numbered(materialise(scored, "scored"))
    order = [F.desc("long"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("__row")]
    dealt = materialise(scored.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranked")
    ranges = dealt.groupBy("__range").agg(F.count("*").alias("n"), F.count_if("long").alias("long"))
    # one row for each range
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    drawn = F.floor(F.sum("long").over(Window.partitionBy()) * percent / 100)
    ranges = ranges.select("__range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"), drawn.alias("__drawn"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    placed = dealt.withColumn("__at", within).join(ranges, "__range")
    rank = F.col("__before") + F.col("__at")
    return placed.withColumn("rank", F.when(F.col("long") & (rank <= F.col("__drawn")), rank)).select(*weighed.columns, "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; see the module's text."""
    return draw(weigh(docs, gains(feature_counts(target), feature_counts(docs))), percent, least_words, seed)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
