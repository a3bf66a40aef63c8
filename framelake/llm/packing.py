"""Packing of tokenised documents into fixed windows, best fit decreasing.

A document's ids (its tokens and one closing id) are first cut into full
windows; what is left over is shorter than a window.  The left-overs are dealt
into groups of bounded size, and each group is packed on its own: longest
first, each into the open window with the least sufficient room, which a
segment tree over remaining capacities finds in logarithmic time.  Groups are
large enough that the windows left partly open in each weigh nothing, and their
number grows with the input, so no task ever holds more than ``group_rows``
left-overs.

Defined results: null and empty texts are documents of the closing id alone; a
repeated row is packed once for each repetition; a null doc_id is kept as it
is; an empty table gives no pieces; other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise
from .arrowtext import MIX, RUN, mix, prefix_hashes, span_hashes
from .tables import read

WINDOW = 2048
CLOSING_ID = 1
GROUP_ROWS = 100_000
VOCABULARY = "byte_bpe_50k"

#: Code points with the White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that the vocabulary's pattern keeps with their apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

OTHER, LETTER, NUMBER, SPACE, UNASSIGNED = range(5)


class BatchTokenizer:
    """Ids of many texts at once, equal to the vocabulary's own tokenizer.

    Texts are split into the vocabulary's units with array operations; each
    distinct unit is encoded once and remembered, since words repeat far more
    often than they are new.  Units are grouped by hash and compared with the
    one that stands for their group; those that differ are encoded themselves.  Texts that hold one of the special tokens' names
    go to the tokenizer itself.
    """

    def __init__(self, vocabulary: str = VOCABULARY, remembered: int = 500_000) -> None:
        import base64
        import unicodedata

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.units = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        kinds = {"L": LETTER, "N": NUMBER, "Cn": UNASSIGNED}
        category = map(unicodedata.category, map(chr, range(0x32400)))
        self.kind = np.fromiter((kinds.get(c, kinds.get(c[0], OTHER)) for c in category), np.uint8, 0x32400)
        self.kind = np.concatenate([self.kind, np.full(0x110000 - len(self.kind), UNASSIGNED, np.uint8)])
        self.kind[WHITE_SPACE] = SPACE
        self.remembered = remembered
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        #: Where each remembered unit's ids begin, and where the last one's end.
        self.first = np.zeros(1 << 12, np.int64)

    def starts(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where units start; ``begins`` marks the first code point of each text."""
        n = len(points)
        kind = self.kind[points]
        start = np.ones(n, bool)
        start[1:] = (kind[1:] != kind[:-1]) | begins[1:]
        joined = ~begins[1:]  # joined[i]: i + 1 belongs to the same text as i
        # the last white space before something else stands alone, or leads the next unit if it is a blank
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & joined)
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        quote = np.flatnonzero((points[:-1] == 39) & (kind[1:] == LETTER) & joined & start[:-1])
        if len(quote):
            far = np.concatenate([points, [0, 0, 0]])
            text = np.concatenate([np.cumsum(begins), [-1, -1, -1]])
            for ending in ENDINGS:
                hit = quote
                for k, c in enumerate(ending, 1):
                    hit = hit[(far[hit + k] == ord(c)) & (text[hit + k] == text[hit])]
                start[hit + 1] = False
                after = hit + len(ending) + 1
                after = after[(text[after] == text[hit]) & (after < n)]
                start[after[kind[after] == LETTER]] = True
        return start

    def learn(self, unit: str) -> int:
        ids = self.units.encode_ordinary(unit)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        place = len(self.known)
        if place + 2 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.used += len(ids)
        self.first[place + 1] = self.used
        return place

    @staticmethod
    def unlike(points: np.ndarray, at: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Numbers of the units that differ from the unit ``other`` of theirs."""
        size = end - at
        same = size == size[other]
        # units stand one after another, so those of the same size are compared in one line
        lead = np.repeat(np.where(same, at[other] - at, 0), size)
        differs = points[lead + np.arange(len(points))] != points
        inside = np.add.reduceat(differs, at, dtype=np.int64) > 0
        return np.flatnonzero(~same | inside)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.uint32) for _ in texts]
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        begins = np.zeros(len(points), bool)
        begins[offsets[:-1][lengths > 0]] = True
        at = np.flatnonzero(self.starts(points, begins))
        end = np.append(at[1:], len(points))
        codes, distinct = pd.factorize(span_hashes(prefix_hashes(mix((points + np.uint32(1)).astype(np.uint64) * MIX)), at, end))
        sample = np.empty(len(distinct), np.int64)
        sample[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        unlike = self.unlike(points, at, end, sample[codes])
        codes[unlike] = len(sample) + np.arange(len(unlike))
        sample = np.concatenate([sample, unlike])
        if len(self.known) > self.remembered:
            self.forget()
        places = np.empty(len(sample), np.int64)
        known = self.known
        for i, (a, b) in enumerate(zip(at[sample].tolist(), end[sample].tolist())):
            unit = joined[a:b]
            place = known.get(unit)
            if place is None:
                place = known[unit] = self.learn(unit)
            places[i] = place
        begin = self.first[places]
        size = (self.first[places + 1] - begin)[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(begin[codes] - ends[:-1], size) + np.arange(ends[-1])]
        cuts = ends[np.searchsorted(at, offsets)]
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        apart = set(np.searchsorted(offsets, np.flatnonzero(self.kind[points] == UNASSIGNED), "right") - 1)
        for name in self.special:
            if name in joined:
                apart |= {i for i, text in enumerate(texts) if name in text}
        for i in apart:
            out[i] = np.array(self.own.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


_tokenizers: dict[str, BatchTokenizer] = {}


def tokenizer(vocabulary: str) -> BatchTokenizer:
    """The worker's tokenizer, made once for each process."""
    if vocabulary not in _tokenizers:
        _tokenizers[vocabulary] = BatchTokenizer(vocabulary)
    return _tokenizers[vocabulary]


def pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Cut each document into full windows and a left-over.

    Columns: doc_id, start, length, ids_crc32, doc_tokens and, with
    ``with_ids``, the ids themselves.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(batch):
                some, room = [], 4 * RUN
                while at + len(some) < len(batch) and (room > 0 or not some):
                    text = texts[at + len(some)].as_py() or ""
                    room -= len(text)
                    some.append(text)
                out: dict[str, list] = {name: [] for name, _ in fields}
                for doc_id, ids in zip(names.slice(at, len(some)).to_pylist(), coder.encode(some), strict=True):
                    ids = np.append(ids, CLOSING_ID).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        out["doc_id"].append(doc_id)
                        out["start"].append(start)
                        out["length"].append(len(piece))
                        out["ids_crc32"].append(zlib.crc32(piece.tobytes()))
                        out["doc_tokens"].append(len(ids))
                        if with_ids:
                            out["ids"].append(piece.astype(np.int32))
                yield pa.RecordBatch.from_pydict(out, schema)
                at += len(some)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, ddl)


class RoomTree:
    """Segment tree over remaining capacities 0..size: which have an open window."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << max(1, size.bit_length())
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) of the least room of at least ``need``."""
        count, i = self.count, need + self.leaves
        if need >= self.leaves:
            return None
        if not count[i]:
            # climb to the first ancestor with something to the right, then go down leftmost
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i + (not count[2 * i])
        room = i - self.leaves
        window = self.open[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, window


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each length, in the order given; ties keep that order."""
    tree, opened = RoomTree(window), 0
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            room, at = window, opened
            opened += 1
        else:
            room, at = found
        where[i], offset[i] = at, window - room
        if room > need:
            tree.put(room - need, at)
    return where, offset


def pack(cut: DataFrame, window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Give each piece its sequence_id and offset.

    ``cut`` must be stored (see :func:`materialise`): its rows are numbered by
    their place in the files, which deals repeated rows into groups evenly.
    """
    cut = cut.withColumn("__at", F.monotonically_increasing_id())
    full = cut.filter(F.col("length") == window).withColumn("sequence_id", F.lit(1 << 62) + F.col("__at")).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.filter(F.col("length") < window)
    groups = -(-rest.count() // group_rows) or 1
    schema = full.schema

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__at", ignore_index=True)
        where, rows["offset"] = best_fit_decreasing(rows["length"].to_numpy(), window)
        rows["sequence_id"] = (int(key[0]) << 32) + where
        return rows[schema.names]

    placed = rest.withColumn("__group", F.pmod(F.xxhash64("__at"), F.lit(groups))).groupBy("__group").applyInPandas(place, schema)
    return full.unionByName(placed).drop("__at")


def pack_documents(docs: DataFrame, window: int = WINDOW, group_rows: int = GROUP_ROWS, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with sequence_id and offset; see the module's text."""
    return pack(materialise(pieces(docs, window, vocabulary, with_ids), "pieces"), window, group_rows)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
