"""Secret scanning: three base patterns, and a linear-chain conditional random field.

Texts are cut into tokens (runs of letters, digits and + / _).  Each is
described by its shape (length, shares and mix of character classes, changes of
class, first characters), by its neighbours (the words and the marks before and
after it) and by the file (share of digits, presence of assignments).  A
conditional random field with the states outside, begin and inside scores
sequences, and Viterbi's algorithm finds the best one.  Weights are fitted by
maximum likelihood on at most ``HIT_ROWS + PLAIN_ROWS`` documents whose tags
come from the base patterns, and as many copies in which the secret is replaced
by a random one of another alphabet and its keyword by another, so that shape
counts and not only the patterns' own words; scanning covers every row and whole
texts.

Most tokens lie in no stretch whose best possible gain over "all outside" is
positive.  A prefix sum shows which ones do, and only those stretches are
decoded step by step; the result is the exact best sequence.

Spans are (kind, start, end) in code points, end exclusive: ``assign``,
``access`` and ``hex`` from the patterns, and ``crf`` where the field finds a
secret that no pattern covers.

Defined results: null and empty texts have no spans; repeated rows get equal
results; with no sample the field adds nothing; other columns do not matter.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise
from .arrowtext import BYTE_VALUE, prefix_hashes, span_hashes, text_runs, word_spans
from .tables import read

#: Documents to fit on: with and without a match of the base patterns.
HIT_ROWS, PLAIN_ROWS = 1200, 400
REACH = 12
LENGTH = 2 * REACH + 8
KINDS = ["assign", "access", "hex", "crf"]

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Keywords and alphabets of the altered copies.
KEYWORDS = ["key", "pwd", "auth", "credential", "access_key", "client", "private key", "bearer"]
ALPHABETS = [string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/_"]
_HINT = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, where the secret itself starts) of the base patterns."""
    out = [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGIT, _UPPER, _SMALL = _table(b"0123456789"), _table(bytes(range(65, 91))), _table(bytes(range(97, 123)))
_HIGH = np.arange(256) >= 128
_MARK = _table(b"+/_")
_TOKEN = _DIGIT | _UPPER | _SMALL | _HIGH | _MARK
_HEX, _VOWEL, _ASSIGNS = _table(b"0123456789abcdef"), _table(b"aeiouAEIOU"), _table(b"=:")
_QUOTE, _LINE, _JOINS = _table(b"\"'`"), _table(b"\n\r"), _table(b".-=")
_CLASS = np.select([_DIGIT, _UPPER, _SMALL, _HIGH], [0, 1, 2, 3], 4).astype(np.int8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Values of each feature.
WIDTHS = {"length": 12, "digits": 6, "mix": 16, "hex": 6, "changes": 6, "vowels": 5, "before": 32, "after": 32, "word_before": 2048, "word_after": 512, "length_mix": 96, "file": 8, "mix_before": 9, "head": 1024}
OFFSETS = np.concatenate([[0], np.cumsum(list(WIDTHS.values()))])


def _sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=total[1:], dtype=np.int32)
    return total[end] - total[start]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, feature numbers) of the tokens of some texts."""
    start, end, first = word_spans(data, offsets, _TOKEN)
    n = len(start)
    if not n:
        return start, end, start, np.zeros((0, len(WIDTHS)), np.int32)
    document = np.searchsorted(first[1:], np.arange(n), "right")
    size = end - start
    digits, upper, small, high, marks = (_sums(t[data], start, end) for t in (_DIGIT, _UPPER, _SMALL, _HIGH, _MARK))
    kinds = _CLASS[data]
    changes = np.zeros(len(data), bool)
    changes[1:] = kinds[1:] != kinds[:-1]
    changed = _sums(changes, np.minimum(start + 1, end), end)
    letters = np.maximum(upper + small + high, 1)
    bucket = np.digitize(size, [2, 3, 4, 6, 8, 10, 13, 17, 24, 33, 48])
    mix = (digits > 0) + 2 * (upper > 0) + 4 * (small + high > 0)
    same = np.zeros(n, bool)
    same[1:] = document[1:] == document[:-1]
    gap_from = np.where(same, np.concatenate([[0], end[:-1]]), np.maximum(start - 1, offsets[document]))
    marks_in = [(_sums(t[data], gap_from, start) > 0).astype(np.int32) for t in (_ASSIGNS, _QUOTE, _LINE)]
    joined = same & (start - gap_from == 1) & _JOINS[data[gap_from]]
    gap = marks_in[0] + 2 * marks_in[1] + 4 * marks_in[2] + 8 * joined + 16 * ~same
    after = np.full(n, 16, np.int32)
    after[:-1] = np.where(same[1:], gap[1:], 16)
    words = span_hashes(prefix_hashes(BYTE_VALUE[_LOWER[data]]), start, end)
    heads = span_hashes(prefix_hashes(BYTE_VALUE[data]), start, np.minimum(start + 4, end))
    before_word, after_word, before_mix = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, 8, np.int64)
    before_word[1:] = np.where(same[1:], 1 + (words[:-1] % np.uint64(2047)).astype(np.int64), 0)
    after_word[:-1] = np.where(same[1:], 1 + (words[1:] % np.uint64(511)).astype(np.int64), 0)
    before_mix[1:] = np.where(same[1:], mix[:-1], 8)
    long = np.maximum(np.diff(offsets), 1)
    dense = np.digitize(_sums(_DIGIT[data], offsets[:-1], offsets[1:]) / long, [0.001, 0.01, 0.05])
    assigns = (_sums((data == 61), offsets[:-1], offsets[1:]) > 0).astype(np.int64)
    columns = [
        bucket,
        np.digitize(digits / size, [1e-9, 0.25, 0.5, 0.75, 1.0]),
        mix + 8 * (marks > 0),
        np.where(_sums(_HEX[data], start, end) == size, 1 + np.digitize(size, [8, 16, 24, 32]), 0),
        np.digitize(changed / size, [1e-9, 0.1, 0.2, 0.35, 0.5]),
        np.digitize(_sums(_VOWEL[data], start, end) / letters, [1e-9, 0.15, 0.3, 0.5]),
        gap,
        after,
        before_word,
        after_word,
        bucket * 8 + mix,
        (dense + 4 * assigns)[document],
        before_mix,
        (heads % np.uint64(1024)).astype(np.int64),
    ]
    return start, end, document, np.stack(columns, 1).astype(np.int32) + OFFSETS[:-1].astype(np.int32)


class Field:
    """Weights of a linear-chain field with states outside (0), begin (1) and inside (2).

    Outside has no token weights, which loses nothing.  Inside never follows
    outside, nor starts a text.
    """

    NEVER = -1e4

    def __init__(self) -> None:
        self.token = np.zeros((OFFSETS[-1], 2))
        self.step = np.zeros((3, 3))
        self.fitted = False

    def _emissions(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros((*ids.shape[:-1], 3))
        for k in range(ids.shape[-1]):
            out[..., 1:] += self.token[ids[..., k]]
        return out

    def _steps(self) -> np.ndarray:
        step = self.step.copy()
        step[0, 2] = self.NEVER
        return step

    def fit(self, ids: np.ndarray, tags: np.ndarray, rounds: int = 120, rate: float = 0.3, ridge: float = 1e-4) -> None:
        """Adaptive gradient steps on the mean log likelihood; tags are -1 beyond a sequence's end."""
        n, length = tags.shape
        if not n:
            return
        live = tags >= 0
        want = np.where(live, tags, 0)
        seen_token, seen_step = np.full_like(self.token, 1e-8), np.full_like(self.step, 1e-8)
        for _ in range(rounds):
            e, step = self._emissions(ids), self._steps()
            alpha = np.zeros((n, length, 3))
            alpha[:, 0] = e[:, 0] + [0, 0, self.NEVER]
            for t in range(1, length):
                new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + step, axis=1) + e[:, t]
                alpha[:, t] = np.where(live[:, t, None], new, alpha[:, t - 1])
            beta = np.zeros((n, length, 3))
            for t in range(length - 2, -1, -1):
                new = np.logaddexp.reduce(step + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
                beta[:, t] = np.where(live[:, t + 1, None], new, 0)
            total = np.logaddexp.reduce(alpha[:, -1], axis=1)
            belief = np.exp(alpha + beta - total[:, None, None]) * live[..., None]
            pair = np.exp(alpha[:, :-1, :, None] + step + (e + beta)[:, 1:, None, :] - total[:, None, None, None]) * live[:, 1:, None, None]
            miss = (np.eye(3)[want] - belief) * live[..., None]
            gradient = np.zeros_like(self.token)
            for k in range(ids.shape[-1]):
                for s in (1, 2):
                    gradient[:, s - 1] += np.bincount(ids[..., k].ravel(), miss[..., s].ravel(), len(self.token))
            both = live[:, 1:]
            seen = np.bincount((want[:, :-1] * 3 + want[:, 1:])[both], minlength=9).reshape(3, 3)
            gradient, move = gradient / n - ridge * self.token, (seen - pair.sum((0, 1))) / n - ridge * self.step
            seen_token += gradient**2
            seen_step += move**2
            self.token += rate * gradient / np.sqrt(seen_token)
            self.step += rate * move / np.sqrt(seen_step)
        self.fitted = True

    def decode(self, ids: np.ndarray, document: np.ndarray) -> list[tuple[int, int]]:
        """(first, last) tokens of each secret in the best sequences, one for each document."""
        if not self.fitted or not len(ids):
            return []
        e = self._emissions(ids)
        step = self._steps() - self.step[0, 0]
        edge = np.concatenate([[True], np.diff(document) != 0, [True]])  # edge[i]: a text starts at token i
        # the most that a token outside the outside state can add, with leaving counted every time; a text may begin inside for nothing
        enter = np.where(edge[:-1], max(0.0, step[:, 1].max()), step[:, 1].max())
        most = np.maximum(e[:, 1] + enter, e[:, 2] + step[1:, 2].max()) + max(0.0, step[1, 0], step[2, 0])
        total = np.concatenate([[0.0], np.cumsum(most)])
        low = np.minimum.accumulate(total)[:-1]
        high = np.maximum.accumulate(total[::-1])[::-1][1:]
        live = np.flatnonzero(high - low > -1e-9)
        if not len(live):
            return []
        cut = np.flatnonzero((np.diff(live) > 1) | (np.diff(document[live]) != 0)) + 1
        out = []
        for run in np.split(live, cut):
            out += self._viterbi(e[run[0] : run[-1] + 1], step, int(run[0]), edge[run[0]], edge[run[-1] + 1])
        return out

    def _viterbi(self, e: np.ndarray, step: np.ndarray, at: int, opens: bool, closes: bool) -> list[tuple[int, int]]:
        """``opens`` and ``closes``: whether the stretch begins or ends its text; where it ends inside, it goes on outside."""
        rows, s = e.tolist(), step.tolist()
        begin = [0.0, 0.0, self.NEVER] if opens else s[0]
        best = [begin[j] + rows[0][j] for j in range(3)]
        back = []
        for row in rows[1:]:
            chosen = [max(range(3), key=lambda i: best[i] + s[i][j]) for j in range(3)]
            best = [best[chosen[j]] + s[chosen[j]][j] + row[j] for j in range(3)]
            back.append(chosen)
        # a text may end in any state, as it does in the fit
        state = max(range(3), key=lambda i: best[i] + (0.0 if closes else s[i][0]))
        states = [state]
        for chosen in reversed(back):
            state = chosen[state]
            states.append(state)
        out: list[tuple[int, int]] = []
        for k, state in enumerate(reversed(states)):
            if state == 1:
                out.append((at + k, at + k))
            elif state == 2 and out:
                out[-1] = (out[-1][0], at + k)
        return out


def _points(text: bytes) -> np.ndarray:
    """Code points before each byte place: lead bytes so far."""
    return np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])


def _apart(spans: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Those of ``spans`` that overlap no base span."""
    base = sorted(base, key=lambda s: s[1])
    begins, reach = [s[1] for s in base], list(accumulate((s[2] for s in base), max))
    out = []
    for x, y in spans:
        before = bisect_left(begins, y)
        if not before or reach[before - 1] <= x:
            out.append((x, y))
    return out


def _bytes(text: str, spans: list[tuple[str, int, int, int]]) -> list[tuple[int, int]]:
    """Byte spans of the secrets themselves."""
    if text.isascii():
        return [(s[3], s[2]) for s in spans]
    return [(len(text[: s[3]].encode()), len(text[: s[2]].encode())) for s in spans]


def _windows(text: str, spans: list[tuple[str, int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Training windows of one text: feature numbers and tags, both of LENGTH tokens."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    start, end, _, ids = features(raw, np.array([0, len(raw)]))
    n = len(start)
    if not n:
        return
    tags, centers = np.zeros(n, np.int64), []
    for x, y in _bytes(text, spans):
        inside = np.flatnonzero((end > x) & (start < y))
        if len(inside):
            tags[inside] = 2
            tags[inside[0]] = 1
            centers.append(int(inside[0]))
    for c in centers or [n // 2]:
        x = max(0, c - REACH)
        y = min(n, x + LENGTH)
        window, tag = np.zeros((LENGTH, ids.shape[1]), np.int32), np.full(LENGTH, -1, np.int64)
        window[: y - x], tag[: y - x] = ids[x:y], tags[x:y]
        if tag[0] == 2:  # a window may cut a secret, and then begins with it
            tag[0] = 1
        yield window, tag


def _altered(text: str, span: tuple[str, int, int, int]) -> tuple[str, tuple[str, int, int, int]]:
    """``text`` with another secret, and mostly another keyword, in the place of ``span``; always the same for a text."""
    kind, start, end, secret = span
    dice = random.Random(f"{start}:{text[start:end]}")
    new = "".join(dice.choices(dice.choice(ALPHABETS), k=dice.randint(16, 44)))
    lead = text[start:secret]
    if kind == "assign" and dice.random() < 0.8:
        lead = dice.choice(KEYWORDS) + re.sub(r"^[A-Za-z_]+", "", lead)
    elif kind != "assign" and dice.random() < 0.5:
        lead = dice.choice(KEYWORDS) + dice.choice([": ", " ", " = ", "="])
    at = start + len(lead)
    return text[:start] + lead + new + text[end:], (kind, start, at + len(new), at)


def _tagged(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Training windows of a batch of texts, as they are and altered."""
    for text in column.to_pylist():
        spans = base_spans(text)
        yield from _windows(text, spans)
        if spans and all(s[1] < spans[0][2] for s in spans):
            other, span = _altered(text, spans[0])
            yield from _windows(other, [span])


def fit(docs: DataFrame, hit_rows: int = HIT_ROWS, plain_rows: int = PLAIN_ROWS) -> Field:
    """Fit the field on a bounded sample of documents, lowest hash first."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("__h", F.xxhash64("text"))
    # equal texts count once, so a group of copies cannot fill the sample; only hashes move until it is chosen
    marked = materialise(rows.select("__h", F.col("text").rlike(_HINT).alias("__hit")).distinct(), "hashes")
    chosen = marked.filter("__hit").orderBy("__h").limit(hit_rows).unionByName(marked.filter("NOT __hit").orderBy("__h").limit(plain_rows))
    # two texts with one hash count as one; the lesser is taken
    chosen = rows.join(F.broadcast(chosen.select("__h").distinct()), "__h").groupBy("__h").agg(F.min("text").alias("text"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_tagged(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes() for w, _ in found], pa.binary()), pa.array([t.tobytes() for _, t in found], pa.binary())], ["ids", "tags"])

    made = chosen.select("text").mapInArrow(windows, "ids binary, tags binary").toPandas().sort_values(["ids", "tags"])
    field = Field()
    field.fit(
        np.array([np.frombuffer(x, np.int32) for x in made["ids"]]).reshape(len(made), LENGTH, len(WIDTHS)),
        np.array([np.frombuffer(x, np.int64) for x in made["tags"]]).reshape(len(made), LENGTH),
    )
    return field


def find(column: pa.Array, field: Field) -> Iterator[list[tuple[str, int, int]]]:
    """The spans of each text, by start, then kind."""
    for a, b, data, offsets in text_runs(column):
        start, end, document, ids = features(data, offsets)
        added: dict[int, list[tuple[int, int]]] = {}
        for x, y in field.decode(ids, document):
            added.setdefault(int(document[x]), []).append((int(start[x]), int(end[y])))
        for i in range(b - a):
            raw = data[offsets[i] : offsets[i + 1]].tobytes()
            base = [s[:3] for s in base_spans(raw.decode("utf-8", "replace"))]
            spans = [(x - int(offsets[i]), y - int(offsets[i])) for x, y in added.get(i, ())]
            if spans and not raw.isascii():
                points = _points(raw)
                spans = [(int(points[x]), int(points[y])) for x, y in spans]
            more = [("crf", x, y) for x, y in _apart(spans, base)]
            yield sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and spans (kind, start, end) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": x, "end": y} for k, x, y in found] for found in find(batch.column(1), shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(search, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(written(F.filter("spans", lambda s: s["kind"] != "crf")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        count("crf"),
    )
