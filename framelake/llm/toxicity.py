"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts to
Latin ones, digits and marks that stand for letters inside words to those
letters, everything else but letters to blanks; l and i match each other, since
a 1 may stand for either.  The lexicon is learned from
labelled rows: whole words and word beginnings whose document counts in toxic
rows are out of proportion, weighted by their log odds.  Two-word phrases that
hold an entry but occur in clean rows only are exceptions, and entries inside
them do not count.  The sum of weights, divided by the text's length in words,
goes through a logistic curve fitted on the same rows.

Fitting reads at most ``TOXIC_ROWS + CLEAN_ROWS`` labelled rows, so the lexicon
that is broadcast is bounded by that sample; scoring reads every row in full.

Defined results: null and empty texts have no matches and get the score of a
clean text; repeated rows get the same score; with no labels the lexicon is
empty and every score is 0; other columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise
from . import labelled
from .tables import read

#: Labelled rows to fit on, of each label.
TOXIC_ROWS, CLEAN_ROWS = 3000, 12000
BEGINNINGS = (4, 5, 6)
LEAST_DOCUMENTS = 5
LEAST_G = 20.0
LEAST_WEIGHT = 2.0
EXCEPTION_DOCUMENTS = 3
THRESHOLD = 0.5

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = str.maketrans("аеорсухіјѕԁһԛԝвкмнтαοειυνκρτβ", "aeopcyxijsdhqwbkmhtaoeiuvkptb")
#: Digits and marks that stand for letters.
STAND_INS = str.maketrans("013457@$!|", "oieastasii")
_STAND_IN = re.compile(r"[013457@$!|]")
_INSIDE = re.compile(r"(?<=[^\W\d_])[013457@$!|]+(?=[^\W\d_])|(?<![^\s\"'(])[013457@$]+(?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[013457$]+(?![^\s\"').,;:?!])")
_blanks = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalpha()})


def fold(text: str) -> str:
    """Words of folded letters with single or more blanks around each."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(LOOK_ALIKES)
    if _STAND_IN.search(text):
        text = _INSIDE.sub(lambda m: m[0].translate(STAND_INS), text)
    return f" {text.translate(_blanks)} "


def merged(text: str) -> str:
    """``text`` with l and i as one letter: a 1, folded to i, may stand for either."""
    return text.replace("l", "i")


class Lexicon:
    """Entries with weights, exception phrases, and the curve from density to score."""

    def __init__(self, entries: dict[str, float], exceptions: list[str] | None = None, curve: tuple[float, float] = (-700.0, 0.0)) -> None:
        self.entries, self.exceptions, self.curve = entries, exceptions or [], curve
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            weights: dict[str, float] = {}
            for entry, weight in self.entries.items():
                weights[merged(entry)] = max(weight, weights.get(merged(entry), weight))
            for entry, weight in weights.items():
                found.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                found.add_word(merged(f" {phrase} "), (len(phrase) + 2, None))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of entries outside exception phrases; one for each start."""
        if not self.entries:
            return []
        kept: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for last, (size, weight) in self.automaton.iter(merged(folded)):
            if weight is None:
                spared.append((last + 1 - size, last + 1))
            else:
                start = last + 1 - size
                if start not in kept or weight > kept[start][1]:
                    kept[start] = (last + 1, weight)
        if not spared:
            return [(a, b, w) for a, (b, w) in kept.items()]
        spared.sort()
        out, at, reach = [], 0, -1  # reach: the farthest end of spans that have begun
        for a, (b, w) in sorted(kept.items()):
            while at < len(spared) and spared[at][0] <= a:
                reach = max(reach, spared[at][1])
                at += 1
            if b > reach:
                out.append((a, b, w))
        return out

    def density(self, text: str) -> float:
        folded = fold(text)
        found = self.hits(folded)
        if not found:
            return 0.0
        return math.log1p(1000 * sum(w for _, _, w in found) / (len(folded.split()) + 20))

    def score(self, density: float) -> float:
        at = self.curve[0] + self.curve[1] * density
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, at))))


def _terms(text: str) -> set[str]:
    words = set(fold(text).split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n}


def _phrases(lexicon: Lexicon, text: str) -> set[str]:
    folded, out = fold(text), set()
    for start, _, _ in lexicon.hits(folded):
        before, after = folded[:start].rsplit(None, 1)[-1:], folded[start:].split(None, 2)[:2]
        out.update(" ".join(p) for p in ([*before, after[0]], after) if len(p) == 2)
    return out


def _counts(rows: DataFrame, of, name: str) -> DataFrame:
    """Documents of each label that have each string which ``of(text)`` gives."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label].update(of(text))
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_pydict({name: keys, "toxic": [seen[1][k] for k in keys], "clean": [seen[0][k] for k in keys]}, pa.schema([(name, pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]))

    return rows.mapInArrow(count, f"{name} string, toxic long, clean long").groupBy(name).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose(candidates: list[tuple[str, int, int]], toxic_rows: int, clean_rows: int) -> dict[str, float]:
    """Entries and weights from (term, toxic, clean) counts.

    A word beginning is an entry only if it gathers clearly more documents than
    any single word that it begins, and of beginnings with the same documents
    the longest is taken; words that an entry begins are left out.
    """
    words = {t: (a, b) for t, a, b in candidates if t.endswith(" ")}
    heads = {t: (a, b) for t, a, b in candidates if not t.endswith(" ")}
    kept: dict[str, tuple[int, int]] = {}
    for head, (a, b) in heads.items():
        most = max((x for w, (x, _) in words.items() if w.startswith(head)), default=0)
        longer = max((x for h, (x, _) in heads.items() if len(h) > len(head) and h.startswith(head)), default=0)
        if a >= 1.2 * most + 2 and longer < 0.98 * a:
            kept[head] = (a, b)
    for word, pair in words.items():
        if not any(word.startswith(h) for h in kept):
            kept[word] = pair
    return {t: math.log((a + 0.5) / (toxic_rows + 1)) - math.log((b + 0.5) / (clean_rows + 1)) for t, (a, b) in sorted(kept.items())}


def fit_curve(density: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, lightly regularised, by Newton steps."""
    x, beta = np.stack([np.ones(len(density)), density], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-2])
        step = np.linalg.solve(hessian, x.T @ (label - p) - np.array([1e-3, 1e-2]) * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Lexicon:
    """Learn lexicon, exceptions and curve from a sample of labelled rows."""
    rows = materialise(labelled.sample(docs, labels, "toxic", {1: toxic_rows, 0: clean_rows}).select("text", "label"), "toxic-sample")
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    a, b = totals.get(1, 0), totals.get(0, 0)
    if not a or not b:
        return Lexicon({})
    n = F.col("toxic") + F.col("clean")
    log_ratio = lambda c, share: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * F.lit(share)))).otherwise(0.0)
    g = 2 * (log_ratio("toxic", a / (a + b)) + log_ratio("clean", b / (a + b)))
    weight = F.log((F.col("toxic") + 0.5) / F.lit(a + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(b + 1.0))
    found = _counts(rows, _terms, "term").filter((F.col("toxic") >= LEAST_DOCUMENTS) & (g >= LEAST_G) & (weight >= LEAST_WEIGHT))
    entries = choose([tuple(r) for r in found.select("term", "toxic", "clean").collect()], a, b)
    first = Lexicon(entries)
    phrases = _counts(rows, lambda text: _phrases(first, text), "phrase").filter((F.col("clean") >= EXCEPTION_DOCUMENTS) & (F.col("toxic") == 0))
    lexicon = Lexicon(entries, sorted(r["phrase"] for r in phrases.select("phrase").collect()))

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.density(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1)], ["density", "label"])

    at = rows.mapInArrow(densities, "density double, label int").toPandas().sort_values(["label", "density"])
    lexicon.curve = fit_curve(at["density"].to_numpy(), at["label"].to_numpy())
    return lexicon


def _scores(column: pa.Array, lexicon: Lexicon) -> list[float]:
    return [lexicon.score(lexicon.density(x.as_py() or "")) for x in column]


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_scores(batch.column(2), shared.value), pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), labelled.held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(judge, "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast(lexicon), docs.columns.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s in _scores(batch.column(at), shared.value)], pa.bool_()))

    return docs.mapInArrow(sift, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
