"""Fill-in-the-middle: documents cut at two places of their tokens and put together in another order.

Tokens are white space with the word after it, as matched by a regular
expression in the tokenizers library's Split pre-tokenizer, which needs no
vocabulary: its offsets give a document's number of tokens and, by rank, the
code points where prefix, middle and suffix end.  Hash digits of the document's
id choose the two ranks and the form, so that a document is cut alike wherever
it lies.

Very long texts are matched in pieces that end where a token ends, so offsets
of about ``PIECE`` characters are objects at a time; the rest are numbers.

Defined results: a null text counts as empty and is left plain, with no tokens;
a null doc_id counts as an empty one; repeated rows are cut alike; texts that
hold one of the marks are left plain, so every output can be taken apart again;
an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from .arrowtext import RUN
from .tables import read

SEED = 42
#: Documents of a hundred that are cut, and cut ones of a hundred whose suffix comes first.
RATE, SUFFIX_FIRST = 50, 80
PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK = "<P>", "<S>", "<M>"

#: Fixed value: white space and the word after it, or white space at the end.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PIECE = 1 << 20
_END = re.compile(r"(?<![\x20\x09-\x0D])(?=[\x20\x09-\x0D])")


def token_ends(splitter: pre_tokenizers.Split, text: str, piece: int = PIECE) -> np.ndarray:
    """Code points where tokens end, in order, from 0 (the place before the first)."""
    found, at = [np.zeros(1, np.int64)], 0
    while at < len(text):
        cut = _END.search(text, at + piece) if at + piece < len(text) else None
        to = cut.start() if cut else len(text)
        part = splitter.pre_tokenize_str(text[at:to] if at or to < len(text) else text)
        found.append(np.fromiter((span[1] for _, span in part), np.int64, len(part)) + at)
        at = to
    return np.concatenate(found)


def digits(doc_id: Column, k: int, seed: int = SEED) -> Column:
    """Group ``k`` (from 1) of 8 hexadecimal digits of the document's hash, as a number."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(name.cast("binary"), 256), 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = text.contains(PREFIX_MARK) | text.contains(SUFFIX_MARK) | text.contains(MIDDLE_MARK)
    h = [digits(F.col("doc_id"), k, seed) for k in range(1, 5)]
    form = F.when((text == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = pre_tokenizers.Split(Regex(TOKEN), "isolated")
        for batch in batches:
            out, size = [], 0
            for doc_id, text, form, h1, h2 in zip(*batch.columns):
                doc_id, text, form = doc_id.as_py(), text.as_py(), form.as_py()
                ends = token_ends(splitter, text)
                n, a, b = len(ends) - 1, None, None
                if form != "plain":
                    a, b = (int(ends[h]) for h in sorted((h1.as_py() % (n + 1), h2.as_py() % (n + 1))))
                    prefix, middle, suffix = PREFIX_MARK + text[:a], MIDDLE_MARK + text[a:b], SUFFIX_MARK + text[b:]
                    text = (prefix + suffix if form == "psm" else suffix + prefix) + middle
                    b -= a
                out.append((doc_id, n, form, a, b, text))
                size += len(text)
                if size > 4 * RUN:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], [name for name, _ in fields])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], [name for name, _ in fields])

    return rows.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that :func:`transform` made ``output`` from."""
    parts = F.split(output, "|".join((PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK)), -1)
    first, second, middle = parts[1], parts[2], parts[3]
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transform(read(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


_H = "CAST(('0x' || substr(h, {}, 8)) AS BIGINT)"
OP13_SQL = rf"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t
  FROM documents),
b AS (
  SELECT doc_id, text, t, len(t) AS n, {_H.format(1)} % (len(t) + 1) AS x, {_H.format(9)} % (len(t) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_H.format(17)} % 100 >= 50 THEN 'plain'
      WHEN {_H.format(25)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM a),
c AS (
  SELECT *, coalesce(array_to_string(t[1:least(x, y)], ''), '') AS p, coalesce(array_to_string(t[least(x, y) + 1:greatest(x, y)], ''), '') AS m,
    coalesce(array_to_string(t[greatest(x, y) + 1:n], ''), '') AS s
  FROM b)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM c
"""
