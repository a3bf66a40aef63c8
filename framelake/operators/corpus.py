"""Corpus selection, manifests and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cursor import bind


def select_corpus(media: DataFrame, sidecars: DataFrame, excluded: DataFrame, key: str, size: str) -> DataFrame:
    """Media with a sidecar and not excluded, heaviest first."""
    return media.join(sidecars, key, "left_semi").join(excluded, key, "left_anti").orderBy(F.desc(size), key)


def missing_sidecars(media: DataFrame, sidecars: DataFrame, key: str) -> DataFrame:
    return media.join(sidecars, key, "left_anti")


def verify(manifest: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``manifest`` (key, expected) against ``found`` (key, digest): missing, mismatch or ok."""
    status = F.when(F.col("digest").isNull(), "missing").when(F.col("digest") != F.col("expected"), "mismatch").otherwise("ok")
    return manifest.join(found, key, "left").withColumn("status", status)


def manifest_lines(lines: DataFrame, line: Column) -> DataFrame:
    """(digest, path) of lines ``hex *path`` or ``hex  path``; others are left out."""
    parts = F.regexp_extract(line, r"^([0-9a-fA-F]+) [ *](.+)$", 1), F.regexp_extract(line, r"^([0-9a-fA-F]+) [ *](.+)$", 2)
    return lines.select(F.lower(parts[0]).alias("digest"), parts[1].alias("path")).filter("digest <> ''")


def manifest_entries(lines: DataFrame, line: Column, folder: str, base_url: str, algorithm: str = "sha1") -> DataFrame:
    """(path, url, algorithm, digest, transform) of the lines of one source of files; a transform is what a download needs, here none."""
    name = F.col("path")
    return manifest_lines(lines, line).select(
        F.concat(F.lit(f"{folder}/"), name).alias("path"), F.concat(F.lit(base_url), name).alias("url"), F.lit(algorithm).alias("algorithm"), "digest", F.lit(None).cast("string").alias("transform")
    )


def union_manifests(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, repeats too."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def golden_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, digest, name, error) of sidecar texts: two fields a line, blank lines skipped, digests lower-cased.

    A bad line has an error in place of its fields, and so has the one row of a
    text without any line.
    """
    numbered = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x, i: F.struct(i.alias("line"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("raw")))
    lines = files.select(key, F.explode_outer(F.filter(numbered, lambda x: x["raw"] != "")).alias("x"))
    fields = F.split("x.raw", r"\s+")
    good = (F.size(fields) == 2) & F.element_at(fields, 1).rlike("^[0-9a-fA-F]{32}$")
    error = F.when(F.col("x").isNull(), "no frames").when(~good, "bad line")
    return lines.select(key, "x.line", F.when(good, F.lower(F.element_at(fields, 1))).alias("digest"), F.when(good, F.element_at(fields, 2)).alias("name"), error.alias("error"))


def check_files(entries: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """``entries`` (path, algorithm, digest, …) with status against ``files`` (path, is_file, content): missing, not_a_file, mismatch or ok.

    Each content is hashed where it is read, by all three algorithms, so only
    digests are joined.
    """
    digests = files.select(path, "is_file", F.md5("content").alias("__md5"), F.sha1("content").alias("__sha1"), F.sha2("content", 256).alias("__sha256"))
    found = F.when(F.col("algorithm") == "sha1", F.col("__sha1")).when(F.col("algorithm") == "md5", F.col("__md5")).when(F.col("algorithm") == "sha256", F.col("__sha256"))
    status = F.when(F.col("is_file").isNull(), "missing").when(~F.col("is_file"), "not_a_file").when(found.eqNullSafe(F.lower("digest")), "ok").otherwise("mismatch")
    return entries.join(digests, path, "left").withColumn("status", status).drop("is_file", "__md5", "__sha1", "__sha256")


def file_facts(files: DataFrame, path: str) -> DataFrame:
    """(path, is_file, sha256, lists_md5, record) of files (path, is_file, content): what a check of generated sidecars asks of each.

    lists_md5 tells whether each line that holds something begins with a
    lower-case MD5 digest, and there is one.  record is the first line's SHA-256
    digest and the source (algorithm, digest, path) that the last line of that
    kind names, or null.
    """
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    trimmed = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    digest = lambda x, n: x.rlike(rf"^[0-9a-f]{{{n}}}(\s|$)")

    def facts(lines: Column) -> Column:
        held = F.filter(lines, lambda x: x != "")
        sources = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: x.rlike(r"^source\s+\S+\s+\S+\s+\S"))
        first = F.lower(F.get(lines, F.lit(0)))
        source = F.split(F.element_at(sources, -1), r"\s+", 4)
        record = F.struct(F.substring(first, 1, 64).alias("digest"), F.when(F.size(sources) > 0, F.slice(source, 2, 3)).alias("source"))
        return F.struct(((F.size(held) > 0) & F.forall(held, lambda x: digest(x, 32))).alias("lists_md5"), F.when(digest(first, 64), record).alias("record"))

    rows = files.select(path, "is_file", F.sha2("content", 256).alias("sha256"), bind(trimmed, facts).alias("f"))
    return rows.select(path, "is_file", "sha256", "f.lists_md5", "f.record")


def check_generated(entries: DataFrame, facts: DataFrame, path: str) -> DataFrame:
    """``entries`` (media, algorithm, digest, sidecar, record) with status: whether a generated sidecar is still that of its media.

    A record beside each sidecar holds its SHA-256 digest and the source that it
    was made from.  ``facts`` are those of :func:`file_facts`; only they are
    joined, never contents.
    """
    known = lambda name, *columns: facts.select(F.col(path).alias(name), *[F.col(c).alias(f"__{name}_{c}") for c in columns])
    rows = entries.join(known("media", "is_file"), "media", "left").join(known("sidecar", "is_file", "lists_md5", "sha256"), "sidecar", "left").join(known("record", "is_file", "record"), "record", "left")
    source = F.array(F.col("algorithm"), F.col("digest"), F.col("media"))
    status = (
        F.when(F.col("__media_is_file").isNull(), F.concat(F.lit("source missing: "), "media"))
        .when(~F.col("__media_is_file"), F.concat(F.lit("source not a regular file: "), "media"))
        .when(F.col("__sidecar_is_file").isNull(), "missing")
        .when(~F.col("__sidecar_is_file"), "not a regular file")
        .when(~F.coalesce("__sidecar_lists_md5", F.lit(False)), "invalid md5 sidecar")
        .when(F.col("__record_is_file").isNull(), F.concat(F.lit("missing sha256 record: "), "record"))
        .when(~F.col("__record_is_file"), F.concat(F.lit("sha256 record is not a regular file: "), "record"))
        .when(F.col("__record_record").isNull(), F.concat(F.lit("invalid sha256 record: "), "record"))
        .when(~F.col("__record_record.source").eqNullSafe(source), "source digest changed")
        .when(F.col("__record_record.digest") != F.col("__sidecar_sha256"), F.concat(F.lit("sha256 mismatch: got "), "__sidecar_sha256"))
        .otherwise("ok")
    )
    return rows.withColumn("status", status).select(*entries.columns, "status")
