"""Queries over JSON lines, maps, profiles, run output and report texts, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import corpus, ordering
from ..sources import logs
from .media import _little
from .queries import query


def _broken(table) -> DataFrame:
    """Events' properties as JSON lines; every tenth is cut in the middle, every eleventh holds a bare NaN, every thirteenth is blank."""
    key = F.col("event_id")
    text = F.when(key % 13 == 0, "  ").when(key % 10 == 0, F.substring("props", F.lit(1), (F.length("props") - 2).cast("int"))).when(key % 11 == 0, '{"a": NaN}').otherwise(F.col("props"))
    return table("events").select("user_id", "event_id", text.alias("raw"))


@query("""SELECT user_id, count(*) FILTER (event_id % 10 > 0 AND event_id % 11 > 0) AS events, count(*) FILTER (event_id % 10 = 0 OR event_id % 11 = 0) AS malformed
FROM events WHERE event_id % 13 > 0 GROUP BY user_id""")
def jsonl_malformed(table) -> DataFrame:
    rows = logs.lines(_broken(table), "user_id", "raw")
    return logs.count_json(rows, "user_id", "raw")


_KINDS = ["thread.started", "turn.completed", "item.completed", "item.started", "unheard.of", "error"]
_ITEMS = ["agent_message", "reasoning", "strange", "file_change"]


@query(f"""WITH e AS (SELECT event_id, {_KINDS}[event_id % 6 + 1] AS kind, {_ITEMS}[event_id % 4 + 1] AS item FROM events)
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'malformed' WHEN kind LIKE 'item%' THEN CASE WHEN event_id % 5 = 0 THEN 'item:malformed' WHEN item = 'strange' THEN 'item:other' ELSE 'item:' || item END
  WHEN kind = 'unheard.of' THEN 'other' ELSE kind END AS route FROM e""")
def event_routing(table) -> DataFrame:
    key = F.col("event_id")
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (key % len(names) + 1).cast("int"))
    item = F.when(key % 5 == 0, F.lit("7")).otherwise(F.concat(F.lit('"'), pick(_ITEMS), F.lit('"')))
    text = F.when(key % 17 == 0, '{"type": 3}').otherwise(F.concat(F.lit('{"type": "'), pick(_KINDS), F.lit('", "item": {"type": '), item, F.lit("}}")))
    return table("events").select("event_id", logs.route(logs.parsed_json(text)).alias("route"))


@query("""WITH e AS (SELECT user_id, event_id, event_id % 997 AS tokens, event_id % 31 * 100 AS size FROM events WHERE event_id % 3 > 0)
SELECT user_id, event_id, tokens / size AS ratio FROM e WHERE tokens > 0 AND size > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY tokens / size DESC, event_id) = 1""")
def token_peak(table) -> DataFrame:
    key = F.col("event_id")
    text = F.concat(
        F.lit('{"payload": {"type": "'), F.when(key % 3 > 0, "token_count").otherwise("other"), F.lit('", "info": {"last_token_usage": {"total_tokens": '), key % 997,
        F.lit('}, "model_context_window": '), key % 31 * 100, F.lit("}}}"),
    )
    rows = table("events").select("user_id", "event_id", logs.token_share(logs.parsed_json(text)).alias("share")).filter("share IS NOT NULL")
    return ordering.peak(rows, "user_id", F.col("share"), "event_id").select("user_id", "event_id", "ratio")


@query("""SELECT o_orderkey, o_orderkey % 3 = 0 AS ok, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN '{' || CASE WHEN o_orderkey % 2 = 0 THEN '"error": "bad md5", ' ELSE '' END || '"mismatchedCount": ' || (o_orderkey % 50 + 1) || ', "mismatches": [{"frame":' || o_orderkey || '}]}' || chr(10) || '  l2' || chr(10) || '  l3' || chr(10) || '  l4' || chr(10) || '  l5' || chr(10) || '  l6'
  ELSE 'unparseable driver output' END AS detail FROM orders""")
def run_output(table) -> DataFrame:
    key = F.col("o_orderkey")
    """A run that failed tells all members that say why, whatever their order in the report."""
    why = F.concat(F.lit('{"mismatches": [{"frame": '), key, F.lit('}], "missingCount": 0, "mismatchedCount": '), key % 50 + 1, F.when(key % 2 == 0, ', "error": "bad md5"').otherwise(', "error": ""'), F.lit(', "ok": false}'))
    output = F.concat(F.lit("progress\n"), F.when(key % 3 == 0, '{"ok": true}\n\n').when(key % 3 == 1, why).otherwise("{half"))
    errors = F.when(key % 3 == 1, "l1\nl2\nl3\nl4\nl5\nl6\n")
    verdict = logs.run_verdict(output, errors)
    return table("orders").select("o_orderkey", output.alias("o"), verdict.alias("v")).select("o_orderkey", "v.ok", "v.detail")


@query("""SELECT p_partkey * 4096 AS start, p_partkey * 4096 + p_size AS "end", p_name || ' x' AS symbol FROM part WHERE p_partkey % 6 > 0 ORDER BY start""")
def perf_map(table) -> DataFrame:
    """Lines of a symbol map; every sixth lacks its name or has a size that is no number."""
    key = F.col("p_partkey")
    good = F.concat_ws(" ", F.lower(F.hex(key * 4096)), F.concat(F.lit("0x"), F.hex(F.col("p_size").cast("long"))), F.concat("p_name", F.lit(" x")))
    good = F.when(key % 5 == 0, F.concat(F.lit("\t "), good, F.lit("\r"))).otherwise(good)
    text = F.when(key % 12 == 0, F.concat(F.hex(key), F.lit(" 1"))).when(key % 6 == 0, F.concat(F.hex(key), F.lit(" zz name"))).otherwise(good)
    rows = logs.map_ranges(table("part").select(text.alias("raw")), "raw").orderBy("start")
    return rows.select(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "symbol")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 100 + 1) / 100.0 END::DOUBLE AS rtime, CASE WHEN o_orderkey % 4 > 0 THEN 0.5 END::DOUBLE AS utime, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 300 + 1 END::BIGINT AS frames FROM orders""")
def run_times(table) -> DataFrame:
    """The last figures count; a run of no frames has none."""
    key = F.col("o_orderkey")
    seconds = F.format_string("%d.%02d", F.floor((key % 100 + 1) / 100), (key % 100 + 1) % 100)
    frames = F.when(key % 4 > 0, key % 300 + 1).otherwise(0)
    text = F.concat(F.lit("frame=  1 x\rframe= "), frames, F.lit(" y\nbench: utime=9.0s stime=9.0s rtime=9.0s\nbench: utime=0.5s stime=0.25s rtime="), seconds, F.lit("s\n"))
    times = logs.run_times(text)
    return table("orders").select("o_orderkey", times.alias("t")).select("o_orderkey", "t.rtime", "t.utime", "t.frames")


@query("""SELECT doc_id, strlen(text) > 16384 AS truncated, strlen(text)::BIGINT AS original_bytes, CASE WHEN strlen(text) > 16384 THEN 8192 ELSE strlen(text) END::BIGINT AS head_bytes,
  CASE WHEN strlen(text) > 16384 THEN 8192 END::BIGINT AS tail_bytes, CASE WHEN strlen(text) = length(text) AND strlen(text) > 16384 THEN md5(substr(text, 1, 8192) || right(text, 8192)) END AS ends FROM documents""")
def text_truncate(table) -> DataFrame:
    """Both ends of long texts; bytes are counted before a cut character is replaced."""
    rows = table("documents").select("doc_id", "text", texts.truncated(F.col("text")).alias("t"))
    raw = F.col("text").cast("binary")
    cut = lambda at: F.octet_length(F.substring(raw, at, F.lit(8192))).cast("long")
    long = F.col("t.truncated")
    plain = F.octet_length("text") == F.char_length("text")
    return rows.select(
        "doc_id",
        "t.truncated",
        "t.original_bytes",
        F.when(long, cut(F.lit(1))).otherwise(F.octet_length("t.head").cast("long")).alias("head_bytes"),
        F.when(long, cut(F.octet_length("text") - 8191)).alias("tail_bytes"),
        F.when(plain & long, F.md5(F.concat("t.head", "t.tail"))).alias("ends"),
    )


@query(r"""WITH t AS (SELECT p_partkey, p_partkey % 12 + 1 AS n, p_partkey % 700 + 1 AS w FROM part), l AS (SELECT *, [repeat('x', w) || i FOR i IN range(n)] AS rows FROM t),
k AS (SELECT *, array_to_string(rows[greatest(n - 7, 1):n], chr(10)) AS kept FROM l)
SELECT p_partkey, CASE WHEN n > 8 THEN '… ' || (n - 8) || ' earlier lines omitted' || chr(10) ELSE '' END || CASE WHEN length(kept) > 3000 THEN '… ' || (length(kept) - 3000) || ' earlier chars omitted from tail' || chr(10) ELSE '' END
  || right(kept, 3000) AS tail, CASE WHEN w > 20 THEN repeat('x', 19) || '…' ELSE repeat('x', w) END AS line FROM k""")
def output_tail(table) -> DataFrame:
    key = F.col("p_partkey")
    wide = F.repeat(F.lit("x"), (key % 700 + 1).cast("int"))
    rows = F.transform(F.sequence(F.lit(0), (key % 12).cast("int")), lambda i: F.concat(wide, i.cast("string")))
    text = F.concat(F.array_join(rows, "\r\n"), F.lit(" \n\n"))
    return table("part").select("p_partkey", texts.output_tail(text).alias("tail"), texts.inline(F.concat(F.lit(" \n"), wide), 20).alias("line"))


@query("""WITH m AS (SELECT p_partkey, [3333, 3456, 3457, 3458, 1][p_partkey % 5 + 1] AS part, CASE WHEN p_partkey % 7 = 0 THEN 66 ELSE 65 END AS imp, p_size % 16 AS rev FROM part)
SELECT p_partkey, imp::BIGINT AS implementer, part::BIGINT AS part, rev::BIGINT AS revision,
  CASE WHEN imp = 65 AND part <> 1 THEN ['cortex-a55', 'cortex-a520', 'cortex-a720', 'cortex-x4'][p_partkey % 5 + 1] ELSE 'unknown-midr-0x' || lower(printf('%08x', (imp << 24) + (part << 4) + rev)) END AS name FROM m""")
def midr_decode(table) -> DataFrame:
    key = F.col("p_partkey")
    part = F.element_at(F.array(*[F.lit(x).cast("long") for x in (0xD05, 0xD80, 0xD81, 0xD82, 1)]), (key % 5 + 1).cast("int"))
    number = F.when(key % 7 == 0, 66).otherwise(65) * F.lit(1 << 24).cast("long") + part * 16 + F.col("p_size") % 16
    midr = texts.parse_midr(F.concat(F.lit(" 0x"), F.lower(F.hex(number.cast("long")))))
    rows = table("part").select("p_partkey", midr.alias("midr"))
    found = texts.decode_midr(F.col("midr"))
    return rows.select("p_partkey", found["implementer"].alias("implementer"), found["part"].alias("part"), found["revision"].alias("revision"), texts.core_name(F.col("midr")).alias("name"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 30.5 + s_suppkey WHEN s_suppkey % 3 = 1 THEN 40.0 + s_suppkey END::DOUBLE AS temperature FROM supplier""")
def hal_temperature(table) -> DataFrame:
    """The named section alone counts, the BIG sensor before the first one of type 0."""
    key = F.col("s_suppkey")
    big = F.when(key % 3 == 0, F.concat(F.lit("  T{mValue="), key + 30, F.lit(".5, mType=9, mName=BIG}\n"))).otherwise("")
    first = F.when(key % 3 < 2, F.concat(F.lit("  T{mValue="), key + 40, F.lit(", mType=0, mName=soc}\n  T{mValue=1, mType=0, mName=gpu}\n"))).otherwise("")
    text = F.concat(F.lit("Cached temperatures:\n  T{mValue=99, mType=0, mName=BIG}\nCurrent temperatures from HAL:\n"), first, big, F.lit("Other:\n  T{mValue=5, mType=0, mName=BIG}\n"))
    return logs.temperatures(table("supplier").select("s_suppkey", text.alias("text")), "s_suppkey", "text")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '_ZN3fooX' ELSE 'core::part' || p_partkey || '<u8>' END AS name FROM part""")
def symbol_names(table) -> DataFrame:
    key = F.col("p_partkey")
    plain = F.concat(F.lit("part"), key, F.lit("$LT$u8$GT$"))
    mangled = F.concat(F.lit("_ZN4core"), F.length(plain), plain, F.lit("17h0123456789abcdefE"))
    return table("part").select("p_partkey", texts.demangle(F.when(key % 4 == 0, "_ZN3fooX").otherwise(mangled)).alias("name"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5000 >= 1000 THEN CASE WHEN o_orderkey % 500 = 250 THEN (o_orderkey % 5000 // 1000) || '.' || (o_orderkey % 1000 // 100 + 1) ELSE printf('%.1f', (o_orderkey % 5000)::DOUBLE / 1000) END || 'k' ELSE (o_orderkey % 5000)::VARCHAR END AS tokens,
  CASE WHEN o_orderkey % 400 > 0 AND o_orderkey % 400 < 4 THEN '<1%' ELSE floor(o_orderkey % 400 / 400 * 100 + 0.5)::BIGINT || '%' END AS share,
  (o_orderkey % 97)::VARCHAR || CASE WHEN o_orderkey % 2 = 1 THEN '.5' ELSE '' END AS plain FROM orders""")
def number_texts(table) -> DataFrame:
    """One decimal by the double's exact value: 1150 / 1000 lies below 1.15."""
    key = F.col("o_orderkey")
    half = F.when(key % 2 == 1, 0.5).otherwise(0.0)
    return table("orders").select(
        "o_orderkey",
        texts.compact_number((key % 5000).cast("double")).alias("tokens"),
        texts.compact_percent(key % 400 / F.lit(400.0)).alias("share"),
        texts.number_text((key % 97).cast("double") + half).alias("plain"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'none' WHEN event_id % 3 = 1 THEN 'null' ELSE 'here' END AS state, CASE WHEN event_id % 3 = 2 THEN 'deep' ELSE 'outer' END AS message FROM events""")
def json_members(table) -> DataFrame:
    """A missing member is not a null one; the first member that is neither is taken."""
    key = F.col("event_id")
    text = F.concat(F.lit('{"message": "outer"'), F.when(key % 3 == 0, "").when(key % 3 == 1, ', "error": null').otherwise(', "error": "deep"'), F.lit("}"))
    rows = table("events").select("event_id", logs.parsed_json(text).alias("event"))
    return rows.select("event_id", logs.member_state(F.col("event"), "error").alias("state"), logs.first_member(F.col("event"), "error", "message").alias("message"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'plain ' || event_id || ' text' WHEN 1 THEN 'bad/' || event_id || ': inner' WHEN 2 THEN 'outer: 7: deep ' || event_id WHEN 3 THEN '{"other":' || event_id || '}'
  WHEN 4 THEN 'property_name_above_max_length: tool-call argument property name too long (' || event_id || '/64)' ELSE 'a: b: c: d: [object Object]' END AS text FROM events""")
def error_texts(table) -> DataFrame:
    """Errors as texts, objects, JSON within texts and too many levels."""
    key = F.col("event_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    raw = (
        F.when(key % 6 == 0, text('"plain \\n ', key, '  text"'))
        .when(key % 6 == 1, text('{"type": "bad", "code": ', key, ', "error": null, "message": "inner"}'))
        .when(key % 6 == 2, text('{"type": "outer", "error": "{\\"status\\": 7, \\"message\\": \\"deep ', key, '\\"}"}'))
        .when(key % 6 == 3, text('{"other": ', key, "}"))
        .when(key % 6 == 4, text('"Invalid property name: got a string with length ', key, ', maximum length 64"'))
        .otherwise('{"type": "a", "error": {"type": "b", "error": {"type": "c", "error": "{\\"type\\": \\"d\\", \\"message\\": {\\"type\\": \\"e\\", \\"message\\": \\"f\\"}}"}}}')
    )
    return table("events").select("event_id", logs.error_text(logs.parsed_json(raw)).alias("text"))


@query("""SELECT c_custkey, 'https://example.org/' || c_name AS url, CASE WHEN c_custkey % 2 = 0 THEN 'sha1' WHEN c_custkey % 3 = 0 THEN 'sha256' ELSE 'md5' END AS algorithm,
  CASE WHEN c_custkey % 5 = 0 THEN 'missing' WHEN c_custkey % 7 = 0 THEN 'not_a_file' WHEN c_custkey % 11 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM customer""")
def integrity(table) -> DataFrame:
    """Entries of a manifest with their algorithm, against files with their content."""
    key, content = F.col("c_custkey"), F.col("c_name").cast("binary")
    algorithm = F.when(key % 2 == 0, "sha1").when(key % 3 == 0, "sha256").otherwise("md5")
    entries = table("customer").select("c_custkey", F.col("c_name").alias("path"), F.concat(F.lit("https://example.org/"), "c_name").alias("url"), algorithm.alias("algorithm"), F.when(key % 2 == 0, F.sha1(content)).when(key % 3 == 0, F.sha2(content, 256)).otherwise(F.md5(content)).alias("digest"))
    files = table("customer").filter(key % 5 > 0).select(F.col("c_name").alias("path"), (key % 7 > 0).alias("is_file"), F.when(key % 11 == 0, F.lit("x").cast("binary")).otherwise(content).alias("content"))
    return corpus.check_files(entries, files, "path").select("c_custkey", "url", "algorithm", "status")


@query("""SELECT user_id, event_id AS record, event_id * 4096 AS ip, event_id % 13 + 1 AS period, event_id * 1000 AS time FROM events""")
def profile_scan(table) -> DataFrame:
    """Each user's events as the samples of a binary profile, with a mapping of their own before them."""
    key = F.col("event_id")
    sample = F.concat(_little(F.lit(9), 4), F.lit("0000"), _little(F.lit(32), 2), _little(key * 4096, 8), _little(key * 1000, 8), _little(key % 13 + 1, 8))
    name = F.hex(F.lit("map").cast("binary"))
    mapping = F.concat(_little(F.lit(1), 4), F.lit("0000"), _little(F.lit(44), 2), _little(F.lit(0), 8), _little(F.lit(4096), 8), _little(F.lit(8192), 8), _little(F.lit(0), 8), name, F.lit("00"))
    files = table("events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", sample.alias("x")))).alias("p"))
    body = F.concat(mapping, F.array_join(F.transform("p", lambda x: x["x"]), ""))
    size = F.length(body) / 2
    head = F.concat(F.hex(F.lit("PERFILE2").cast("binary")), F.lit("00" * 16), _little(F.lit(56), 8), F.lit("00" * 8), _little(F.lit(88), 8), _little(size, 8), F.lit("00" * 24), _little(F.lit(1 + 4 + 256), 8))
    rows = logs.profile_records(files.select("user_id", F.unhex(F.concat(head, body)).alias("content")), "user_id", "content")
    order = F.row_number().over(W.partitionBy("user_id").orderBy("record"))
    events = table("events").select("user_id", "event_id").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    samples = rows.filter("kind = 'sample'").withColumn("n", order)
    long = lambda c: F.col(c).cast("long").alias(c)
    return samples.join(events, ["user_id", "n"]).select("user_id", F.col("event_id").alias("record"), long("ip"), long("period"), long("time"))


@query("""SELECT user_id, count(*)::BIGINT AS samples, 4096::BIGINT AS start, 4096 + user_id % 100 * 16 AS "end", 'map' || user_id AS file FROM events GROUP BY user_id""")
def profile_mappings(table) -> DataFrame:
    """The mapping that stands before each user's samples in a binary profile."""
    sample = F.concat(_little(F.lit(9), 4), F.lit("0000"), _little(F.lit(16), 2), _little(F.col("event_id"), 8))
    files = table("events").groupBy("user_id").agg(F.collect_list(sample).alias("p"))
    name = F.concat(F.hex(F.concat(F.lit("map"), "user_id").cast("binary")), F.lit("00"))
    mapping = F.concat(_little(F.lit(10), 4), F.lit("0000"), _little(F.lit(72) + F.length(name) / 2, 2), _little(F.lit(0), 8), _little(F.lit(4096), 8), _little(F.col("user_id") % 100 * 16, 8), F.lit("00" * 40), name)
    body = F.concat(mapping, F.array_join("p", ""))
    head = F.concat(F.hex(F.lit("PERFILE2").cast("binary")), F.lit("00" * 16), _little(F.lit(56), 8), F.lit("00" * 8), _little(F.lit(88), 8), _little(F.length(body) / 2, 8), F.lit("00" * 24), _little(F.lit(1), 8))
    rows = logs.profile_records(files.select("user_id", F.unhex(F.concat(head, body)).alias("content")), "user_id", "content")
    one = F.max_by(F.struct("start", "end", "file"), F.when(F.col("kind") == "mmap", F.col("record")))
    found = rows.groupBy("user_id").agg(F.count_if(F.col("kind") == "sample").alias("samples"), one.alias("m"))
    return found.select("user_id", "samples", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), "m.file")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'source missing: m' || c_custkey WHEN c_custkey % 13 = 0 THEN 'missing' WHEN c_custkey % 7 = 0 THEN 'invalid md5 sidecar'
  WHEN c_custkey % 5 = 0 THEN 'missing sha256 record: r' || c_custkey WHEN c_custkey % 4 = 0 THEN 'invalid sha256 record: r' || c_custkey WHEN c_custkey % 3 = 0 THEN 'source digest changed'
  WHEN c_custkey % 2 = 0 THEN 'sha256 mismatch: got ' || sha256(md5(c_name) || '  a' || chr(10) || chr(10)) ELSE 'ok' END AS status FROM customer""")
def provenance(table) -> DataFrame:
    """Generated sidecars with a record of what they were made from: one case of each kind of damage."""
    key, digest = F.col("c_custkey"), F.md5("c_name")
    sidecar = F.when(key % 7 == 0, "no digest\n").otherwise(F.concat(digest, F.lit("  a\n\n")))
    recorded = F.when(key % 2 == 0, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.upper(F.sha2(sidecar.cast("binary"), 256)))
    source = F.concat(F.lit("source md5 "), F.when(key % 3 == 0, "0").otherwise(digest), F.lit(" m"), key)
    record = F.when(key % 4 == 0, "short").otherwise(F.concat(recorded, F.lit("  x\nnote\n"), source, F.lit("\n")))
    name = lambda kind: F.concat(F.lit(kind), key)
    rows = table("customer")
    file = lambda kind, there, text: rows.filter(there).select(name(kind).alias("path"), F.lit(True).alias("is_file"), text.cast("binary").alias("content"))
    held = file("m", key % 11 > 0, F.col("c_name")).unionByName(file("s", key % 13 > 0, sidecar)).unionByName(file("r", key % 5 > 0, record))
    entries = rows.select("c_custkey", name("m").alias("media"), F.lit("md5").alias("algorithm"), digest.alias("digest"), name("s").alias("sidecar"), name("r").alias("record"))
    return corpus.check_generated(entries, corpus.file_facts(held, "path"), "path").select("c_custkey", "status")


@query("""SELECT o_custkey, o_orderkey % 9 AS index, arg_max('f' || o_orderkey, o_orderkey) AS mangled, max(o_orderkey) AS address, max(o_orderkey) % 7 AS code_bytes FROM orders WHERE o_orderkey % 4 > 0 GROUP BY ALL""")
def code_dump(table) -> DataFrame:
    """Functions that are compiled again and again: the last record of each counts; every fourth record has another name."""
    key = F.col("o_orderkey")
    name = F.when(key % 4 == 0, "other").otherwise(F.concat(F.lit("JS:f"), key, F.lit("-"), key % 9, F.lit("-turbofan")))
    code = F.repeat(F.lit("cc"), (key % 7).cast("int"))
    inner = F.concat(F.lit("00" * 16), _little(key, 8), _little(key % 7, 8), F.lit("00" * 8), F.hex(name.cast("binary")), F.lit("00"), code)
    record = F.concat(_little(F.lit(0), 4), _little(F.length(inner) / 2 + 16, 4), F.lit("00" * 8), inner)
    files = table("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", record.alias("x")))).alias("p"))
    head = F.concat(_little(F.lit(0x4A695444), 4), _little(F.lit(1), 4), _little(F.lit(40), 4), F.lit("00" * 28))
    content = F.unhex(F.concat(head, F.array_join(F.transform("p", lambda x: x["x"]), "")))
    found = logs.compiled_functions(files.select("o_custkey", content.alias("content")), "o_custkey", "content")
    return found.select("o_custkey", "index", "mangled", F.col("address").cast("long").alias("address"), F.octet_length("code").cast("long").alias("code_bytes"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, 'dir' || l_suppkey % 3 AS path FROM lineitem), f AS (SELECT l_orderkey, path, min((l_linenumber, l_partkey)) AS place FROM p GROUP BY ALL)
SELECT l_orderkey, list(path ORDER BY place, path) AS paths FROM f GROUP BY l_orderkey""")
def unique_paths(table) -> DataFrame:
    """Candidate paths of each key in order, each once; few by nature."""
    path = F.concat(F.lit("dir"), F.col("l_suppkey") % 3)
    rows = table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", path.alias("path")))).alias("x"))
    return rows.select("l_orderkey", F.array_distinct(F.transform("x", lambda x: x["path"])).alias("paths"))
