"""Queries that apply the library's operators to the driver's tables, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coding, geometry
from ..operators import bench, compare, corpus, ordering, profile
from ..storage import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (table reader) -> DataFrame under its own name."""

    def register(make: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql is not None:
            SQL[make.__name__] = sql
        return make

    return register


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by key over several tasks for each core: a small file is read by one or few, however long its rows take to work on."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


_FRAMES = """
a AS (SELECT source AS stream, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS frame, md5(text) AS actual FROM documents),
g AS (SELECT source AS stream, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS frame, md5(text) AS expected
      FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
c AS (SELECT * FROM a FULL JOIN g USING (stream, frame))
"""


def _frames(table) -> DataFrame:
    # stored: ranges are sampled before rows are dealt, and texts are to be read once
    docs = materialise(table("documents").select("doc_id", F.col("source").alias("stream"), F.md5("text").alias("digest")), "digests")
    golden = docs.join(table("labels").select("doc_id"), "doc_id", "left_semi")
    keep = ["stream", "frame", "digest"]
    return compare.compare(compare.number(docs, "stream", "doc_id").select(keep), compare.number(golden, "stream", "doc_id").select(keep))


@query(f"""WITH {_FRAMES}
SELECT stream, count(expected) AS expected_frames, count(actual) AS actual_frames,
  count(*) FILTER (actual = expected) AS matched, count(*) FILTER (actual <> expected) AS mismatched,
  greatest(count(expected) - count(actual), 0) AS missing, greatest(count(actual) - count(expected), 0) AS extra
FROM c GROUP BY stream""")
def golden_compare(table) -> DataFrame:
    return compare.summarise(_frames(table))


@query(f"WITH {_FRAMES} SELECT * FROM c WHERE actual IS NOT NULL AND actual IS DISTINCT FROM expected ORDER BY stream, frame LIMIT 10")
def top10_mismatch(table) -> DataFrame:
    return compare.first_mismatches(_frames(table))


@query("""SELECT user_id, count(*) AS frames,
  round((max(epoch_us(ts)) - min(epoch_us(ts))) / nullif(count(*) - 1, 0) / 1000, 6) AS budget_ms FROM events GROUP BY user_id""")
def frame_budget(table) -> DataFrame:
    return bench.frame_budget(table("events"), "user_id", bench.micros("ts"))


@query("""WITH r AS (SELECT user_id, value, count(*) OVER (PARTITION BY user_id) AS n,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT user_id, CASE WHEN i < round_even(n / 4, 0) THEN 1 WHEN i < round_even(n * 2 / 4, 0) THEN 2 WHEN i < round_even(n * 3 / 4, 0) THEN 3 ELSE 4 END AS quarter,
  round(avg(value), 6) AS mean FROM r GROUP BY ALL""")
def quarter_means(table) -> DataFrame:
    return bench.quarter_means(table("events"), "user_id", ["ts", "event_id"], "value")


@query("""WITH m AS (SELECT l_suppkey, avg(l_quantity) FILTER (l_linenumber % 4 = 1) AS b1, avg(l_quantity) FILTER (l_linenumber % 4 = 2) AS c2,
  avg(l_quantity) FILTER (l_linenumber % 4 = 3) AS c3, avg(l_quantity) FILTER (l_linenumber % 4 = 0) AS b4 FROM lineitem GROUP BY l_suppkey),
v AS (SELECT *, least(coalesce(b1, 0), coalesce(c2, 0), coalesce(c3, 0), coalesce(b4, 0)) > 0 AS ok FROM m)
SELECT l_suppkey, CASE WHEN ok THEN round((c2 + c3) / (b1 + b4) - 1, 6) END AS delta, CASE WHEN ok THEN round(b4 / b1 - 1, 6) END AS spread FROM v""")
def counterbalanced_delta(table) -> DataFrame:
    run = F.element_at(F.array(*[F.lit(x) for x in ("b4", "b1", "c2", "c3")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return bench.counterbalanced_delta(table("lineitem").select("l_suppkey", run.alias("run"), F.col("l_quantity").alias("value")), "l_suppkey")


@query("""SELECT l_suppkey, min(l_extendedprice) AS best, max(l_extendedprice) AS worst,
  first(l_orderkey ORDER BY l_extendedprice, l_orderkey) AS best_at, first(l_orderkey ORDER BY l_extendedprice DESC, l_orderkey) AS worst_at,
  round(max(l_extendedprice) / nullif(min(l_extendedprice), 0) - 1, 6) AS spread FROM lineitem GROUP BY l_suppkey""")
def best_worst_spread(table) -> DataFrame:
    return bench.best_worst(table("lineitem"), "l_suppkey", "l_extendedprice", F.col("l_orderkey"))


@query("""SELECT l_suppkey, count(*) AS passes, round(sum(l_extendedprice), 2) AS total_ms, min(l_extendedprice) AS min_ms, max(l_extendedprice) AS max_ms,
  round(sum(l_extendedprice) / nullif(sum(l_quantity::BIGINT), 0), 6) AS ms_per_frame, round(sum(l_quantity::BIGINT) * 1000 / nullif(sum(l_extendedprice), 0), 6) AS fps
FROM lineitem GROUP BY l_suppkey""")
def pass_range(table) -> DataFrame:
    return bench.pass_range(table("lineitem"), "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("long"))


@query("""SELECT l_partkey, sum(l_linenumber)::BIGINT AS iterations, round(sum(l_orderkey) / sum(l_linenumber), 6) AS ns_per_iteration,
  round(sum(l_linenumber) * 1e9 / sum(l_orderkey), 6) AS per_second, bit_xor(l_suppkey) AS sink FROM lineitem GROUP BY l_partkey""")
def microbench_rate(table) -> DataFrame:
    return bench.rate(table("lineitem"), "l_partkey", F.col("l_orderkey"), F.col("l_linenumber").cast("long"), F.col("l_suppkey"))


_ATTRIBUTED = """
s AS (SELECT event_id AS sample, user_id * 700 + event_id % 977 AS ip, event_id % 13 + 1 AS period, epoch_us(ts) AS us FROM events),
t AS (SELECT * FROM s WHERE us >= (SELECT max(us) FROM s) - 1209600000000),
j AS (SELECT c_custkey * 512 AS start, c_custkey * 512 + CASE WHEN c_custkey % 7 = 0 THEN 3000 WHEN c_custkey % 5 = 0 THEN 40 ELSE 700 END AS "end", c_name AS symbol FROM customer),
m AS (SELECT s_suppkey * 900 AS start, s_suppkey * 900 + CASE WHEN s_suppkey % 9 = 0 THEN 20000 ELSE 850 END AS "end", s_name AS symbol, s_suppkey AS place FROM supplier),
near AS (SELECT sample, CASE WHEN ip < j."end" THEN j.symbol END AS symbol FROM t ASOF JOIN j ON ip >= j.start),
b AS (SELECT sample, arg_max(symbol, place) AS symbol FROM t JOIN m ON ip >= start AND ip < "end" GROUP BY sample),
p AS (SELECT sample, ip, period, coalesce(near.symbol, b.symbol, '<unmapped>') AS symbol FROM t LEFT JOIN near USING (sample) LEFT JOIN b USING (sample))
"""


def _attributed(table) -> DataFrame:
    samples = table("events").select(
        F.col("event_id").alias("sample"), (F.col("user_id") * 700 + F.col("event_id") % 977).alias("ip"), (F.col("event_id") % 13 + 1).alias("period"), bench.micros("ts").alias("at")
    )
    code, file = F.col("c_custkey"), F.col("s_suppkey")
    reach = F.when(code % 7 == 0, 3000).when(code % 5 == 0, 40).otherwise(700)
    jit = table("customer").select((code * 512).alias("start"), (code * 512 + reach).alias("end"), F.col("c_name").alias("symbol"), code.alias("order"))
    maps = table("supplier").select((file * 900).alias("start"), (file * 900 + F.when(file % 9 == 0, 20000).otherwise(850)).alias("end"), F.col("s_name").alias("symbol"), file.alias("record"))
    return profile.attribute(profile.trailing(samples, "at", 1_209_600_000_000), jit, maps)


@query(f"WITH {_ATTRIBUTED} SELECT * FROM p")
def profile_attribution(table) -> DataFrame:
    return _attributed(table).select("sample", "ip", "period", "symbol")


@query(f"""WITH {_ATTRIBUTED}, h AS (SELECT symbol, count(*) AS samples, sum(period)::BIGINT AS period FROM p GROUP BY symbol)
SELECT *, round(period * 100.0::DOUBLE / (SELECT sum(period) FROM h), 6) AS percent FROM h WHERE period * 100.0 >= (SELECT sum(period) FROM h) * 0.05""")
def profile_histogram(table) -> DataFrame:
    return profile.histogram(_attributed(table))


_ORDER = ["ts", "event_id"]


@query("SELECT event_id, user_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS gop FROM events")
def gop_assignment(table) -> DataFrame:
    return ordering.gop_ids(table("events"), "user_id", _ORDER, F.col("event_type") == "signup").select("event_id", "user_id", "gop")


_ORDINAL = """n AS (SELECT *, CASE WHEN event_type <> 'error' THEN sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT - 1 END AS ordinal FROM events)"""


def _ordinals(table) -> DataFrame:
    return ordering.visible_ordinals(table("events"), "user_id", _ORDER, F.col("event_type") != "error")


@query(f"WITH {_ORDINAL} SELECT event_id, ordinal FROM n")
def visible_ordinal(table) -> DataFrame:
    return _ordinals(table).select("event_id", "ordinal")


@query(f"WITH {_ORDINAL} SELECT event_id, ordinal FROM n WHERE ordinal BETWEEN 5 AND 19")
def window_slice(table) -> DataFrame:
    return ordering.output_window(_ordinals(table), 5, 15).select("event_id", "ordinal")


@query(f"""WITH {_ORDINAL}, k AS (SELECT user_id, event_id, event_type = 'signup' AS key FROM n WHERE ordinal = 3)
SELECT u.user_id, CASE WHEN event_id IS NULL THEN 'too_short' WHEN key THEN 'ok' ELSE 'not_keyframe' END AS status, CASE WHEN key THEN event_id END AS start
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN k USING (user_id)""")
def keyframe_start(table) -> DataFrame:
    return ordering.keyframe_start(table("events"), "user_id", "event_id", _ORDER, F.col("event_type") != "error", F.col("event_type") == "signup", 3)


@query("SELECT user_id, 'ok' AS status, arg_min(event_id, (ts, event_id)) AS start FROM events GROUP BY user_id")
def keyframe_start_0(table) -> DataFrame:
    """Offset 0 needs no key frame."""
    return ordering.keyframe_start(table("events"), "user_id", "event_id", _ORDER, F.col("event_type") != "error", F.col("event_type") == "signup", 0)


_HELD = ", ".join(f"last_value(CASE WHEN (event_id >> {i}) & 1 = 1 THEN event_id END IGNORE NULLS) OVER w" for i in range(8))


@query(f"""WITH h AS (SELECT event_id, value, [{_HELD}] AS held FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, held[event_id % 8 + 1] AS source FROM h""")
def slot_lineage(table) -> DataFrame:
    return ordering.slot_lineage(table("events"), "user_id", _ORDER, "event_id", F.col("event_id"), F.col("event_id") % 8).select("event_id", "source")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_record_wins(table) -> DataFrame:
    return ordering.last_record(table("events"), ["user_id", "event_type"], "event_id", "value")


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 240")
def ring_240(table) -> DataFrame:
    return ordering.ring(table("events"), "event_type", [F.desc("ts"), F.desc("event_id")]).select("event_id", "event_type")


@query("""SELECT o_custkey, o_orderkey, o_totalprice / (o_orderkey % 9 + 1) AS ratio FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY ratio DESC, o_orderkey) = 1""")
def peak_ratio(table) -> DataFrame:
    return ordering.peak(table("orders"), "o_custkey", F.col("o_totalprice") / (F.col("o_orderkey") % 9 + 1), "o_orderkey").select("o_custkey", "o_orderkey", "ratio")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS section FROM events""")
def carried_section(table) -> DataFrame:
    return ordering.carried(table("events"), "user_id", _ORDER, F.when(F.col("event_type") == "signup", F.col("event_id")), "section").select("event_id", "section")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def corpus_select(table) -> DataFrame:
    labels = table("labels")
    return corpus.select_corpus(table("documents"), labels, labels.filter("toxic = 1"), "doc_id", "n_chars").select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_sidecars(table) -> DataFrame:
    return corpus.missing_sidecars(table("documents"), table("labels"), "doc_id").select("doc_id")


@query("""WITH m AS (SELECT doc_id, md5(text) AS expected FROM documents), f AS (SELECT doc_id, md5(trim(text, ' ')) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, expected, digest, CASE WHEN digest IS NULL THEN 'missing' WHEN digest <> expected THEN 'mismatch' ELSE 'ok' END AS status FROM m LEFT JOIN f USING (doc_id)""")
def digest_verify(table) -> DataFrame:
    docs = table("documents")
    found = docs.join(table("labels"), "doc_id", "left_semi").select("doc_id", F.md5(F.trim("text")).alias("digest"))
    return corpus.verify(docs.select("doc_id", F.md5("text").alias("expected")), found, "doc_id").select("doc_id", "expected", "digest", "status")


@query("""SELECT 'a/' || c_name AS path, 'https://one.example/' || c_name AS url, 'sha1' AS algorithm, md5(c_name) AS digest, NULL::VARCHAR AS transform FROM customer
UNION ALL SELECT 'b/' || s_name, 'https://two.example/' || s_name, 'md5', md5(s_name), NULL FROM supplier UNION ALL SELECT n_name, 'https://three.example/' || n_name, 'sha256', md5(n_name), 'base64' FROM nation""")
def manifest_union(table) -> DataFrame:
    """Two sources of lines, and entries that are written out."""
    first = corpus.manifest_entries(table("customer"), F.concat(F.upper(F.md5("c_name")), F.lit(" *"), "c_name"), "a", "https://one.example/")
    second = corpus.manifest_entries(table("supplier"), F.concat(F.md5("s_name"), F.lit("  "), "s_name"), "b", "https://two.example/", "md5")
    third = table("nation").select(F.col("n_name").alias("path"), F.concat(F.lit("https://three.example/"), "n_name").alias("url"), F.lit("sha256").alias("algorithm"), F.md5("n_name").alias("digest"), F.lit("base64").alias("transform"))
    return corpus.union_manifests(first, second, third)


@query("""WITH l AS (SELECT o_custkey, unnest([md5(o_orderkey::VARCHAR) || ' a', '', upper(md5(o_orderpriority)) || '  b', 'bad']) AS raw,
  unnest([0, 1, 2, 3]) AS line, o_orderkey FROM orders)
SELECT o_orderkey, line::INTEGER AS line, CASE WHEN line < 3 THEN lower(raw[1:32]) END AS digest, CASE line WHEN 0 THEN 'a' WHEN 2 THEN 'b' END AS name, CASE line WHEN 3 THEN 'bad line' END AS error
FROM l WHERE line <> 1 AND o_orderkey % 6 > 0 UNION ALL SELECT o_orderkey, NULL, NULL, NULL, 'no frames' FROM orders WHERE o_orderkey % 6 = 0""")
def sidecar_lines(table) -> DataFrame:
    """Sidecars with good and bad lines; every sixth has no line at all."""
    text = F.concat(F.md5(F.col("o_orderkey").cast("string")), F.lit(" a\r\n\n"), F.upper(F.md5("o_orderpriority")), F.lit("  b\nbad"))
    text = F.when(F.col("o_orderkey") % 6 == 0, " \n\t\r\n").otherwise(text)
    return corpus.golden_lines(table("orders").withColumn("sidecar", text), "o_orderkey", "sidecar")


@query("""SELECT p_partkey, (p_size * 16 * p_partkey + 2 * ((p_size * 16 + 1) // 2) * ((p_partkey + 1) // 2))::BIGINT AS i420,
  ((p_partkey + 7) // 8)::BIGINT AS mi, ((p_partkey + 63) // 64)::BIGINT AS sb FROM part""")
def mi_geometry(table) -> DataFrame:
    w, h = (F.col("p_size") * 16).cast("long"), F.col("p_partkey")
    return table("part").select("p_partkey", geometry.i420_bytes(w, h).cast("long").alias("i420"), geometry.mi_units(h).alias("mi"), geometry.superblocks(h).alias("sb"))


@query("""SELECT p_partkey, t.n::BIGINT AS tile, least(((t.n * (((p_partkey + 7) // 8 + 7) // 8)) // 4) * 8, (p_partkey + 7) // 8)::BIGINT AS start
FROM part, range(5) t(n)""")
def tile_grid(table) -> DataFrame:
    tiles = table("part").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("tile"))
    return tiles.select("p_partkey", "tile", geometry.tile_offset(F.col("tile"), geometry.mi_units(F.col("p_partkey")), F.lit(2)).alias("start"))


@query("SELECT o_orderkey, floor(o_orderkey * 1000000.0::DOUBLE * 1001 / 30000 + 0.5)::BIGINT AS us FROM orders")
def ts_to_us(table) -> DataFrame:
    return table("orders").select("o_orderkey", geometry.micros_of_ticks(F.col("o_orderkey"), F.lit(1001), F.lit(30000)).alias("us"))


@query("""SELECT p_partkey, len([m FOR m IN [97, 53, 11] IF 2 * p_size >= p_partkey % m AND 2 * p_size >= p_partkey % (m + 1) AND p_size <= 16 * (p_partkey % m) AND p_size <= 16 * (p_partkey % (m + 1))]) > 0 AS fits FROM part""")
def ref_scale_ok(table) -> DataFrame:
    """Any one of three references is enough."""
    references = F.array(*[F.struct((F.col("p_partkey") % m).alias("w"), (F.col("p_partkey") % (m + 1)).alias("h")) for m in (97, 53, 11)])
    return table("part").select("p_partkey", geometry.reference_fits(F.col("p_size"), F.col("p_size"), references).alias("fits"))


@query("""WITH c AS (SELECT l_partkey, l_orderkey % 255 + 1 AS before, l_quantity::BIGINT AS z, l_linenumber::BIGINT AS o, l_orderkey, l_linenumber FROM lineitem),
d AS (SELECT *, CASE WHEN z + o = 0 THEN 128 ELSE greatest(least((256 * z + (z + o) // 2) // (z + o), 255), 1) END AS seen, 128 * least(z + o, 20) // 20 AS f FROM c)
SELECT l_orderkey, l_linenumber, ((before * (256 - f) + seen * f + 128) // 256)::BIGINT AS merged FROM d""")
def merge_prob(table) -> DataFrame:
    zeros, ones = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    return table("lineitem").select("l_orderkey", "l_linenumber", coding.merge_probability(F.col("l_orderkey") % 255 + 1, zeros, ones, 20, 128).alias("merged"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 3 = 1 THEN greatest(least(p_size + p_partkey % 301 - 20, 255), 0) ELSE p_size * 2 END::BIGINT AS q FROM part""")
def q_index(table) -> DataFrame:
    kind, size = F.col("p_partkey") % 3, F.col("p_size").cast("long")
    data = F.when(kind == 0, size).otherwise(F.col("p_partkey") % 301 - 20)
    return table("part").select("p_partkey", coding.segment_quantiser(F.when(kind == 2, size * 2).otherwise(size), kind != 2, kind == 0, data).cast("long").alias("q"))


@query("""WITH l AS (SELECT p_partkey, p_partkey % 64 AS level, p_partkey % 8 AS sharp FROM part),
m AS (SELECT *, level // (CASE WHEN sharp > 4 THEN 4 WHEN sharp > 0 THEN 2 ELSE 1 END) AS s FROM l),
n AS (SELECT *, greatest(CASE WHEN sharp > 0 THEN least(s, 9 - sharp) ELSE s END, 1) AS lim FROM m)
SELECT p_partkey, lim::BIGINT AS lim, (2 * (level + 2) + lim)::BIGINT AS blim, (level // 16)::BIGINT AS thresh FROM n""")
def lf_limits(table) -> DataFrame:
    limit, blimit, thresh = coding.filter_limits(F.col("p_partkey") % 64, F.col("p_partkey") % 8)
    return table("part").select("p_partkey", limit.cast("long").alias("lim"), blimit.cast("long").alias("blim"), thresh.cast("long").alias("thresh"))


_SAMPLES = "s AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(least(floor((x::DOUBLE + 1) * 128), 255), 0)::BIGINT) AS v FROM embeddings)"


def _samples(table) -> DataFrame:
    sample = lambda x: coding.clip(F.floor((x.cast("double") + 1) * 128), 0, 255).cast("long")
    return table("embeddings").select("vec_id", F.transform("embedding", sample).alias("v"))


@query(f"WITH {_SAMPLES} SELECT vec_id, greatest(least(v[1] + v[2] - v[3], 255), 0) AS predicted FROM s")
def tm_predict(table) -> DataFrame:
    return _samples(table).select("vec_id", coding.true_motion(F.col("v")[0], F.col("v")[1], F.col("v")[2]).alias("predicted"))


@query(f"WITH {_SAMPLES} SELECT vec_id, greatest(least((78 * (v[4] + v[5]) - 19 * (v[3] + v[6]) + 6 * (v[2] + v[7]) - v[1] - v[8] + 64) >> 7, 255), 0) AS half FROM s")
def subpel_1d(table) -> DataFrame:
    return _samples(table).select("vec_id", coding.interpolate(F.col("v"), 0).alias("half"))


@query(f"""WITH {_SAMPLES}, a AS (SELECT vec_id, v[1] + v[2] AS a, v[2] AS c, v[3] - v[4] AS d, v[4] AS b FROM s),
e AS (SELECT *, (a - d) >> 1 AS e FROM a)
SELECT vec_id, [a - (e - b), e - b, e - c, d + e - c] AS out FROM e""")
def wht4(table) -> DataFrame:
    v = F.col("v")
    return _samples(table).select("vec_id", F.array(*coding.walsh_hadamard(v[0], v[1], v[2], v[3])).alias("out"))


@query(f"""WITH {_SAMPLES}
SELECT vec_id, greatest(abs(v[3] - v[4]), abs(v[6] - v[5])) > 8 AS hev,
  greatest(abs(v[1] - v[2]), abs(v[2] - v[3]), abs(v[3] - v[4]), abs(v[6] - v[5]), abs(v[7] - v[6]), abs(v[8] - v[7])) <= 40
    AND abs(v[4] - v[5]) * 2 + abs(v[3] - v[6]) // 2 <= 120 AS inside,
  greatest(abs(v[3] - v[4]), abs(v[6] - v[5]), abs(v[2] - v[4]), abs(v[7] - v[5]), abs(v[1] - v[4]), abs(v[8] - v[5])) <= 1 AS flat FROM s""")
def filter_mask(table) -> DataFrame:
    hev, inside, flat = coding.filter_mask(F.col("v"), F.lit(40), F.lit(120), F.lit(8))
    return _samples(table).select("vec_id", hev.alias("hev"), inside.alias("inside"), flat.alias("flat"))


@query("SELECT s_suppkey, list_concat(range(s_suppkey % 4, s_suppkey % 4 + 3), [s_suppkey % 4 + 9])::INTEGER[] AS cpus, (7 * 2 ** (s_suppkey % 4) + 2 ** (s_suppkey % 4 + 9))::BIGINT AS mask FROM supplier")
def cpu_list_mask(table) -> DataFrame:
    low = F.col("s_suppkey") % 4
    cpus = coding.cpu_list(F.concat_ws(",", low + 9, F.concat_ws("-", low, low + 2)))
    return table("supplier").select("s_suppkey", cpus.alias("cpus")).withColumn("mask", coding.cpu_mask(F.col("cpus")))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, event_type = 'signup' AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT user_id, event_id, n, ms AS start, 0 AS cluster FROM o WHERE n = 1 UNION ALL
  SELECT o.user_id, o.event_id, o.n, CASE WHEN k OR ms - start > 30000 OR ms < start THEN ms ELSE start END, cluster + CASE WHEN k OR ms - start > 30000 OR ms < start THEN 1 ELSE 0 END
  FROM c JOIN o ON o.user_id = c.user_id AND o.n = c.n + 1)
SELECT user_id, event_id, cluster::BIGINT AS cluster FROM c""")
def mux_clusters(table) -> DataFrame:
    """Where a cluster starts depends on the one before."""
    rows = table("events").select("user_id", "event_id", F.floor(bench.micros("ts") / 1000).cast("long").alias("ms"), (F.col("event_type") == "signup").alias("key"))
    return ordering.mux_clusters(rows, "user_id", "event_id", "ms", "key")
