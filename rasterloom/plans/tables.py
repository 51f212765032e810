"""Relational queries: bands, offsets, codes, runs, lookups, claims, checks."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks, jpeg
from ..functions import columns as C
from ..functions.deflate import LENGTH_EXTRA, LENGTH_SYMBOL, LENGTH_WIDTH
from ..functions.vp8l import near_codes
from ..operators import bands, images, runs
from .common import Queries, table

Q = Queries()


def values_sql(rows) -> str:
    """Rows as an SQL VALUES list."""
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


# --- bands, offsets, sequence numbers


@Q.add("""WITH h AS (SELECT o_orderkey, (o_orderkey % 1997 + 1)::BIGINT AS height FROM orders),
n AS (SELECT *, greatest(1, least(6, height // 200)) AS n FROM h),
c AS (SELECT o_orderkey, height, unnest(range(n)) AS i, n FROM n),
d AS (SELECT DISTINCT o_orderkey, height, CASE WHEN i = 0 THEN 0 ELSE ((i * height) // n) // 16 * 16 END AS y0 FROM c)
SELECT o_orderkey, (row_number() OVER w - 1)::INT AS band, y0::BIGINT AS y0, coalesce(lead(y0) OVER w, height)::BIGINT AS y1 FROM d WINDOW w AS (PARTITION BY o_orderkey ORDER BY y0)""")
def band_split(spark, folder):
    heights = table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderkey") % 1997 + 1).alias("height"))
    return bands.cut(heights, "height", 200, 16, 3, 2).select("o_orderkey", "band", "y0", "y1")


@Q.add("""WITH s AS (SELECT doc_id, (n_chars % 9000 * 7 % 60000 + 1 + 15) // 16 AS mcus, (doc_id * 4001 % 65000 + 1 + 15) // 16 AS mcu_rows FROM documents),
n AS (SELECT *, greatest(1, least(32, mcu_rows // 4)) AS n FROM s), k AS (SELECT *, (mcu_rows + n - 1) // n AS k FROM n),
r AS (SELECT *, CASE WHEN k * mcus > 65535 THEN 65535 // mcus ELSE k END AS per FROM k)
SELECT doc_id, per::BIGINT AS mcu_rows_each, ((mcu_rows + per - 1) // per)::BIGINT AS intervals, (per * mcus)::BIGINT AS restart_interval FROM r""")
def restart_intervals(spark, folder):
    """Restart intervals of images of sizes made from the documents."""
    sizes = table(spark, folder, "documents").select(
        "doc_id", F.expr("(n_chars % 9000 * 7 % 60000 + 16) div 16").alias("mcus"), F.expr("(doc_id * 4001 % 65000 + 16) div 16").alias("mcu_rows")
    )
    per = sizes.withColumn("mcu_rows_each", C.restart_rows("mcu_rows", "mcus", 16))
    return per.select("doc_id", "mcu_rows_each", F.expr("(mcu_rows + mcu_rows_each - 1) div mcu_rows_each").alias("intervals"), F.expr("mcu_rows_each * mcus").alias("restart_interval"))


@Q.add("""WITH s AS (SELECT doc_id, n_chars % 5000 + 1 AS row_bytes, doc_id * 37 % 9000 + 1 AS height FROM documents),
n AS (SELECT *, greatest(1, least(16, height // greatest(1, (262144 + row_bytes - 1) // row_bytes))) AS n FROM s), p AS (SELECT *, CASE WHEN n = 1 THEN height ELSE height // n END AS per FROM n)
SELECT doc_id, per::BIGINT AS rows_per_strip, ((height + per - 1) // per)::BIGINT AS strips FROM p""")
def strip_plan(spark, folder):
    """Rows of a strip: the height of the first band, and as many strips as that gives."""
    sizes = table(spark, folder, "documents").select("doc_id", (F.col("n_chars") % 5000 + 1).alias("row_bytes"), (F.col("doc_id") * 37 % 9000 + 1).alias("height"))
    cuts = C.band_cuts("height", "((262144 + row_bytes - 1) div row_bytes)", "1", "8", "2")
    per = sizes.withColumn("rows_per_strip", F.coalesce(F.get(cuts, F.lit(1)), F.col("height")))
    return per.select("doc_id", "rows_per_strip", F.expr("(height + rows_per_strip - 1) div rows_per_strip").alias("strips"))


@Q.add("""SELECT source, doc_id, n::BIGINT AS n_bytes, (8 + coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first
FROM (SELECT source, doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)""")
def strip_offsets(spark, folder):
    sizes = table(spark, folder, "documents").select("source", "doc_id", F.octet_length(C.utf8(F.col("text"))).cast("long").alias("n_bytes"))
    return bands.offsets_by_bucket(sizes, "doc_id", "n_bytes", group=["source"], start=8).withColumnRenamed("offset", "first")


@Q.add("""SELECT doc_id, n::BIGINT AS n_bytes, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)""")
def stream_offsets(spark, folder):
    """Offsets over the whole table, bucket by bucket."""
    sizes = table(spark, folder, "documents").select("doc_id", F.octet_length(C.utf8(F.col("text"))).cast("long").alias("n_bytes"))
    return bands.offsets_by_bucket(sizes, "doc_id", "n_bytes").withColumnRenamed("offset", "first")


@Q.add("""SELECT lang, doc_id, (b // 8)::BIGINT AS byte, (b % 8)::INT AS shift FROM (
SELECT lang, doc_id, coalesce(sum(n_chars * 7) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM documents)""")
def bit_offsets(spark, folder):
    """Where bit streams of known lengths (seven bits a character) are spliced."""
    sizes = table(spark, folder, "documents").select("lang", "doc_id", (F.col("n_chars") * 7).alias("n_bits"))
    placed = bands.offsets_by_bucket(sizes, "doc_id", "n_bits", group=["lang"])
    return placed.select("lang", "doc_id", F.expr("offset div 8").alias("byte"), (F.col("offset") % 8).cast("int").alias("shift"))


@Q.add("""WITH e AS (SELECT doc_id, greatest(1, (octet_length(encode(coalesce(text, ''))) + 511) // 512) AS strips FROM documents),
t AS (SELECT doc_id, tag, CASE WHEN per < 0 THEN 4 * strips ELSE per END AS n FROM e, (VALUES (256, 2), (257, 2), (258, 6), (259, 2), (262, 2), (273, -1), (277, 2), (278, 2), (279, -1), (282, 8), (283, 8), (296, 2)) AS s(tag, per))
SELECT doc_id, tag, n::BIGINT AS n_bytes, CASE WHEN n > 4 THEN (8 + 2 + 12 * 12 + 4 + coalesce(sum(CASE WHEN n > 4 THEN n + n % 2 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT END AS value_at FROM t""")
def ifd_layout(spark, folder):
    """Directory entries by tag, and where values over four bytes go."""
    strips = F.greatest(F.lit(1), F.ceil(F.octet_length(C.utf8(F.col("text"))) / 512))
    sizes = {256: 2, 257: 2, 258: 6, 259: 2, 262: 2, 273: None, 277: 2, 278: 2, 279: None, 282: 8, 283: 8, 296: 2}
    entries = F.array(*(F.struct(F.lit(t).alias("tag"), (F.lit(n) if n else 4 * strips).cast("long").alias("n_bytes")) for t, n in sizes.items()))
    rows = table(spark, folder, "documents").select("doc_id", F.inline(entries))
    beyond = F.when(F.col("n_bytes") > 4, F.col("n_bytes") + F.col("n_bytes") % 2).otherwise(0)
    placed = bands.offsets(rows, ["doc_id"], ["tag"], beyond, 8 + 2 + 12 * len(sizes) + 4)
    return placed.select("doc_id", "tag", "n_bytes", F.when(F.col("n_bytes") > 4, F.col("offset")).alias("value_at"))


@Q.add("""WITH f AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events),
c AS (SELECT user_id, frame, unnest(range(1 + CASE WHEN frame = 0 THEN 0 ELSE 1 + event_id % 3 END)) AS part FROM f)
SELECT user_id, frame::INT AS frame, CASE WHEN part = 0 THEN 'fcTL' ELSE 'fdAT' END AS kind, (row_number() OVER (PARTITION BY user_id ORDER BY frame, part) - 1)::INT AS seq FROM c""")
def chunk_layout(spark, folder):
    """Animation chunks that carry a sequence number: a control chunk a frame, data chunks after the first frame."""
    frames = table(spark, folder, "events").select(
        "user_id", "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("frame")
    )
    count = F.when(F.col("frame") == 0, 0).otherwise(1 + F.col("event_id") % 3)
    parts = frames.select("user_id", "frame", F.explode(F.sequence(F.lit(0).cast("long"), count)).alias("part"))
    kind = F.when(F.col("part") == 0, "fcTL").otherwise("fdAT")
    return parts.select("user_id", "frame", kind.alias("kind"), (F.row_number().over(Window.partitionBy("user_id").orderBy("frame", "part")) - 1).alias("seq"))


@Q.add("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey, l_linenumber, ((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) % 8)::INT AS marker FROM d""")
def restart_markers(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return lines.withColumn("marker", F.pmod(F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1, F.lit(8)))


# --- codes


_LENGTHS = "SELECT i::INT AS symbol, CASE WHEN i < 144 THEN 8 WHEN i < 256 THEN 9 WHEN i < 280 THEN 7 ELSE 8 END AS bits FROM range(288) t(i)"


def _fixed_lengths(spark) -> DataFrame:
    s = F.col("id")
    return spark.range(288).select(s.cast("int").alias("symbol"), F.when(s < 144, 8).when(s < 256, 9).when(s < 280, 7).otherwise(8).alias("bits"))


@Q.add(f"""WITH l AS ({_LENGTHS}), k AS (SELECT symbol, bits, coalesce(sum(1 << (15 - bits)) OVER (ORDER BY bits, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT >> (15 - bits) AS code FROM l)
SELECT symbol, bits, code::BIGINT AS code, reverse(lpad(bin(code), bits, '0')) AS written FROM k""")
def canonical_codes(spark, folder):
    """Deflate's fixed code from its lengths."""
    return runs.canonical(_fixed_lengths(spark), "symbol", "bits")


@Q.add(f"SELECT bits, count(*)::BIGINT AS n FROM ({_LENGTHS}) GROUP BY bits")
def code_length_histogram(spark, folder):
    return _fixed_lengths(spark).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))


def _listed(spec):
    counts, symbols = spec
    it = iter(symbols)
    return [(n, k, next(it)) for n, c in enumerate(counts, 1) for k in range(c)]


def _specs(dc, ac) -> list:
    return [(name, n, k, s) for name, spec in (("dc", dc), ("ac", ac)) for n, k, s in _listed(spec)]


_SPECS = _specs(jpeg.DC_LUMA, jpeg.AC_LUMA)
_CHROMA_SPECS = _specs(jpeg.DC_CHROMA, jpeg.AC_CHROMA)
_CODES = """WITH t(name, bits, k, symbol) AS (VALUES {rows})
SELECT name, symbol::INT AS symbol, bits::INT AS bits, (coalesce(sum(1::BIGINT << (16 - bits)) OVER (PARTITION BY name ORDER BY bits, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT >> (16 - bits))::BIGINT AS code FROM t"""


@Q.add(_CODES.format(rows=values_sql(_SPECS)))
def jpeg_codes(spark, folder):
    """The standard's luma codes from their counts and symbols."""
    return _jpeg_codes(spark, _SPECS)


@Q.add(_CODES.format(rows=values_sql(_CHROMA_SPECS)))
def jpeg_codes_chroma(spark, folder):
    return _jpeg_codes(spark, _CHROMA_SPECS)


def _jpeg_codes(spark, specs) -> DataFrame:
    rows = spark.createDataFrame(specs, "name string, bits int, k int, symbol int")
    before = Window.partitionBy("name").orderBy("bits", "k").rowsBetween(Window.unboundedPreceding, -1)
    unit = F.expr("shiftleft(1L, 16 - bits)")
    return rows.select("name", "symbol", "bits", F.coalesce(F.sum(unit).over(before), F.lit(0)).alias("sum")).select("name", "symbol", "bits", F.expr("shiftright(sum, 16 - bits)").alias("code"))


@Q.add("""WITH v AS (SELECT DISTINCT (floor(o_totalprice)::BIGINT % 4096 + 1)::INT AS v FROM orders)
SELECT v, CASE WHEN v < 5 THEN v - 1 ELSE 2 * (length(bin(v - 1)) - 1) + ((v - 1) >> (length(bin(v - 1)) - 2)) % 2 END::INT AS symbol, CASE WHEN v < 5 THEN 0 ELSE length(bin(v - 1)) - 2 END::INT AS extra_bits FROM v""")
def prefix_split(spark, folder):
    v = table(spark, folder, "orders").select((F.floor("o_totalprice") % 4096 + 1).cast("int").alias("v")).distinct()
    return v.select("v", C.prefix_symbol(F.col("v")).alias("symbol"), C.prefix_extra_bits(F.col("v")).alias("extra_bits"))


_DEFLATE = [(n, int(LENGTH_SYMBOL[n]), int(LENGTH_WIDTH[n]), int(LENGTH_EXTRA[n])) for n in range(3, 259)]
_DEFLATE_STARTS = [(s, min(n for n, t, _, _ in _DEFLATE if t == s), max(n for n, t, _, _ in _DEFLATE if t == s)) for s in range(257, 286)]


@Q.add(f"""WITH d(symbol, first, last) AS (VALUES {values_sql(_DEFLATE_STARTS)}), m AS (SELECT (l_quantity::BIGINT * 5 % 256 + 3)::INT AS n FROM lineitem)
SELECT n, symbol::INT AS symbol, count(*)::BIGINT AS uses FROM m JOIN d ON n BETWEEN first AND last GROUP BY ALL""")
def deflate_symbols(spark, folder):
    """Match lengths to symbols: a range lookup in a table of 29 rows, as a literal array."""
    lengths = table(spark, folder, "lineitem").select((F.floor(F.round("l_quantity")) * 5 % 256 + 3).cast("int").alias("n"))
    firsts = F.array(*(F.lit(first) for _, first, _ in _DEFLATE_STARTS))
    symbol = 256 + F.size(F.filter(firsts, lambda f: f <= F.col("n")))
    return lengths.groupBy("n").agg(F.count(F.lit(1)).alias("uses")).select("n", symbol.alias("symbol"), "uses")


_DISTANCES = [(s, 1 + (s if s < 4 else (2 + s % 2) << (s // 2 - 1)), max(0, s // 2 - 1)) for s in range(30)]


@Q.add(f"""WITH t(symbol, first, extra_bits) AS (VALUES {values_sql(_DISTANCES)}), x AS (SELECT (l_orderkey * 7 % 32768 + 1)::INT AS distance, count(*)::BIGINT AS uses FROM lineitem GROUP BY 1)
SELECT distance, max(symbol)::INT AS symbol, max(extra_bits)::INT AS extra_bits, (distance - max(first))::INT AS extra, any_value(uses) AS uses FROM x JOIN t ON first <= distance GROUP BY distance""")
def deflate_distances(spark, folder):
    """Match distances to symbols and extra bits: two symbols a power of two."""
    d = F.col("distance")
    uses = table(spark, folder, "lineitem").groupBy((F.col("l_orderkey") * 7 % 32768 + 1).cast("int").alias("distance")).agg(F.count(F.lit(1)).alias("uses"))
    extra_bits = C.prefix_extra_bits(d)
    return uses.select("distance", C.prefix_symbol(d).alias("symbol"), extra_bits.alias("extra_bits"), F.pmod(d - 1, F.pow(F.lit(2.0), extra_bits).cast("int")).alias("extra"), "uses")


@Q.add("""WITH x AS (SELECT l_partkey % 4096 AS code, l_suppkey % 256 AS byte FROM lineitem)
SELECT code::BIGINT AS code, byte::BIGINT AS byte, (xor((code * 256 + byte) // 4096, code * 256 + byte) % 8192)::INT AS bucket, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def lzw_buckets(spark, folder):
    """LZW phrases by their bucket in a table of 2 ** 13."""
    x = table(spark, folder, "lineitem").select((F.col("l_partkey") % 4096).cast("long").alias("code"), (F.col("l_suppkey") % 256).cast("long").alias("byte"))
    return x.groupBy("code", "byte").agg(F.count(F.lit(1)).alias("n")).select("code", "byte", C.lzw_bucket(F.col("code"), F.col("byte")).alias("bucket"), "n")


@Q.add("SELECT o_orderkey, d::INT AS d, CASE WHEN d = 0 THEN 0 ELSE length(bin(abs(d))) END::INT AS bits FROM (SELECT o_orderkey, (o_custkey % 4001 - 2000) AS d FROM orders)")
def magnitude_bits(spark, folder):
    d = table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 4001 - 2000).cast("int").alias("d"))
    return d.select("o_orderkey", "d", C.magnitude_bits(F.col("d")).cast("int").alias("bits"))


@Q.add("""SELECT p_partkey, p_size AS colours, CASE WHEN p_size <= 2 THEN 1 WHEN p_size <= 4 THEN 2 WHEN p_size <= 16 THEN 4 ELSE 8 END::INT AS depth,
CASE WHEN p_size <= 2 THEN 0 ELSE length(bin(p_size - 1)) - 1 END::INT AS table_bits, ((p_partkey % 5000 * 3 * CASE WHEN p_size <= 2 THEN 1 WHEN p_size <= 4 THEN 2 WHEN p_size <= 16 THEN 4 ELSE 8 END + 7) // 8)::BIGINT AS row_bytes FROM part""")
def schema_inference(spark, folder):
    """Depth, table size and row length of images with palettes of ``p_size`` colours."""
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_size").alias("colours"))
    depth = C.palette_depth(F.col("colours"))
    return parts.select("p_partkey", "colours", depth.cast("int").alias("depth"), C.table_bits(F.col("colours")).cast("int").alias("table_bits"), C.row_bytes(F.col("p_partkey") % 5000, F.lit(3), depth).alias("row_bytes"))


# --- runs


@Q.add("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS j FROM events)
SELECT user_id, event_type, min(i)::INT AS first, count(*)::BIGINT AS n FROM e GROUP BY user_id, event_type, i - j""")
def rle_runs(spark, folder):
    return runs.islands(table(spark, folder, "events"), ["user_id"], ["ts", "event_id"], "event_type")


_CODE_RUNS = """e AS (SELECT user_id, (floor(value)::BIGINT % 2)::INT AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, v ORDER BY i) AS k FROM e), r AS (SELECT user_id, v, k, count(*) AS n FROM g GROUP BY ALL)"""


@Q.add(f"""WITH {_CODE_RUNS}, s AS (SELECT user_id, v, n, CASE WHEN v = 0 THEN n // 138 + CASE WHEN n % 138 >= 11 THEN 1 ELSE 0 END ELSE 0 END AS s18,
CASE WHEN v = 0 AND n % 138 BETWEEN 3 AND 10 THEN 1 ELSE 0 END AS s17, CASE WHEN v <> 0 THEN (n - 1) // 6 + CASE WHEN (n - 1) % 6 >= 3 THEN 1 ELSE 0 END ELSE 0 END AS s16,
CASE WHEN v = 0 THEN CASE WHEN n % 138 < 3 THEN n % 138 ELSE 0 END ELSE 1 + CASE WHEN (n - 1) % 6 < 3 THEN (n - 1) % 6 ELSE 0 END END AS literals FROM r)
SELECT user_id, sum(s16)::BIGINT AS s16, sum(s17)::BIGINT AS s17, sum(s18)::BIGINT AS s18, sum(literals)::BIGINT AS literals FROM s GROUP BY user_id""")
def rle_split_codes(spark, folder):
    """Repeat symbols that a sequence of code lengths is sent as."""
    lengths = table(spark, folder, "events").withColumn("v", (F.floor("value") % 2).cast("int"))
    return runs.repeat_symbols(runs.islands(lengths, ["user_id"], ["ts", "event_id"], "v"), "user_id", "v")


# --- blocks


_COEF = """c AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), q AS (SELECT vec_id, i, round(v * 8)::INT AS v FROM c)"""


@Q.add(f"""WITH {_COEF}, z AS (SELECT vec_id, i, v, row_number() OVER (PARTITION BY vec_id ORDER BY i) AS k FROM q WHERE i > 0 AND v <> 0),
r AS (SELECT vec_id, i, v, i - coalesce(lag(i) OVER (PARTITION BY vec_id ORDER BY i), 0) - 1 AS run FROM z)
SELECT vec_id, i::INT AS place, run::INT AS run, (run // 16)::INT AS zrl, ((run % 16) * 16 + length(bin(abs(v))))::INT AS symbol FROM r""")
def zero_run_ac(spark, folder):
    """Runs of zeros before each AC coefficient, as run-size symbols."""
    return runs.ac_symbols(_levels(spark, folder), "vec_id")


def _levels(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(v * 8).cast("int")).alias("zz"))


@Q.add(f"WITH {_COEF} SELECT vec_id, max(CASE WHEN v <> 0 THEN i ELSE 0 END)::INT AS last, max(CASE WHEN v <> 0 THEN i ELSE 0 END) < 63 AS ends FROM q GROUP BY vec_id")
def block_ends(spark, folder):
    """Blocks whose last coefficient is zero, after which an end-of-block symbol is written."""
    return runs.block_ends(_levels(spark, folder), "vec_id")


@Q.add("""WITH d AS (SELECT label, vec_id, round(embedding[1] * 100)::INT AS dc FROM embeddings)
SELECT label, vec_id, (dc - lag(dc, 1, 0) OVER (PARTITION BY label ORDER BY vec_id))::INT AS diff FROM d""")
def dc_delta(spark, folder):
    d = table(spark, folder, "embeddings").select("label", "vec_id", F.round(F.col("embedding")[0] * 100).cast("int").alias("dc"))
    return bands.previous_by_bucket(d, "vec_id", "dc", 0, group=["label"]).select("label", "vec_id", (F.col("dc") - F.col("previous")).alias("diff"))


@Q.add("""WITH c AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, round(v * 16)::INT AS v FROM c),
k AS (SELECT u, x, cos((2 * x + 1) * u * pi() / 16) / 2 * CASE WHEN u = 0 THEN sqrt(0.5) ELSE 1 END AS b FROM range(8) a(u), range(8) c(x)),
r AS (SELECT vec_id, y, u AS ux, sum(v * b) AS s FROM p JOIN k USING (x) GROUP BY ALL),
d AS (SELECT vec_id, k.u AS uy, ux, sum(s * b) AS s FROM r JOIN k ON r.y = k.x GROUP BY ALL)
SELECT vec_id, (uy * 8 + ux)::INT AS place, round(s, 3) + 0.0 AS coefficient FROM d""")
def dct8x8(spark, folder):
    found = runs.block_dct(table(spark, folder, "embeddings"), "vec_id", "embedding", 16)
    return found.select("vec_id", F.posexplode("dct").alias("place", "c")).select("vec_id", "place", (F.round("c", 3) + 0.0).alias("coefficient"))


def _matrix_sql(m) -> str:
    return values_sql([(u, i, int(c)) for u, row in enumerate(m) for i, c in enumerate(row) if c])


@Q.add(f"""WITH f(u, i, c) AS (VALUES {_matrix_sql(blocks.FOLD)}), t18(u, i, c) AS (VALUES {_matrix_sql(blocks.rotation(18))}), t14(u, i, c) AS (VALUES {_matrix_sql(blocks.rotation(14))}),
e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, greatest(0, least(255, round(v * 400)::BIGINT + 128)) AS v FROM e),
c1 AS (SELECT vec_id, x, u AS i, sum(v * c)::BIGINT AS v FROM p JOIN f ON f.i = p.y GROUP BY ALL),
c2 AS (SELECT vec_id, x, u, sum(v * c)::BIGINT AS v FROM c1 JOIN t18 USING (i) GROUP BY ALL),
c3 AS (SELECT vec_id, x AS i, u AS uy, CASE WHEN u = 0 THEN (v - 1024) * 262144 WHEN u = 4 THEN v * 262144 WHEN u IN (3, 5) THEN (v >> 12) * {blocks.root_2(12)} ELSE v END AS v FROM c2),
r1 AS (SELECT vec_id, uy, f.u AS i, sum(v * c)::BIGINT AS v FROM c3 JOIN f USING (i) GROUP BY ALL),
r2 AS (SELECT vec_id, uy, u, sum(CASE WHEN i < 2 THEN v ELSE v >> 14 END * c)::BIGINT AS v FROM r1 JOIN t14 USING (i) GROUP BY ALL)
SELECT vec_id, (uy * 8 + u)::INT AS place, ((CASE WHEN u IN (3, 5) THEN (v >> 14) * {blocks.root_2(14)} ELSE v END + 131072) >> 18)::BIGINT AS coefficient FROM r2""")
def dct_fixed(spark, folder):
    """The fixed-point DCT, times 8, of samples 0..255: equal to the last bit."""
    level = lambda v: F.greatest(F.least(F.round(v * 400).cast("int") + 128, F.lit(255)), F.lit(0))
    samples = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", level).alias("samples"))
    return runs.block_fixed_dct(samples, "vec_id", "samples").select("vec_id", F.posexplode("dct").alias("place", "coefficient"))


_LUMA = [(i, int(v)) for i, v in enumerate(blocks.LUMA)]
_ZIGZAG = [(k, int(i)) for k, i in enumerate(blocks.ZIGZAG)]


_CHROMA = [(i, int(v)) for i, v in enumerate(blocks.CHROMA)]
_SCALED = """WITH t(i, base) AS (VALUES {rows}), s AS (SELECT q, CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END AS scale FROM range(1, 101) r(q))
SELECT q::INT AS quality, i::INT AS place, greatest(1, least(255, (base * scale + 50) // 100))::INT AS entry FROM t, s"""


@Q.add(_SCALED.format(rows=values_sql(_LUMA)))
def quality_tables(spark, folder):
    """The luma table at every quality: an array a quality, opened; no join."""
    return _scaled_tables(spark, _LUMA)


@Q.add(_SCALED.format(rows=values_sql(_CHROMA)))
def quality_tables_chroma(spark, folder):
    return _scaled_tables(spark, _CHROMA)


def _scaled_tables(spark, base) -> DataFrame:
    entries = F.array(*(C.scaled_entry(F.lit(v), F.col("quality")) for _, v in base))
    return spark.range(1, 101).select(F.col("id").cast("int").alias("quality")).select("quality", F.posexplode(entries).alias("place", "entry"))


@Q.add(f"""WITH t(i, base) AS (VALUES {values_sql(_LUMA)}), c AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
q AS (SELECT vec_id, i, round(v * 4000)::BIGINT AS a, base * 8 AS b FROM c JOIN t USING (i))
SELECT vec_id, i::INT AS place, (sign(a) * ((abs(a) + b // 2) // b))::BIGINT AS level FROM q""")
def quantize(spark, folder):
    base = F.array(*(F.lit(v * 8) for _, v in _LUMA))
    scaled = F.transform("embedding", lambda v: F.round(v * 4000).cast("long"))
    levels = F.zip_with(scaled, base, lambda a, b: C.half_away(a, b))
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode(levels).alias("place", "level"))


@Q.add(f"""WITH z(k, i) AS (VALUES {values_sql(_ZIGZAG)}), c AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, k::INT AS k, round(v * 1000)::INT AS v FROM c JOIN z USING (i)""")
def zigzag(spark, folder):
    order = F.array(*(F.lit(i) for _, i in _ZIGZAG))
    moved = F.transform(order, lambda i: F.round(F.get("embedding", i) * 1000).cast("int"))
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode(moved).alias("k", "v"))


@Q.add("""WITH c AS (SELECT vec_id, round(unnest(embedding) * 100)::INT AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, (i // 16)::INT AS y, (i % 8 // 2)::INT AS x, ((sum(v) + 2) >> 2)::INT AS v FROM (SELECT vec_id, v, i FROM c) GROUP BY vec_id, i // 16, i % 8 // 2""")
def chroma_2x2(spark, folder):
    at = lambda y, x: F.round(F.get("embedding", F.lit(y * 8 + x)) * 100).cast("int")
    means = [F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.shiftright(at(2 * y, 2 * x) + at(2 * y, 2 * x + 1) + at(2 * y + 1, 2 * x) + at(2 * y + 1, 2 * x + 1) + 2, 2).alias("v")) for y in range(4) for x in range(4)]
    return table(spark, folder, "embeddings").select("vec_id", F.inline(F.array(*means)))


_RGB = "(l_partkey % 256)::INT AS r, (l_suppkey % 256)::INT AS g, (l_quantity::BIGINT * 5 % 256)::INT AS b"


def _colours(spark, folder):
    q = F.floor(F.round("l_quantity")) * 5 % 256
    return table(spark, folder, "lineitem").select((F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") % 256).cast("int").alias("g"), q.cast("int").alias("b"))


@Q.add(f"""WITH p AS (SELECT {_RGB} FROM lineitem)
SELECT r, g, b, ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16)::INT AS y, greatest(0, least(255, ((-11056 * r - 21712 * g + 32768 * b + 32768) >> 16) + 128))::INT AS cb,
greatest(0, least(255, ((32768 * r - 27440 * g - 5328 * b + 32768) >> 16) + 128))::INT AS cr, count(*)::BIGINT AS n FROM p GROUP BY ALL""")
def colour_transform(spark, folder):
    rgb = F.col("r"), F.col("g"), F.col("b")
    counted = _colours(spark, folder).groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("r", "g", "b", C.luma(*rgb).alias("y"), C.chroma_blue(*rgb).alias("cb"), C.chroma_red(*rgb).alias("cr"), "n")


@Q.add("""WITH d AS (SELECT doc_id, n_chars AS w, unnest(range(0, 40, 8)) AS x FROM documents)
SELECT doc_id, x::INT AS x, least(x, greatest(0, w % 40 - 1))::BIGINT AS taken FROM d""")
def edge_clamp(spark, folder):
    """Columns read beyond an image's edge are its last one."""
    rows = table(spark, folder, "documents").select("doc_id", F.greatest(F.lit(0), F.col("n_chars") % 40 - 1).alias("last"), F.explode(F.expr("sequence(0, 39, 8)")).alias("x"))
    return rows.select("doc_id", "x", F.least("x", "last").alias("taken"))


# --- lookups


_PALETTE = [(int(i * 37 % 256 * 257), int(i * 91 % 256 * 257), int(i * 53 % 256 * 257), 65535) for i in range(32)]


@Q.add(f"""WITH p(k, pr, pg, pb) AS (VALUES {values_sql([(i, *c[:3]) for i, c in enumerate(_PALETTE)])}), x AS (SELECT {_RGB}, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL),
d AS (SELECT r, g, b, n, k, (((r * 257 - pr)::BIGINT * (r * 257 - pr)) >> 2) + (((g * 257 - pg)::BIGINT * (g * 257 - pg)) >> 2) + (((b * 257 - pb)::BIGINT * (b * 257 - pb)) >> 2) AS d FROM x, p)
SELECT r, g, b, n, arg_min(k, d * 1000 + k)::INT AS nearest FROM d GROUP BY r, g, b, n""")
def nearest_palette(spark, folder):
    counted = _colours(spark, folder).groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    return images.nearest_colours(counted, ["r", "g", "b"], np.array(_PALETTE)[:, :3])


_NEAR = sorted(near_codes(64).items())


@Q.add(f"""WITH m(d, code) AS (VALUES {values_sql(_NEAR)}), x AS (SELECT (l_orderkey % 700 + 1)::INT AS d, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL)
SELECT x.d, coalesce(m.code, x.d + 120)::INT AS code, n FROM x LEFT JOIN m ON x.d = m.d""")
def short_distance_lookup(spark, folder):
    """Distances to codes: a lookup in at most 120 rows, broadcast."""
    near = spark.createDataFrame(_NEAR, "d int, code int")
    x = table(spark, folder, "lineitem").groupBy((F.col("l_orderkey") % 700 + 1).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return x.join(F.broadcast(near), "d", "left").select("d", F.coalesce("code", F.col("d") + 120).alias("code"), "n")


@Q.add(f"""WITH l AS ({_LENGTHS}), x AS (SELECT (o_orderkey % 288)::INT AS symbol, count(*)::BIGINT AS n FROM orders GROUP BY ALL)
SELECT symbol, bits, n, (n * bits)::BIGINT AS total FROM x JOIN l USING (symbol)""")
def symbol_code_join(spark, folder):
    x = table(spark, folder, "orders").groupBy((F.col("o_orderkey") % 288).cast("int").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    return x.join(F.broadcast(_fixed_lengths(spark)), "symbol").select("symbol", "bits", "n", (F.col("n") * F.col("bits")).alias("total"))


@Q.add("""WITH p AS (SELECT p_brand, string_agg(p_size::VARCHAR, ',' ORDER BY p_partkey) AS palette FROM part GROUP BY p_brand), f AS (SELECT palette FROM p ORDER BY p_brand LIMIT 1)
SELECT p_brand, p.palette = f.palette AS shares_first FROM p, f""")
def palette_equality(spark, folder):
    """Palettes compared as they are encoded, with the first one."""
    palettes = table(spark, folder, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_size"))).alias("rows"))
    encoded = palettes.select("p_brand", F.transform("rows", lambda r: r["p_size"]).alias("palette"))
    first = F.min_by("palette", "p_brand").over(Window.partitionBy())  # a palette a brand: a short list
    return encoded.select("p_brand", (F.col("palette") == first).alias("shares_first"))


@Q.add("""SELECT p_brand, max(p_partkey % 256) FILTER (p_size < 25)::BIGINT AS last_clear FROM part GROUP BY p_brand""")
def palette_trim(spark, folder):
    """The last palette index that is not opaque: alphas are written up to it."""
    return table(spark, folder, "part").groupBy("p_brand").agg(F.max(F.when(F.col("p_size") < 25, F.col("p_partkey") % 256)).alias("last_clear"))


@Q.add("""WITH k AS (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation), s AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL),
w AS (SELECT n_regionkey, CASE WHEN n <= 2 THEN 2 ELSE 2 ** length(bin(n - 1)) END::BIGINT AS size FROM s), e AS (SELECT n_regionkey, unnest(range(size)) AS i FROM w)
SELECT n_regionkey, i::INT AS i, coalesce(n_nationkey, 0)::INT AS colour FROM e LEFT JOIN k USING (n_regionkey, i)""")
def colour_table_pad(spark, folder):
    """Colour tables filled up to a power of two with black."""
    lists = table(spark, folder, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("colours"))
    size = F.pow(F.lit(2), C.table_bits(F.size("colours")) + 1).cast("int")
    return lists.select("n_regionkey", F.posexplode(F.concat("colours", F.array_repeat(F.lit(0), size - F.size("colours")))).alias("i", "colour"))


@Q.add("""WITH s AS (SELECT lang, count(*)::BIGINT AS frames, sum(8 + n + n % 2)::BIGINT AS body FROM (SELECT lang, octet_length(encode(coalesce(text, ''))) AS n FROM documents) GROUP BY lang)
SELECT lang, frames, body, (4 + 18 + 14 + body)::BIGINT AS riff FROM s""")
def riff_length(spark, folder):
    sizes = table(spark, folder, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("frames"), F.sum(C.chunk_size(F.octet_length(C.utf8(F.col("text"))))).alias("body"))
    return sizes.withColumn("riff", F.lit(4 + 18 + 14) + F.col("body"))


def _sums(spark, folder):
    """Checksums known for some documents: those of even ids, one of them wrong."""
    docs = table(spark, folder, "documents").filter("doc_id % 2 = 0")
    return docs.select("doc_id", F.when(F.col("doc_id") == 4, F.sha2(F.lit(""), 256)).otherwise(F.sha2(C.utf8(F.col("text")), 256)).alias("known"))


@Q.add(f"""SELECT doc_id, sha256(coalesce(text, '')) AS digest, CASE WHEN doc_id % 2 = 1 THEN 'unknown' WHEN doc_id = 4 AND sha256(coalesce(text, '')) <> '{hashlib.sha256().hexdigest()}' THEN 'changed' ELSE 'known' END AS verdict FROM documents""")
def fixture_check(spark, folder):
    """Contents held against a list of checksums."""
    docs = table(spark, folder, "documents").select("doc_id", F.sha2(C.utf8(F.col("text")), 256).alias("digest"))
    joined = docs.join(_sums(spark, folder), "doc_id", "left")
    verdict = F.when(F.col("known").isNull(), "unknown").when(F.col("known") == F.col("digest"), "known").otherwise("changed")
    return joined.select("doc_id", "digest", verdict.alias("verdict"))


# --- claims, flags, frames


_CLAIMS = "SELECT o_custkey, o_orderkey, (o_orderkey * 7 % 900)::BIGINT AS y0, (o_orderkey * 7 % 900 + 1 + o_orderkey % 60)::BIGINT AS y1 FROM orders"


def _claims(spark, folder):
    y0 = F.col("o_orderkey") * 7 % 900
    return table(spark, folder, "orders").select("o_custkey", "o_orderkey", y0.alias("y0"), (y0 + 1 + F.col("o_orderkey") % 60).alias("y1"))


@Q.add(f"""WITH c AS ({_CLAIMS}) SELECT a.o_custkey, a.o_orderkey, a.y0, a.y1, EXISTS (SELECT 1 FROM c b WHERE b.o_custkey = a.o_custkey AND b.y0 < a.y1 AND a.y0 < b.y1 AND (b.y0, b.o_orderkey) < (a.y0, a.o_orderkey)) AS overlapping FROM c a""")
def overlap_claims(spark, folder):
    return bands.overlaps(_claims(spark, folder), ["o_custkey"], order=["o_orderkey"]).withColumnRenamed("overlaps", "overlapping")


@Q.add(f"""WITH c AS ({_CLAIMS}), r AS (SELECT o_custkey, y0, y1, coalesce(max(y1) OVER (PARTITION BY o_custkey ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM c),
g AS (SELECT o_custkey, reach AS first, y0 AS stop FROM r WHERE reach < y0 UNION ALL SELECT o_custkey, max(y1), 1000 FROM c GROUP BY o_custkey HAVING max(y1) < 1000)
SELECT o_custkey, first::BIGINT AS first, stop::BIGINT AS stop FROM g""")
def missing_ranges(spark, folder):
    claims = _claims(spark, folder).withColumn("height", F.lit(1000).cast("long"))
    return bands.missing(claims, ["o_custkey"], "height")


@Q.add("""SELECT o_custkey, bool_or(o_totalprice < 1000) AS any_alpha, bool_and(o_orderstatus = 'F') AS deep, count(DISTINCT o_orderpriority) = 1 AS shared FROM orders GROUP BY o_custkey""")
def any_all_flags(spark, folder):
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_totalprice") < 1000).alias("any_alpha"), F.bool_and(F.col("o_orderstatus") == "F").alias("deep"), (F.min("o_orderpriority") == F.max("o_orderpriority")).alias("shared"))


@Q.add("""SELECT o_custkey, max(o_orderkey % 900 + 1 + o_orderkey % 60)::BIGINT AS width, coalesce(nullif((o_custkey % 2) * 777, 0), max(o_orderkey % 500 + 1))::BIGINT AS height FROM orders GROUP BY o_custkey""")
def canvas_extent(spark, folder):
    """Canvas sides: given ones, else the farthest frame's."""
    k = F.col("o_orderkey")
    sides = table(spark, folder, "orders").groupBy("o_custkey").agg(F.max(k % 900 + 1 + k % 60).alias("width"), F.max(k % 500 + 1).alias("tall"))
    return sides.select("o_custkey", "width", F.coalesce(F.nullif(F.col("o_custkey") % 2 * 777, F.lit(0).cast("long")), "tall").alias("height"))


_LAYOUT = "CASE o_orderstatus WHEN 'F' THEN 'palette' WHEN 'O' THEN 'rgb' ELSE 'rgba' END"


@Q.add(f"""WITH f AS (SELECT o_custkey, {_LAYOUT} AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 16 ELSE 8 END AS depth FROM orders)
SELECT o_custkey, CASE WHEN bool_and(kind = 'palette') THEN 'palette' WHEN bool_or(kind = 'rgba') THEN 'rgba' ELSE 'rgb' END AS kind, CASE WHEN bool_and(kind = 'palette') THEN 8 ELSE min(depth) END::INT AS depth FROM f GROUP BY o_custkey""")
def frame_union(spark, folder):
    """One layout for all frames: the widest colours, the least depth."""
    status = F.col("o_orderstatus")
    kind = F.when(status == "F", "palette").when(status == "O", "rgb").otherwise("rgba")
    frames = table(spark, folder, "orders").select("o_custkey", kind.alias("kind"), F.when(F.col("o_orderkey") % 3 == 0, 16).otherwise(8).alias("depth"))
    every = F.bool_and(F.col("kind") == "palette")
    return frames.groupBy("o_custkey").agg(
        F.when(every, "palette").when(F.bool_or(F.col("kind") == "rgba"), "rgba").otherwise("rgb").alias("kind"), F.when(every, 8).otherwise(F.min("depth")).cast("int").alias("depth")
    )


@Q.add("""SELECT event_id, CASE WHEN value < 0 THEN 'negative duration' WHEN event_id % 5 = 3 THEN 'odd offset' WHEN user_id % 40 + event_id % 97 > 120 THEN 'outside the canvas' WHEN event_type NOT IN ('click', 'view', 'purchase', 'scroll') THEN 'unknown dispose' END AS error
FROM events WHERE value < 0 OR event_id % 5 = 3 OR user_id % 40 + event_id % 97 > 120 OR event_type NOT IN ('click', 'view', 'purchase', 'scroll')""")
def frame_errors(spark, folder):
    """Frames that cannot be written, each with its first error."""
    error = (
        F.when(F.col("value") < 0, "negative duration")
        .when(F.col("event_id") % 5 == 3, "odd offset")
        .when(F.col("user_id") % 40 + F.col("event_id") % 97 > 120, "outside the canvas")
        .when(~F.col("event_type").isin("click", "view", "purchase", "scroll"), "unknown dispose")
    )
    return table(spark, folder, "events").select("event_id", error.alias("error")).filter("error is not null")


@Q.add("""WITH d AS (SELECT event_id, (event_id * 7919000000 % 900000000000)::BIGINT AS ns FROM events)
SELECT event_id, CASE WHEN ns < 65536000000 THEN ns // 1000000 WHEN ns < 655360000000 THEN ns // 10000000 ELSE least(ns // 1000000000, 65535) END::BIGINT AS num,
CASE WHEN ns < 65536000000 THEN 1000 WHEN ns < 655360000000 THEN 100 ELSE 1 END::INT AS den FROM d""")
def delay_fractions(spark, folder):
    ns = F.col("event_id") * 7919000000 % 900000000000
    return table(spark, folder, "events").select("event_id", C.delay_numerator(ns).cast("long").alias("num"), C.delay_denominator(ns).alias("den"))


# --- statistics


@Q.add("""WITH r AS (SELECT event_type, event_id % 4 AS job, value / nullif(event_id % 7, 0) AS q FROM events)
SELECT event_type, job::BIGINT AS job, round(median(q), 6) AS mid, round(min(q), 6) AS low, round(max(q), 6) AS high, min(q) < 1 AND max(q) > 1 AS unclear, count(q)::BIGINT AS n FROM r GROUP BY event_type, job""")
def ratio_summary(spark, folder):
    """Medians and ranges of ratios; those without a value are left out."""
    r = table(spark, folder, "events").select("event_type", (F.col("event_id") % 4).alias("job"), C.ratio(F.col("value"), F.col("event_id") % 7).alias("q"))
    stats = r.groupBy("event_type", "job").agg(F.percentile("q", 0.5).alias("mid"), F.min("q").alias("low"), F.max("q").alias("high"), F.count("q").alias("n"))
    unclear = ((F.col("low") < 1) & (F.col("high") > 1)).alias("unclear")
    return stats.select("event_type", "job", *(F.round(c, 6).alias(c) for c in ("mid", "low", "high")), unclear, "n")


@Q.add("""SELECT l_returnflag, (sum(d * d) // count(*))::BIGINT AS mse, count(*)::BIGINT AS n FROM (SELECT l_returnflag, (l_quantity::BIGINT - o_custkey % 50) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY l_returnflag""")
def mse(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_orderkey", F.round("l_quantity").cast("long").alias("q"))
    orders = table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("p"))
    d = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_returnflag", (F.col("q") - F.col("p")).alias("d"))
    return d.groupBy("l_returnflag").agg(F.expr("sum(d * d) div count(1)").alias("mse"), F.count(F.lit(1)).alias("n"))


_SHIFTED = "SELECT c_custkey, CASE WHEN c_custkey % 100 = 7 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 50 <> 1"


@Q.add(f"""WITH a AS (SELECT c_custkey, c_mktsegment FROM customer), b AS ({_SHIFTED})
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'missing' ELSE 'changed' END AS verdict FROM a LEFT JOIN b USING (c_custkey) WHERE b.c_custkey IS NULL OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment""")
def equal_tables(spark, folder):
    """Where two images differ, pixel by pixel."""
    a = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    b = a.filter("c_custkey % 50 <> 1").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 100 == 7, "OTHER").otherwise(F.col("c_mktsegment")))
    return runs.differences(a, b, ["c_custkey"])


@Q.add("""WITH e AS (SELECT user_id, event_id % 16 AS slot, (floor(value)::BIGINT) AS px, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
b AS (SELECT user_id, unnest(range(1, (max(i) // 16 + 1)::BIGINT)) AS band FROM e GROUP BY user_id)
SELECT b.user_id, b.band::INT AS band, e.slot::BIGINT AS slot, arg_max(px, i)::BIGINT AS px FROM b JOIN e ON e.user_id = b.user_id AND e.i < b.band * 16 GROUP BY ALL""")
def cache_state_at_band(spark, folder):
    """What each cache slot holds where a band starts: the last pixel before it."""
    e = table(spark, folder, "events").select(
        "user_id", (F.col("event_id") % 16).alias("slot"), F.floor("value").alias("px"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("i")
    )
    return runs.states_at_bands(e, "user_id", "slot", "px", "i", 16)


@Q.add("""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def slugs(spark, folder):
    return table(spark, folder, "part").select("p_partkey", C.slug(F.col("p_name")).alias("slug"))


@Q.add("""SELECT s_suppkey, (row_number() OVER (ORDER BY s_acctbal < 0, s_suppkey))::INT AS place FROM supplier""")
def report_order(spark, folder):
    """Real before synthetic, otherwise as they came; a report's rows are few."""
    order = Window.partitionBy().orderBy(F.col("s_acctbal") < 0, "s_suppkey")
    return table(spark, folder, "supplier").select("s_suppkey", F.row_number().over(order).alias("place"))


@Q.add("""SELECT p_brand, (max(p_size) FILTER (p_retailprice > 950))::INT AS last_used FROM part GROUP BY p_brand""")
def alphabet_trim(spark, folder):
    """The last symbol with a length: what stands after it is not sent."""
    return table(spark, folder, "part").groupBy("p_brand").agg(F.max(F.when(F.col("p_retailprice") > 950, F.col("p_size"))).alias("last_used"))
