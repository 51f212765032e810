"""Scanlines, filters, predictors and statistics of byte images."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.predictors import AVERAGE, PAETH
from ..operators import bands, images
from .common import BYTES, PIXELS, Queries, spread, table, text_images

Q = Queries()

_NEAR = f"""
{PIXELS},
n AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE lag(v, 1, 0) OVER w END AS a, lag(v, 64, 0) OVER w AS b,
        CASE WHEN x = 0 THEN 0 ELSE lag(v, 65, 0) OVER w END AS c FROM px WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, y, x, i, v, v AS r0, (v - a + 256) % 256 AS r1, (v - b + 256) % 256 AS r2, (v - (a + b) // 2 + 256) % 256 AS r3,
        (v - CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a
                  WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END + 256) % 256 AS r4 FROM n),
k AS (SELECT doc_id, y, sum(least(r0, 256 - r0))::BIGINT AS c0, sum(least(r1, 256 - r1))::BIGINT AS c1, sum(least(r2, 256 - r2))::BIGINT AS c2,
        sum(least(r3, 256 - r3))::BIGINT AS c3, sum(least(r4, 256 - r4))::BIGINT AS c4 FROM f GROUP BY doc_id, y),
best AS (SELECT doc_id, y, least(c0, c1, c2, c3, c4) AS cost,
        CASE least(c0, c1, c2, c3, c4) WHEN c2 THEN 2 WHEN c4 THEN 4 WHEN c0 THEN 0 WHEN c1 THEN 1 ELSE 3 END AS filter FROM k)
"""


@Q.add(f"WITH {_NEAR} SELECT doc_id, y, filter, cost FROM best")
def row_filter_select(spark, folder):
    return images.row_filters(text_images(spark, folder)).withColumnRenamed("image_id", "doc_id")


@Q.add(f"WITH {_NEAR} SELECT doc_id, y, filter, cost FROM best")
def row_filter_halo(spark, folder):
    rows = images.scanlines(text_images(spark, folder))
    return images.row_filters_halo(rows).withColumnRenamed("image_id", "doc_id")


@Q.add(f"WITH {_NEAR} SELECT doc_id, y, c0 AS none, c1 AS sub, c2 AS up, c3 AS average, c4 AS paeth FROM k")
def filter_costs(spark, folder):
    return images.filter_costs(text_images(spark, folder)).withColumnRenamed("image_id", "doc_id")


@Q.add(f"WITH {_NEAR} SELECT filter, count(*)::BIGINT AS n_rows, sum(cost)::BIGINT AS total_cost FROM best GROUP BY filter")
def filter_histogram(spark, folder):
    found = images.row_filters(text_images(spark, folder))
    return found.groupBy("filter").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("cost").alias("total_cost"))


@Q.add(f"""WITH {PIXELS},
n AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE lag(v, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) END AS a FROM px),
f AS (SELECT doc_id, y // 16 AS band, v AS r0, (v - a + 256) % 256 AS r1 FROM n WHERE y % 16 = 0),
k AS (SELECT doc_id, band, sum(least(r0, 256 - r0))::BIGINT AS c0, sum(least(r1, 256 - r1))::BIGINT AS c1 FROM f GROUP BY doc_id, band)
SELECT doc_id, band::INT AS band, CASE WHEN c0 <= c1 THEN 0 ELSE 1 END AS filter, least(c0, c1) AS cost FROM k""")
def detached_first_row(spark, folder):
    return images.detached_first_rows(text_images(spark, folder)).withColumnRenamed("image_id", "doc_id")


@Q.add(f"WITH {_NEAR} SELECT doc_id, sum(r4)::BIGINT AS total, count(*)::BIGINT AS n FROM f GROUP BY doc_id")
def paeth_residual(spark, folder):
    return images.residual_sums(text_images(spark, folder), PAETH).withColumnRenamed("image_id", "doc_id")


@Q.add(f"WITH {_NEAR} SELECT doc_id, sum(r3)::BIGINT AS total, count(*)::BIGINT AS n FROM f GROUP BY doc_id")
def avg_residual(spark, folder):
    return images.residual_sums(text_images(spark, folder), AVERAGE).withColumnRenamed("image_id", "doc_id")


@Q.add(f"""WITH {PIXELS}, r AS (SELECT doc_id, y, string_agg(v::VARCHAR, ',' ORDER BY x) AS s FROM px GROUP BY doc_id, y),
e AS (SELECT doc_id, s = lag(s) OVER (PARTITION BY doc_id ORDER BY y) AS same FROM r)
SELECT doc_id, count(*)::BIGINT AS n_rows, (count(*) FILTER (same))::BIGINT AS n_equal FROM e GROUP BY doc_id""")
def equal_rows(spark, folder):
    """Rows equal to the one above: their residual under Up is zero."""
    rows = images.filter_costs(text_images(spark, folder))
    return rows.groupBy(F.col("image_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if((F.col("up") == 0) & (F.col("y") > 0)).alias("n_equal"))


@Q.add(f"""WITH {PIXELS}, n AS (SELECT doc_id, v, CASE WHEN x < 4 THEN 0 ELSE lag(v, 4, 0) OVER (PARTITION BY doc_id ORDER BY i) END AS a FROM px)
SELECT doc_id, sum((v - a + 256) % 256)::BIGINT AS total FROM n GROUP BY doc_id""")
def tiff_predictor(spark, folder):
    return images.horizontal_sums(text_images(spark, folder), 4).withColumnRenamed("image_id", "doc_id")


@Q.add(f"""WITH {PIXELS}, w AS (SELECT doc_id, i // 2 AS j, x // 2 AS wx, sum(v * CASE WHEN i % 2 = 0 THEN 1 ELSE 256 END) AS v FROM px GROUP BY ALL),
n AS (SELECT doc_id, v, CASE WHEN wx < 2 THEN 0 ELSE lag(v, 2, 0) OVER (PARTITION BY doc_id ORDER BY j) END AS a FROM w)
SELECT doc_id, sum((v - a + 65536) % 65536)::BIGINT AS total FROM n GROUP BY doc_id""")
def tiff_predictor_16(spark, folder):
    return images.horizontal_sums(text_images(spark, folder), 2, wide=True).withColumnRenamed("image_id", "doc_id")


@Q.add(f"""WITH {PIXELS} SELECT doc_id, md5(unhex(string_agg(printf('%02X', v), '' ORDER BY i // 2, i % 2 DESC))) AS digest FROM px GROUP BY doc_id""")
def swap16(spark, folder):
    return images.swapped(text_images(spark, folder)).select(F.col("image_id").alias("doc_id"), F.md5("raw").alias("digest"))


_ARGB = f"""
{PIXELS},
q AS (SELECT doc_id, i // 4 AS j, y, x // 4 AS x, max(v) FILTER (i % 4 = 0) AS a, max(v) FILTER (i % 4 = 1) AS r,
        max(v) FILTER (i % 4 = 2) AS g, max(v) FILTER (i % 4 = 3) AS b FROM px GROUP BY ALL)
"""


@Q.add(f"WITH {_ARGB} SELECT doc_id, sum((r - g + 256) % 256)::BIGINT AS red, sum(g)::BIGINT AS green, sum((b - g + 256) % 256)::BIGINT AS blue FROM q GROUP BY doc_id")
def subtract_green(spark, folder):
    return images.green_subtracted(text_images(spark, folder)).withColumnRenamed("image_id", "doc_id")


@Q.add(f"""WITH {PIXELS}, q AS (SELECT doc_id, i // 4 AS j, max(v) FILTER (i % 4 = 0) AS r, max(v) FILTER (i % 4 = 1) AS g,
        max(v) FILTER (i % 4 = 2) AS b, max(v) FILTER (i % 4 = 3) AS a FROM px GROUP BY ALL),
s AS (SELECT doc_id, CASE WHEN a = 0 THEN 0 ELSE ((r::BIGINT * 257 * 65535) // (a * 257)) >> 8 END AS r, CASE WHEN a = 0 THEN 0 ELSE ((g::BIGINT * 257 * 65535) // (a * 257)) >> 8 END AS g,
        CASE WHEN a = 0 THEN 0 ELSE ((b::BIGINT * 257 * 65535) // (a * 257)) >> 8 END AS b FROM q)
SELECT doc_id, sum(r % 256)::BIGINT AS red, sum(g % 256)::BIGINT AS green, sum(b % 256)::BIGINT AS blue FROM s GROUP BY doc_id""")
def unpremultiply(spark, folder):
    return images.straight_sums(text_images(spark, folder)).withColumnRenamed("image_id", "doc_id")


_CHANNELS = ("a", "r", "g", "b")


def _tile_sql() -> str:
    """The 14 predictions, each written once for all channels."""
    mean = lambda p, q: f"(({p} + {q}) // 2)"
    clamp = lambda e: f"greatest(0, least(255, {e}))"
    to_left = " + ".join(f"abs(tl{c} - t{c})" for c in _CHANNELS)
    to_top = " + ".join(f"abs(tl{c} - l{c})" for c in _CHANNELS)

    def guesses(c):
        left, t, tl, tr = f"l{c}", f"t{c}", f"tl{c}", f"tr{c}"
        half = f"({mean(left, t)} - {tl})"
        return [
            "255" if c == "a" else "0", left, t, tr, tl, mean(mean(left, tr), t), mean(left, tl), mean(left, t), mean(tl, t), mean(t, tr),
            mean(mean(left, tl), mean(t, tr)), f"CASE WHEN {to_left} < {to_top} THEN {left} ELSE {t} END", clamp(f"{left} + {t} - {tl}"),
            clamp(f"{mean(left, t)} + CASE WHEN {half} < 0 THEN -((-{half}) // 2) ELSE {half} // 2 END"),
        ]

    def residual(c, guess):
        first = 255 if c == "a" else 0
        chosen = f"CASE WHEN x = 0 AND y = 0 THEN {first} WHEN y = 0 THEN l{c} WHEN x = 0 THEN t{c} ELSE {guess} END"
        return f"(({c} - ({chosen}) + 512) % 256)"

    costs, totals = [], []
    for m in range(14):
        parts = [residual(c, guesses(c)[m]) for c in _CHANNELS]
        totals.append("sum(" + " + ".join(parts) + f")::BIGINT AS r{m}")
        costs.append("sum(" + " + ".join(f"least({p}, 256 - {p})" for p in parts) + f")::BIGINT AS c{m}")
    lags = ", ".join(f"lag({c}, {n}, 0) OVER w AS {k}{c}" for c in _CHANNELS for k, n in (("l", 1), ("t", 16), ("tl", 17), ("tr", 15)))
    least = "least(" + ", ".join(f"c{m}" for m in range(14)) + ")"
    first = " ".join(f"WHEN c{m} THEN {m}" for m in range(14))
    total = " ".join(f"WHEN c{m} THEN r{m}" for m in range(14))
    return f"""WITH {_ARGB}, n AS (SELECT *, {lags} FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
k AS (SELECT doc_id, x // 16 AS tx, y // 16 AS ty, {', '.join(costs + totals)} FROM n GROUP BY ALL)
SELECT doc_id, tx::INT AS tx, ty::INT AS ty, CASE {least} {first} END AS mode, {least} AS cost, CASE {least} {total} END AS total FROM k"""


@Q.add(f"SELECT doc_id, tx, ty, mode, cost FROM ({_tile_sql()})")
def tile_mode_argmin(spark, folder):
    return images.tile_modes(text_images(spark, folder)).withColumnRenamed("image_id", "doc_id")


@Q.add(f"SELECT doc_id, tx, ty, total FROM ({_tile_sql()})")
def tile_residual(spark, folder):
    """Residuals under the mode chosen for each tile."""
    return images.tile_residuals(text_images(spark, folder)).withColumnRenamed("image_id", "doc_id")


@Q.add(f"""WITH {PIXELS} SELECT doc_id, y, upper(string_agg(printf('%02X', w), '' ORDER BY g)) AS packed FROM (
SELECT doc_id, y, x // 4 AS g, sum((v % 4) << (6 - 2 * (x % 4)))::INT AS w FROM px GROUP BY ALL) GROUP BY doc_id, y""")
def pack_indices(spark, folder):
    found = images.packed_indices(text_images(spark, folder), 2)
    return found.select(F.col("image_id").alias("doc_id"), "y", F.hex("packed").alias("packed"))


_ADLER = f"WITH {BYTES}, t AS (SELECT doc_id, count(*) AS n FROM px GROUP BY doc_id)"


@Q.add(_ADLER + """ SELECT doc_id, n::BIGINT AS n, (((n + sum((n - i) * v)) % 65521) * 65536 + (1 + sum(v)) % 65521)::BIGINT AS adler
FROM px JOIN t USING (doc_id) GROUP BY doc_id, n""")
def adler32_doc(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    # rows of one byte: nothing is filled up
    bytes_ = images.from_bytes(docs, "doc_id", C.utf8(F.col("text")), 1).filter("height > 0")
    return images.adler(bytes_).withColumnRenamed("image_id", "doc_id")


@Q.add(_ADLER + """, c AS (SELECT doc_id, n, greatest(1, least(8, ((n + 63) // 64) // 4)) AS k FROM t)
SELECT doc_id, k::INT AS bands, (((n + sum((n - i) * v)) % 65521) * 65536 + (1 + sum(v)) % 65521)::BIGINT AS adler FROM px JOIN c USING (doc_id) GROUP BY doc_id, n, k""")
def adler32_band_fold(spark, folder):
    """Sums of bands made apart and folded in order: the sum of the whole."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", C.utf8(F.col("text")).alias("raw")).filter("octet_length(raw) > 0")
    return bands.folded_adler(docs, "doc_id", row_bytes=64, least_rows=4, workers=4, per_worker=2)


@Q.add(f"WITH {PIXELS} SELECT v AS symbol, count(*)::BIGINT AS n FROM px GROUP BY v")
def byte_histogram(spark, folder):
    return images.histogram(text_images(spark, folder)).select("symbol", "n")


@Q.add(f"WITH {PIXELS} SELECT (i % 4)::INT AS alphabet, v AS symbol, count(*)::BIGINT AS n FROM px GROUP BY ALL")
def global_symbol_counts(spark, folder):
    return images.histogram(text_images(spark, folder), 4)


@Q.add(f"""WITH {PIXELS}, s AS (SELECT doc_id, i, v = lag(v, 4) OVER (PARTITION BY doc_id ORDER BY i) AND i >= 4 AS same FROM px),
g AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM s WHERE same),
r AS (SELECT doc_id, island, count(*) AS n FROM g GROUP BY ALL), d AS (SELECT DISTINCT doc_id FROM px)
SELECT doc_id, count(n)::BIGINT AS runs, coalesce(max(n), 0)::BIGINT AS longest, coalesce(sum(n), 0)::BIGINT AS covered FROM d LEFT JOIN r USING (doc_id) GROUP BY doc_id""")
def match_runs(spark, folder):
    return images.match_runs(text_images(spark, folder).filter("height > 0"), 4).withColumnRenamed("image_id", "doc_id")


@Q.add("""SELECT doc_id, k::INT AS seq, (k * 255)::BIGINT AS first, least(255, n - k * 255)::INT AS n_bytes FROM (
SELECT doc_id, n, unnest(range((n + 254) // 255)) AS k FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents))""")
def chunk_split_255(spark, folder):
    return bands.sub_blocks(table(spark, folder, "documents").select("doc_id", F.octet_length(C.utf8(F.col("text"))).alias("n")), "doc_id", 255)


@Q.add(f"""WITH {_ARGB} SELECT ((((a::BIGINT * 16777216 + r * 65536 + g * 256 + b) * 506832829) & 4294967295) >> 22)::INT AS slot, count(*)::BIGINT AS n FROM q GROUP BY 1""")
def cache_slots(spark, folder):
    """Pixels by colour-cache slot."""
    rows = images.scanlines(text_images(spark, folder))
    words = F.expr("transform(sequence(0, 15), k -> conv(hex(substring(raw, 4 * k + 1, 4)), 16, 10))")
    return rows.select(F.explode(words).alias("word")).select(C.cache_slot(F.col("word")).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


@Q.add(f"""WITH {_ARGB}, w AS (SELECT doc_id, y, x, a::HUGEINT * 16777216 + r * 65536 + g * 256 + b AS p FROM q),
n AS (SELECT p, lead(p) OVER (PARTITION BY doc_id, y ORDER BY x) AS p2 FROM w)
SELECT (xor(((p * 506832829) & 4294967295)::BIGINT, ((p2 * 2654435761) & 4294967295)::BIGINT) >> 16)::INT AS bucket, count(*)::BIGINT AS n FROM n WHERE p2 IS NOT NULL GROUP BY 1""")
def pair_buckets(spark, folder):
    """Neighbouring pixels of a row by the bucket a match search looks in."""
    rows = images.scanlines(text_images(spark, folder))
    words = F.expr("transform(sequence(0, 15), k -> cast(conv(hex(substring(raw, 4 * k + 1, 4)), 16, 10) as bigint))")
    buckets = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: C.pair_hash(F.get("words", k), F.get("words", k + 1)))
    return rows.select(words.alias("words")).select(F.explode(buckets).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@Q.add(f"""WITH {_ARGB} SELECT doc_id, bool_or(a < 255) AS any_alpha, bool_and(a = 255) AS opaque FROM q GROUP BY doc_id""")
def alpha_flags(spark, folder):
    rows = images.scanlines(text_images(spark, folder))
    alphas = F.expr("transform(sequence(0, 15), k -> substring(raw, 4 * k + 1, 1))")
    see_through = F.exists(alphas, lambda a: a != F.lit(b"\xff"))
    return rows.groupBy(F.col("image_id").alias("doc_id")).agg(F.bool_or(see_through).alias("any_alpha"), F.bool_and(~see_through).alias("opaque"))
