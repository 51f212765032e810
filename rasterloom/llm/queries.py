"""The operators of this subpackage over the tables of a folder.

``QUERIES`` maps names to functions of (spark, folder); ``ORACLES`` holds the
same results in SQL where SQL can express them.  Each query runs over its
whole table with its production parameters.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, line_dedup, media, mixing, pii, quality, simhash, token_counts, token_files, warc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Sources mixed in proportion to the square roots of their sizes."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mixed(docs, F.sqrt(F.col("bytes").cast("double"))).drop("text")


def _spans(kinds: tuple[str, ...]):
    """Spans of some kinds as kind:start:end, comma-joined."""
    chosen = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _number(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.detect(table(spark, folder, "documents"))
    scores = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], F.format_number(s["score"], 2))), ",")
    counts = [_number(k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_spans(pii.BASE_KINDS), 256).alias("base_sha256"), _spans(pii.KINDS).alias("spans"), F.size("spans").cast("long").alias("n_spans"), scores.alias("scores"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_tokens(spark: SparkSession, folder: str) -> DataFrame:
    shards = token_files.write_shards(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_back(shards)


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_media(spark: SparkSession, folder: str) -> DataFrame:
    found = media.features(media.store(table(spark, folder, "documents")))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def held_out(id_col):
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels")
    model = quality.fit(docs, labels.filter(~held_out(labels["doc_id"])))
    scored = quality.scored(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read(warc.normalise(warc.archive(table(spark, folder, "pages"))))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_pii, op3_simhash, op4_tokens, op5_decontamination, op6_line_dedup, op7_media, op8_quality, op9_token_counts, op10_warc)}

ORACLES: dict[str, str] = {
    "op1_mixing": """
WITH RECURSIVE
d AS (SELECT doc_id, source, coalesce('=' || source, '') AS skey, md5(coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS dg,
        octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents),
b AS (SELECT *, (('0x' || substr(dg, 1, 6))::BIGINT * 4096) // 16777216 AS bucket FROM d),
placed AS (SELECT doc_id, source, skey, coalesce(sum(size) OVER (PARTITION BY skey ORDER BY bucket, dg, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_byte FROM b),
sized AS (SELECT skey, sum(size)::BIGINT AS bytes FROM b GROUP BY skey),
least_unit AS (SELECT greatest(65536, ceil(sum(bytes) / 262144.0))::BIGINT AS m FROM sized),
units AS (SELECT CASE WHEN m > 65536 THEN 1::BIGINT << length(bin(m - 1)) ELSE 65536 END AS unit FROM least_unit),
weighed AS (SELECT skey, greatest(sqrt(bytes::DOUBLE), 1e-9) AS w, bytes // unit + 1 AS blocks FROM sized, units),
shares AS (SELECT skey, blocks, greatest(round(w / max(w) OVER () * (2199023255552 // count(*) OVER ())), 1)::BIGINT AS u FROM weighed),
lists AS (SELECT list(u ORDER BY skey) AS ul, list(blocks ORDER BY skey) AS bl, list(skey ORDER BY skey) AS sl FROM shares),
sim AS (
  SELECT -1::BIGINT AS t, 0::BIGINT AS start, 0::BIGINT AS epoch, list_sum(ul)::BIGINT AS total, list_transform(ul, lambda x: 0::BIGINT) AS done, list_transform(ul, lambda x: 0::BIGINT) AS base,
    0::BIGINT AS pick, 0::BIGINT AS block, 0::BIGINT AS release, 0::BIGINT AS deadline, 0::BIGINT AS during FROM lists
  UNION ALL
  SELECT t + 1, CASE WHEN ended THEN t + 2 ELSE start END, epoch + ended::BIGINT, CASE WHEN ended THEN total - ul[p] ELSE total END, now, CASE WHEN ended THEN now ELSE base END,
    p, done[p], start + ((done[p] - base[p]) * total) // ul[p], start + ((done[p] - base[p] + 1) * total + ul[p] - 1) // ul[p], epoch
  FROM (SELECT *, done[p] + 1 = bl[p] AS ended, list_transform(done, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END) AS now
    FROM (SELECT *, list_min(list_filter(list_transform(range(1, len(ul) + 1), lambda i:
          CASE WHEN done[i] < bl[i] AND ((done[i] - base[i]) * total) // ul[i] <= t + 1 - start
            THEN (((done[i] - base[i] + 1) * total + ul[i] - 1) // ul[i]) * 100000 + i END),
          lambda v: v IS NOT NULL)) % 100000 AS p
        FROM sim, lists WHERE t + 1 < list_sum(bl)))),
slots AS (SELECT sl[pick] AS skey, block, release, deadline, t AS slot, during FROM sim, lists WHERE t >= 0)
SELECT doc_id, source, block, release, deadline, slot, at_byte, during AS epoch, during = 0 AS on_target
FROM (SELECT *, at_byte // unit AS block FROM placed, units) JOIN slots USING (skey, block)
""",
    "op6_line_dedup": """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op10_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS least FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to FROM m
""",
}
