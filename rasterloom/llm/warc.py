"""WARC archives of pages: write, normalise, index and read back.

``archive`` writes each partition's records as *monolithic* gzip streams: one
member holds many records, which cannot be reached without inflating all
before them.  ``normalise`` inflates each stream once, in pieces, rewrites
every record as a gzip member of its own and writes a sidecar index of member
offsets.  ``read`` takes records from the normalised archive by that index
alone.  Archives are rolled at ``roll`` payload bytes, so no archive outgrows
a task; they are rows of a Parquet table, so any store Spark can write to will
hold them and a lost task is simply run again.

Of pages with equal payloads of at least ``min_bytes`` bytes, those with the
least id are ``response`` records and the others are ``revisit`` records that
name it and hold no payload; smaller ones are all responses.

Defined results: a null payload is empty; a null id stays null, and counts as
a response's id only if no equal payload has an id; if rows are repeated, all
rows with the least id are responses; an empty table gives no archive; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.raster_files import RasterFiles
from ._base import as_bytes, written

_GZIP = 31
#: Repeated digests up to which their table (some 100 bytes a row) is broadcast; beyond, rows are shuffled to it.
BROADCAST_ROWS = 200_000
_PIECE = 1 << 20
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _clean(value: str) -> str:
    return "".join(c for c in value if c.isprintable())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit if ``refers_to`` is given."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response")]
    if page_id is not None:
        fields.append(("WARC-Record-ID", f"<urn:page:{page_id}>"))
    if url is not None:
        fields.append(("WARC-Target-URI", _clean(url)))
    fields += [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Named fields, block and total length of the record that ``raw`` begins with."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/") or end < 0:
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    start = end + 4
    stop = start + int(fields["Content-Length"])
    if raw[stop:stop + 4] != b"\r\n\r\n":
        raise ValueError("the record does not end where it says")
    return fields, raw[start:stop], stop + 4


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a stream given in pieces; holds one record at a time."""
    held = bytearray()
    need = 0  # bytes of the record at the front, once its head is read
    at = 0
    for piece in pieces:
        held += piece
        while True:
            if not need:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                head = bytes(held[at:end])
                if not head.startswith(b"WARC/"):
                    raise ValueError("no WARC record here")
                length = next((x[15:].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
                if not length.isdigit():
                    raise ValueError("a WARC record without its length")
                need = end + 4 - at + int(length) + 4
            if len(held) - at < need:
                break
            yield bytes(held[at:at + need])
            at += need
            need = 0
        del held[:at]
        at = 0
    if held:
        raise ValueError("the last record is cut off")


def inflate(gz: bytes) -> Iterator[bytes]:
    """The content of a gzip file of any number of members, in bounded pieces.

    A member that is cut off, or whose checksum does not hold, raises ``ValueError``.
    """
    view = memoryview(gz)
    inflater, at = zlib.decompressobj(_GZIP), 0
    tail, open_member = b"", False
    while at < len(view) or tail:
        if not tail:
            tail = bytes(view[at:at + _PIECE])
            at += len(tail)
        try:
            out = inflater.decompress(tail, _PIECE)
        except zlib.error as e:
            raise ValueError(f"a damaged gzip member: {e}") from e
        open_member = not inflater.eof
        if out:
            yield out
        if inflater.eof:
            tail = inflater.unused_data
            inflater = zlib.decompressobj(_GZIP)
        else:
            tail = inflater.unconsumed_tail
    if open_member:
        raise ValueError("the last gzip member is cut off")


def normalise_archive(gz: bytes, level: int = 6) -> tuple[bytes, list[tuple[int, int]]]:
    """The archive with a member for each record, and each member's offset and length."""
    out, index = bytearray(), []
    for raw in split_records(inflate(gz)):
        deflater = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
        member = deflater.compress(raw) + deflater.flush()
        index.append((len(out), len(member)))
        out += member
    return bytes(out), index


def decisions(pages: DataFrame, min_bytes: int = 100, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pages with ``payload``, ``digest`` and ``refers_to`` (null: a response)."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= min_bytes)
    # one row for each digest that occurs again; counted before the shuffle
    again = large.groupBy("digest").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("d"), "least")
    again = written(again, "warc-repeated")
    # a table of checked size spares the shuffle of all payloads
    if again.limit(broadcast_rows + 1).count() <= broadcast_rows:
        again = F.broadcast(again)
    joined = rows.join(again, F.col("digest") == F.col("d"), "left")
    # a digest found again belongs to a payload that is large enough: equal digests, equal sizes
    return joined.select("page_id", "url", "payload", "digest", F.expr("case when not (page_id <=> least) then least end").alias("refers_to"))


def archive(pages: DataFrame, min_bytes: int = 100, roll: int = 32 << 20, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Monolithic archives, one row each: ``gz``."""

    def run(batches):
        deflater, size, out = None, 0, []
        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for page_id, url, payload, digest, target in zip(ids, urls, as_bytes(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                deflater = deflater or zlib.compressobj(1, zlib.DEFLATED, _GZIP)
                raw = record(page_id, url, payload, digest, target)
                out.append(deflater.compress(raw))
                size += len(raw)
                if size >= roll:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join([*out, deflater.flush()])], pa.binary())], names=["gz"])
                    deflater, size, out = None, 0, []
        if deflater:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join([*out, deflater.flush()])], pa.binary())], names=["gz"])

    return written(decisions(pages, min_bytes, broadcast_rows).mapInArrow(run, "gz binary"), "warc-monolithic", "uncompressed")


def normalise(archives: DataFrame, level: int = 6) -> DataFrame:
    """``gz`` with one member a record, and the sidecar ``offsets`` and ``lengths``.

    An archive that cannot be read whole has null columns and its ``error``.
    """

    def run(batches):
        for batch in batches:
            for gz in batch.column(0).to_pylist():
                try:
                    out, index = normalise_archive(gz or b"", level)
                    row = [out, [x[0] for x in index], [x[1] for x in index], None]
                except ValueError as e:
                    row = [None, None, None, str(e)]
                columns = [pa.array([x], t) for x, t in zip(row, (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["gz", "offsets", "lengths", "error"])

    return written(archives.select("gz").mapInArrow(run, "gz binary, offsets array<long>, lengths array<long>, error string"), "warc", "uncompressed")


def save(normal: DataFrame, path: str) -> None:
    """Normalised archives as files any WARC reader opens: ``<name>.warc.gz`` and its sidecar ``<name>.idx``.

    A line of the sidecar is the offset and length of a record's member.  ``path``
    is a folder of the shared store; files appear when the job has been committed.
    """
    name = F.sha2("gz", 256)
    lines = F.array_join(F.zip_with("offsets", "lengths", lambda o, n: F.concat_ws(" ", o, n)), "\n")
    whole = normal.filter("gz is not null")
    files = whole.select(F.explode(F.array(F.struct(F.concat(name, F.lit(".warc.gz")).alias("name"), F.col("gz").alias("file")), F.struct(F.concat(name, F.lit(".idx")).alias("name"), F.encode(lines, "UTF-8").alias("file")))).alias("f"))
    normal.sparkSession.dataSource.register(RasterFiles)
    files.select("f.name", "f.file").write.format("rasterfiles").mode("append").save(path)


def load(spark: SparkSession, path: str, pattern: str = "*.warc.gz") -> DataFrame:
    """``(name, gz)`` of archive files, monolithic or not, for ``normalise``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("gz"))


def load_indexed(spark: SparkSession, path: str) -> DataFrame:
    """``gz``, ``offsets`` and ``lengths`` of archives that ``save`` wrote, from their sidecars."""
    lines = load(spark, path, "*.idx").select(F.regexp_replace("name", "[.]idx$", "").alias("n"), F.split(F.decode("gz", "UTF-8"), "\n").alias("lines"))
    number = lambda k: F.transform(F.filter("lines", lambda x: x != ""), lambda x: F.split(x, " ")[k].cast("long"))
    sidecars = lines.select("n", number(0).alias("offsets"), number(1).alias("lengths"))
    archives = load(spark, path).select(F.regexp_replace("name", "[.]warc[.]gz$", "").alias("n"), "gz")
    return archives.join(sidecars, "n").select("gz", "offsets", "lengths")


def _page(name: str | None) -> int | None:
    return int(name.removeprefix("<urn:page:").rstrip(">")) if name else None


def describe(member: bytes) -> tuple:
    """What a member's record says, held against its own payload."""
    fields, block, _ = parse(b"".join(inflate(member)))
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x[15:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload is not the one that was written")
    return _page(fields.get("WARC-Record-ID")), size, digest, kind, _page(fields.get("WARC-Refers-To"))


def read(archives: DataFrame) -> DataFrame:
    """One row per record of normalised archives, found by the sidecar index.

    An archive that could not be normalised is an error here: its pages would be missing.
    """
    if "error" in archives.columns:
        archives = archives.withColumn("gz", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("binary")).otherwise(F.col("gz")))

    def run(batches):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for gz, offsets, lengths in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = list(zip(*(describe(gz[o:o + n]) for o, n in zip(offsets, lengths))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    return archives.select("gz", "offsets", "lengths").mapInArrow(run, RECORD)
