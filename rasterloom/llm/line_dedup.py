"""Lines repeated across documents, found by two Bloom filters.

Pass 1 hashes each document's distinct line keys into two filters: ``once``
(seen) and ``twice`` (seen again, here or in another partition).  A partition
sends only the positions it sets, compressed, by segment of the filter; the
segments are merged in parallel.  Pass 2 probes every key against the ``twice``
filter; only suspected repeats are shuffled, as whole keys, where the number
of documents and the largest one are counted exactly.  Filters err on one side
only, so no repeat is missed, and the exact count drops false suspects.  Texts
without a dropped key are never shuffled.

The filter's size follows from the number of lines, which is counted first and
bounds the number of keys: sixteen bits a line, rounded up to a power of two, and
``max_filter_bits`` (2**29, 64 MB) at most, a bound on what is broadcast.  At the
bound a few hundred million lines still leave nearly all single keys clear; far
beyond, more keys become suspects and are shuffled for the exact count, and the
result stays the same.

Defined results: a null or empty text is one empty line; rows that share an id
are one document; null ids are one document, smaller than all others; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import as_bytes, claim_worker, worker_table

_BLANK = b" \t\n\r\x0b\x0c"
_SEGMENT_BITS = 1 << 22
_FLUSH = 1 << 21


def line_keys(raw: bytes) -> list[bytes]:
    """The key of each line: blanks stripped at both ends, A-Z lowered."""
    return [x.strip(_BLANK) for x in raw.lower().split(b"\n")]


def _long(key: bytes, least: int) -> bool:
    """Whether a UTF-8 key has at least ``least`` code points."""
    if len(key) < least:
        return False
    return key.isascii() or len(key) >= 4 * least or len(key.decode()) >= least


def _positions(keys, bits: int) -> np.ndarray:
    """Two filter positions for each key, one row a key."""
    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64)
    return np.stack([whole & np.uint64(bits - 1), (whole >> np.uint64(32)) & np.uint64(bits - 1)], axis=1).astype(np.int64)


def _packed(positions: np.ndarray) -> bytes:
    """Ascending positions as compressed differences."""
    return zlib.compress(np.diff(positions, prepend=0).astype(np.uint32).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.int64))


def repeat_filter(docs: DataFrame, min_chars: int, filter_bits: int) -> DataFrame:
    """``(segment, bits)``: the merged twice-seen filter, by segments that have a bit set."""
    seg = min(_SEGMENT_BITS, filter_bits)

    def build(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            # once: what this stretch has set; twice: what it has set for two keys or documents
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            segments = found // seg
            cuts = np.flatnonzero(np.diff(segments)) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(found))
            rows = [(int(segments[a]), _packed(found[a:b] % seg), _packed(found[a:b][counts[a:b] > 1] % seg)) for a, b in zip(starts, ends)]
            number, once, twice = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["segment", "once", "twice"])

        for batch in batches:
            for raw in as_bytes(batch.column(1)):
                keys = {k for k in line_keys(raw) if _long(k, min_chars)}
                if keys:
                    rows = _positions(keys, filter_bits)
                    held.append(np.unique(rows.ravel()) if len(rows) > 1 or rows[0, 0] == rows[0, 1] else rows.ravel())
                    # positions that two keys of one document share count as seen twice
                    if len(rows) > 1:
                        flat, n = np.unique(rows.ravel(), return_counts=True)
                        if (n > 1).any():
                            held.append(flat[n > 1])
                    size += rows.size
            if size >= _FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def merge(batches):
        once = twice = None
        at = None
        done: list[tuple[int, bytes]] = []
        for batch in batches:
            for segment, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if segment != at:
                    if at is not None:
                        done.append((at, zlib.compress(np.packbits(twice).tobytes(), 1)))
                    at, once, twice = segment, np.zeros(seg, bool), np.zeros(seg, bool)
                here = _unpacked(a)
                twice[_unpacked(b)] = True
                twice[here[once[here]]] = True
                once[here] = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.binary())], names=["segment", "bits"])
                done = []
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(np.packbits(twice).tobytes(), 1)], pa.binary())], names=["segment", "bits"])

    parts = docs.mapInArrow(build, "segment int, once binary, twice binary")
    return parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary")


class _Filter:
    """The twice-seen filter, unpacked once in each Python worker."""

    _open: dict[str, np.ndarray] = {}

    def __init__(self, shared, bits: int):
        self.shared, self.bits, self.name = shared, bits, uuid.uuid4().hex

    def suspects(self, keys: list[bytes]) -> list[bytes]:
        """The keys whose positions are all set."""
        flat = self._open.get(self.name)
        if flat is None:
            seg = min(_SEGMENT_BITS, self.bits)
            flat = np.zeros(self.bits // 8, np.uint8)
            for segment, raw in self.shared.value:
                flat[segment * seg // 8:(segment + 1) * seg // 8] = np.frombuffer(zlib.decompress(raw), np.uint8)
            self._open.clear()
            self._open[self.name] = flat
        at = _positions(keys, self.bits)
        hit = (flat[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
        return [k for k, h in zip(keys, hit.all(axis=1)) if h]


worker_table("line_dedup", _Filter._open.clear)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, filter_bits: int | None = None, max_filter_bits: int = 1 << 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text)`` with repeated lines taken out.

    A key of at least ``min_chars`` code points found in at least ``min_docs``
    documents loses its lines in all but the largest id that holds it.
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    if filter_bits is None:
        breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
        lines = source.agg(F.sum(breaks.cast("long") + 1)).first()[0] or 0
        filter_bits = min(max_filter_bits, max(1 << 20, 1 << (16 * lines - 1).bit_length() if lines else 0))
    if filter_bits & (filter_bits - 1) or not 64 <= filter_bits <= 1 << 32:
        raise ValueError("filter_bits is a power of two, 2**32 at most")
    id_type = dict(source.dtypes)["doc_id"]
    # bounded by filter_bits / 8 bytes, whatever the size of the input
    bits = [(r.segment, bytes(r.bits)) for r in repeat_filter(source, min_chars, filter_bits).collect()]
    probe = _Filter(spark.sparkContext.broadcast(bits), filter_bits)

    def suspected(raw: bytes) -> list[bytes]:
        claim_worker("line_dedup")
        keys = list({k for k in line_keys(raw) if _long(k, min_chars)})
        return probe.suspects(keys) if keys else []

    def find(batches):
        for batch in batches:
            found = [suspected(raw) for raw in as_bytes(batch.column(1))]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            keys = pa.array([k for x in found for k in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), keys], names=["doc_id", "key"])

    def split(clean: bool):
        """Texts without suspects, finished; or the texts with suspects, as they are."""

        def run(batches):
            for batch in batches:
                texts = as_bytes(batch.column(1))
                kept = [i for i, raw in enumerate(texts) if bool(suspected(raw)) != clean]
                part = [texts[i] for i in kept]
                columns = [batch.column(0).take(pa.array(kept, pa.int64()))]
                if clean:
                    columns += [pa.array([x.count(b"\n") + 1 for x in part], pa.int64()), pa.array([0] * len(part), pa.int64())]
                columns.append(pa.array(part, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "text"] if clean else ["doc_id", "text"])

        return run

    def drop(batches):
        for batch in batches:
            out = []
            for raw, gone in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                lines = raw.split(b"\n")
                if gone:
                    gone = set(gone)
                    left = [x for x, k in zip(lines, line_keys(raw)) if k not in gone]
                else:
                    left = lines
                out.append((len(lines), len(lines) - len(left), b"\n".join(left)))
            n, d, t = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(t, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])

    held = source.mapInArrow(find, f"doc_id {id_type}, key binary").distinct()
    counted = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= min_docs)
    losing = held.join(counted.select("key", "last"), "key").filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    lists = losing.groupBy("doc_id").agg(F.collect_list("key").alias("gone")).withColumnRenamed("doc_id", "of")
    result = f"doc_id {id_type}, n_lines long, n_dropped long, text string"
    finished = source.mapInArrow(split(True), result)
    rest = source.mapInArrow(split(False), f"doc_id {id_type}, text string")
    dropped = rest.join(lists, F.col("doc_id").eqNullSafe(F.col("of")), "left").select("doc_id", "text", "gone").mapInArrow(drop, result)
    return finished.unionByName(dropped)
