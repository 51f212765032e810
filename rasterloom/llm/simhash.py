"""Near-duplicate groups of documents by 64-bit SimHash fingerprints.

Fingerprints are computed per Arrow batch.  Equal fingerprints are merged
first, so copies cost one row.  Distinct fingerprints are cut into ``blocks``
pieces of which any two within ``radius`` bits share ``blocks - radius`` whole
ones: every such combination is a key (pigeonhole, so no link is lost), and
only keys held by two or more fingerprints are looked at.  Within a key the
Hamming distances are verified with array operations, and only a spanning
forest of the links is emitted: a group of m fingerprints yields at most m - 1
edges, never its pairs.  A key held by more than ``chunk`` fingerprints is cut
into chunks, and each pair of chunks is a task of its own, so no task ever
holds more than two chunks.

Defined results: a null or empty text, or one of blanks only, has the
fingerprint 0 and is linked like any other; repeated rows are repeated in the
result; a null id stays null and never becomes a component's id unless all ids
of the component are null; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import as_bytes, claim_worker, map_batches, written
from ._components import components

_hash = xxhash.xxh64_intdigest
_STEP = 1 << 16


def fingerprint(raw: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text over shingles of ``width`` ASCII-lowered words."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= width:
        return _hash(b" ".join(words), seed)
    total = n - width + 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.fromiter(map(_hash, shingles, repeat(seed)), np.uint64, total)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, _STEP):
        bits = np.unpackbits(hashes[at:at + _STEP].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, more: tuple = ()) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long, one row per input row.

    The columns in ``more`` are carried along.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col], *more)
    names = ["doc_id", "fp", *source.columns[2:]]
    types = dict(source.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim_worker("simhash")
        fps = np.array([fingerprint(x, width, seed) for x in as_bytes(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=names)

    return map_batches(source, run, ", ".join(f"`{c}` {types.get(c, 'long')}" for c in names))


def block_keys(fp, blocks: int, radius: int):
    """A Spark array of keys: each is the number of a choice of blocks and their bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = []
    for k, kept in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[i] for i in kept)
        keys.append(F.struct(F.lit(k).cast("short").alias("choice"), fp.bitwiseAND(F.lit(signed(mask))).alias("bits")))
    return F.array(*keys)


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct unsigned fingerprints."""
    left = fps
    edges: list[tuple[int, int]] = []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            here = front.pop()
            near = np.bitwise_count(left ^ here) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                edges += [(int(here), int(x)) for x in found]
                front += list(found)
    return edges


def links(nodes: DataFrame, radius: int = 3, blocks: int = 5, chunk: int = 4096) -> DataFrame:
    """Edges ``(u, v)`` over distinct ``fp`` that connect all that lie within ``radius``."""
    keyed = nodes.select("fp", F.explode(block_keys(F.col("fp"), blocks, radius)).alias("key")).select("fp", "key.choice", "key.bits")
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = keyed.join(sizes, ["choice", "bits"])
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    shared = shared.withColumn("g", parts).withColumn("c", F.expr("cast(pmod(xxhash64(fp), g) as int)"))
    # chunk c meets every chunk: as the smaller partner of those after it and the larger of those before
    dealt = shared.select(
        "choice", "bits", "fp", F.explode(F.expr("transform(sequence(0, g - 1), o -> struct(least(c, o) as i, greatest(c, o) as j))")).alias("pair")
    ).select("choice", "bits", "pair.i", "pair.j", "fp")
    near = dealt.repartition("choice", "bits", "i", "j").sortWithinPartitions("choice", "bits", "i", "j")

    def verify(batches):
        held: tuple[tuple, list[np.ndarray]] | None = None  # the group that may go on in the next batch

        def packed(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            ends = np.array(edges, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(i)) for i in range(4)]
            fps = np.asarray(batch.column(4)).view(np.uint64)
            key = lambda k: tuple(int(c[k]) for c in columns)  # noqa: E731, B023
            changes = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            bounds = np.concatenate([[0], np.flatnonzero(changes) + 1, [batch.num_rows]])
            out: list[tuple[int, int]] = []
            if held and held[0] == key(0):
                held[1].append(fps[:bounds[1]])
                bounds = bounds[1:]
            if len(bounds) > 1:
                if held:
                    out += _forest(np.unique(np.concatenate(held[1])), radius)
                whole = np.diff(bounds)[:-1]
                twos = bounds[:-2][whole == 2]
                close = np.bitwise_count(fps[twos] ^ fps[twos + 1]) <= radius
                out += list(zip(fps[twos][close].tolist(), fps[twos + 1][close].tolist()))
                for k in np.flatnonzero(whole > 2):
                    out += _forest(np.unique(fps[bounds[k]:bounds[k + 1]]), radius)
                held = (key(bounds[-2]), [fps[bounds[-2]:]])
            if out:
                yield packed(out)
        if held and (out := _forest(np.unique(np.concatenate(held[1])), radius)):
            yield packed(out)

    found = near.mapInArrow(verify, "u long, v long")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _rooted(prints: DataFrame, radius: int, blocks: int, chunk: int) -> DataFrame:
    """``(fp, root)`` for every distinct fingerprint."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(nodes, radius, blocks, chunk))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, radius: int = 3, blocks: int = 5, chunk: int = 4096) -> DataFrame:
    """``(doc_id, fp, component_id)`` per input row; the id is the least reachable one."""
    prints = written(fingerprints(docs, id_col, text_col, width, seed), "simhash")
    rooted = _rooted(prints, radius, blocks, chunk)
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    member = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(member, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, radius: int = 3, blocks: int = 5, chunk: int = 4096) -> DataFrame:
    """The rows of ``docs``, one of each group: that of the least id, all columns kept.

    Null ids come last; of rows that share an id, the one with the least hash of
    all its columns stays, and of rows equal in all columns, one.
    """
    every = [docs[c] for c in docs.columns]
    keys = (F.xxhash64(*every).alias("_row_a"), F.xxhash64(F.lit("b"), *every).alias("_row_b"))
    prints = written(fingerprints(docs, id_col, text_col, width, seed, keys), "simhash")
    rooted = _rooted(prints, radius, blocks, chunk).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row_a", "_row_b")).alias("first")
    # the least row of each fingerprint before the join, so that copies do not meet there
    winners = prints.groupBy("fp").agg(first).join(rooted, "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = docs.select(*every, *keys).join(winners.select("first._row_a", "first._row_b"), ["_row_a", "_row_b"], "left_semi")
    if prints.groupBy("_row_a", "_row_b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["_row_a", "_row_b"])
    return kept.select(*docs.columns)


def as_hex(fp):
    """A signed fingerprint column as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
