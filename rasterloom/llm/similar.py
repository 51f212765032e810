"""Near duplicates by similarity: SimHash blocks propose, exact shingle sets decide.

A 64-bit fingerprint within three bits finds texts that are all but equal; at a
shingle similarity of 0.8 fingerprints differ in a sixth of their bits, and no
whole-text fingerprint has blocks that survive that.  Here each block is a
SimHash of its own: shingles are dealt to ``blocks`` classes by their hash, and
a block is the SimHash of the class's ``sample`` least shingles.  Texts of
similarity s share a block with probability about s ** sample, so of twelve
blocks one is shared with probability 0.998 at 0.8 (and more above).

Texts that share a block are joined on it; the Hamming distance of 256-bit
whole-text fingerprints is verified, and a least spanning forest by that
distance is emitted with each text's four nearest: at most 5 m edges of m texts.
Each edge is then held against the similarity of the two sets of shingles.
Texts with more than four others near them may belong to a pair not yet tried:
where such texts of one task are still in different groups, their shingle sets
are brought to the task and joined exactly, so no near pair is left untried.
Pairs never become rows there.  Texts of the same words are one node throughout.
So every pair that shares a block and lies within ``FAR`` bits is either held
against the threshold or lies in one group already: what can be lost is only a
pair that shares no block or lies farther apart, not one that has many neighbours.

A block held by more than ``chunk`` texts is not compared all against all.  Its
texts are first held against eight pivots, a linear number of edges, verified
at once; what they link is connected already.  Only texts outside the block's
largest group so far are then compared with the others, in tasks of two chunks
at most.  A large group of near copies thus costs a few times its size.  The
groups found do not depend on ``chunk``: both ways leave no such pair untried.

Defined results: a null or empty text, or one of blanks, has no words; all of
those are copies of each other.  Of a group the row of least id stays (null ids
last, then the least hash of the row); of rows equal in all columns one stays.
Empty tables stay empty; columns of any name are kept.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import as_bytes, claim_worker, written
from ._components import components

WORDS = 4  # 64-bit words of a whole-text fingerprint
FAR = 58  # bits: a pair of similarity 0.8 lies at 39, seldom over 6 away, and thrice that once in thousands
FEW = 32  # shingles: the distances of shorter texts spread too wide for that cut, they are not cut by it
NEAREST = 4
IN_TASK = 1 << 10  # rows a task where each is compared by its texts
_STEP = 1 << 14
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Ascending distinct hashes of the shingles; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(words) - width + 1))


def whole_print(hashes: np.ndarray) -> np.ndarray:
    """The 256-bit SimHash of a set of shingles, as four words."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), _STEP):
        part = hashes[at:at + _STEP, None] * _MIX
        part ^= part >> np.uint64(32)
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64 * WORDS)
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)


def block_prints(hashes: np.ndarray, blocks: int, sample: int) -> list[int | None]:
    """A SimHash for each class of shingles, over its least ones; empty classes have none."""
    kind = (hashes % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(kind, kind="stable")  # within a class hashes still ascend
    ends = np.searchsorted(kind[order], np.arange(blocks + 1))
    out: list[int | None] = []
    for a, b in zip(ends.tolist(), ends[1:].tolist()):
        own = hashes[order[a:min(b, a + sample)]]
        if not len(own):
            out.append(None)
            continue
        ones = np.unpackbits((own * _MIX[0]).view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0)
        out.append(int(np.packbits(ones * 2 > len(own), bitorder="little").view(np.int64)[0]))
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, blocks: int, sample: int, more: tuple) -> DataFrame:
    """``(doc_id, node, blocks, print, few)`` and the columns in ``more``, one row per input row."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col], *more)
    names = ["doc_id", "node", "blocks", "print", "few", *source.columns[2:]]
    types = dict(source.dtypes) | {"node": "string", "blocks": "array<long>", "print": "array<long>", "few": "boolean"}

    def run(batches):
        claim_worker("similar")
        for batch in batches:
            nodes, keys, prints, few = [], [], [], []
            for raw in as_bytes(batch.column(1)):
                words = raw.lower().split()
                hashes = shingle_set(words, width)
                nodes.append(xxhash.xxh3_128_hexdigest(b" ".join(words)))
                keys.append(block_prints(hashes, blocks, sample))
                prints.append(whole_print(hashes).view(np.int64))
                few.append(len(hashes) < FEW)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes), pa.array(keys, longs), pa.array(prints, longs), pa.array(few, pa.bool_()), *batch.columns[2:]], names=names)

    return source.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names))


def row_keys(docs: DataFrame) -> tuple:
    """Two hashes of all columns, by which a row is found again: ``_row_a`` and ``_row_b``."""
    columns = [(docs[f"`{c}`"], t) for c, t in docs.dtypes]
    every = [F.to_json(F.struct(c)) if "map<" in t else c for c, t in columns]
    return F.xxhash64(*every).alias("_row_a"), F.xxhash64(F.lit("b"), *every).alias("_row_b")


def bounded(rows: DataFrame, limit: int = 1 << 18) -> DataFrame:
    """A narrow table to be joined: broadcast if it is counted to be small, else left to a shuffle."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def least_forest(prints: np.ndarray, far: int, roots: np.ndarray | None = None, nearest: int = 0, crowded: list[int] | None = None, few: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a least spanning forest by Hamming distance, none longer than ``far``.

    Places of the same root are connected already and get no edge.  Grown from
    one place at a time: what is not yet reached keeps its nearest reached place,
    so memory is one row of distances.  ``nearest`` adds that many edges a place;
    places with more than these within ``far`` are appended to ``crowded``.  A pair
    within ``far`` that has no edge lies between two of them.  Places that are
    ``few`` are within ``far`` of all others.
    """
    n = len(prints)
    roots = np.arange(n) if roots is None else roots
    few = np.zeros(n, np.bool_) if few is None else few

    def to(node: int, places: np.ndarray) -> np.ndarray:
        d = np.bitwise_count(prints[places] ^ prints[node]).sum(axis=1, dtype=np.int64)
        d[(d > far) & (few[places] | few[node])] = far
        return np.where(roots[places] == roots[node], -1, d)

    left = np.arange(1, n)
    near = np.zeros(max(0, n - 1), np.int64)
    distance = to(0, left) if n else near
    edges = []
    while len(left):
        k = int(distance.argmin())
        node = int(left[k])
        if 0 <= distance[k] <= far:
            edges.append((int(near[k]), node))
        left, near, distance = np.delete(left, k), np.delete(near, k), np.delete(distance, k)
        to_new = to(node, left)
        closer = to_new < distance
        distance[closer], near[closer] = to_new[closer], node
    if nearest:
        every = np.arange(n)
        for node in range(n):
            d = to(node, every)
            d[d < 0] = far + 1
            if crowded is not None and np.count_nonzero(d <= far) > nearest:
                crowded.append(node)
            for k in np.argpartition(d, nearest - 1)[:nearest] if n > nearest else every:
                if d[k] <= far:
                    edges.append((min(node, int(k)), max(node, int(k))))
    return edges


PIVOTS = 8


def exact_links(sets: list[np.ndarray], roots: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of that similarity that join all places which have it, directly or by others.

    Two sets of similarity s share one of the rarest (1 - s) n + 1 members of each,
    by any one order of all members: only places that meet there are compared.
    """
    n, roots = len(sets), roots.copy()
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    _, members, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.lexsort((members, counts[members], owner))
    rank = np.arange(len(order)) - np.repeat(ends - sizes, sizes)
    rare = order[(rank <= (sizes - np.ceil(similarity * sizes - 1e-9))[owner]) & (counts[members[order]] > 1)]
    rare = rare[np.argsort(members[rare], kind="stable")]
    keys, holders = members[rare], owner[rare]
    first, last = np.searchsorted(keys, keys), np.searchsorted(keys, keys, "right")
    by_owner = np.argsort(holders, kind="stable")
    bounds = np.searchsorted(holders[by_owner], np.arange(n + 1))
    own = np.zeros(len(counts), np.bool_)
    out = []
    for a in range(n):
        met = [holders[first[k]:last[k]] for k in by_owner[bounds[a]:bounds[a + 1]]]
        if not met:
            continue
        others = np.unique(np.concatenate(met))
        others = others[(others > a) & (roots[others] != roots[a])]
        others = others[np.minimum(sizes[others], sizes[a]) >= similarity * np.maximum(sizes[others], sizes[a]) - 1e-9]
        if not len(others):
            continue
        mine = members[ends[a] - sizes[a]:ends[a]]
        own[mine] = True
        for b in others.tolist():
            if roots[a] == roots[b]:
                continue
            common = np.count_nonzero(own[members[ends[b] - sizes[b]:ends[b]]])
            if common >= similarity * (sizes[a] + sizes[b] - common) - 1e-9:
                out.append((a, b))
                roots[roots == roots[b]] = roots[a]
        own[mine] = False
    return out


def shared_blocks(nodes: DataFrame) -> DataFrame:
    """``(choice, bits, node, print, few, n)`` of blocks that n > 1 nodes hold."""
    keyed = nodes.select("node", "print", "few", F.posexplode("blocks").alias("choice", "bits")).filter("bits is not null")
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(sizes, ["choice", "bits"])


def _edge(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def pivot_edges(hot: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` from the texts of each block to its pivots, near by their fingerprints."""
    slot = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
    chosen = hot.groupBy("choice", "bits", slot.alias("slot")).agg(F.min_by(F.struct("node", "print", "few"), F.xxhash64("node", F.lit(1))).alias("pivot"))
    pairs = hot.join(chosen.select("choice", "bits", "pivot"), ["choice", "bits"]).filter("node != pivot.node")
    apart = sum((F.bit_count(F.col("print")[i].bitwiseXOR(F.col("pivot.print")[i])) for i in range(WORDS)), F.lit(0))
    return pairs.filter((apart <= FAR) | F.col("few") | F.col("pivot.few")).select(*_edge("node", "pivot.node")).distinct()


def dealt_small(shared: DataFrame) -> DataFrame:
    """A block a task: ``(choice, bits, i, j, node, print, root, few)``, every node its own root."""
    return shared.select("choice", "bits", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "print", F.col("node").alias("root"), "few")


def dealt_hot(hot: DataFrame, roots: DataFrame, chunk: int) -> DataFrame:
    """Chunks of the texts outside each block's largest group, with chunks of all its texts."""
    rooted = hot.drop("n").join(roots.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("choice", "bits", "node", "print", F.coalesce("root", "node").alias("root"), "few")
    counted = rooted.groupBy("choice", "bits", "root").agg(F.count(F.lit(1)).alias("k"))
    blocks = counted.groupBy("choice", "bits").agg(F.max_by("root", "k").alias("top"), F.sum("k").alias("n"), (F.sum("k") - F.max("k")).alias("others")).filter("others > 0")
    parts = lambda c: F.ceil(F.col(c) / F.lit(chunk)).cast("int")
    rows = rooted.join(blocks, ["choice", "bits"]).withColumns({"gi": parts("others"), "gj": parts("n")})
    rows = rows.withColumns({"ci": F.expr("cast(pmod(xxhash64(node), gi) as int)"), "cj": F.expr("cast(pmod(xxhash64(node), gj) as int)")})
    own = F.expr("if(root != top, transform(sequence(0, gj - 1), j -> struct(ci as i, j as j)), array())")
    whole = F.expr("transform(sequence(0, gi - 1), i -> struct(i as i, cj as j))")
    dealt = rows.select("choice", "bits", "node", "print", "root", "few", F.explode(F.array_distinct(F.concat(own, whole))).alias("pair"))
    return dealt.select("choice", "bits", "pair.i", "pair.j", "node", "print", "root", "few")


TASK = ["choice", "bits", "i", "j"]


def candidates(dealt: DataFrame) -> DataFrame:
    """Edges ``(u, v)`` over nodes dealt to the same task, near by their fingerprints.

    Rows without a ``v`` are the crowded nodes of a task, with its ``TASK`` columns.
    """
    near = dealt.repartition(*TASK).sortWithinPartitions(*TASK)
    types = dict(near.dtypes)
    schema = pa.schema([("u", pa.string()), ("v", pa.string()), *((c, pa.int64() if types[c] == "bigint" else pa.int32()) for c in TASK)])

    def verify(batches):
        claim_worker("similar")
        at, names, prints, roots, few = None, [], [], [], []

        def done():
            if len(names) < 2:
                return []
            _, group = np.unique(np.array(roots), return_inverse=True)
            crowded = []
            edges = set(least_forest(np.array(prints, np.int64).view(np.uint64), FAR, group, NEAREST, crowded, np.array(few)))
            rows = [(max(names[a], names[b]), min(names[a], names[b]), None, None, None, None) for a, b in edges]
            return rows + [(names[k], None, *at) for k in crowded]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            out = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for key, name, words, root, short in zip(keys, *(batch.column(i).to_pylist() for i in (4, 5, 6, 7))):
                if key != at:
                    out += done()
                    at, names, prints, roots, few = key, [], [], [], []
                names.append(name)
                prints.append(words)
                roots.append(root)
                few.append(short)
            if out:
                yield table(out)
        if last := done():
            yield table(last)

    return near.mapInArrow(verify, "u string, v string, " + ", ".join(f"{c} {types[c]}" for c in TASK))


def rest(crowded: DataFrame, roots: DataFrame, docs: DataFrame, own: DataFrame, text_col: str, width: int, similarity: float, n: int) -> DataFrame:
    """Edges ``(u, v)`` between crowded nodes of a task that differ in root, by an exact join of their shingles."""
    rooted = crowded.join(roots.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select(*TASK, "node", F.coalesce("root", "node").alias("root"))
    split = rooted.groupBy(*TASK).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select(*TASK)
    open_nodes = written(rooted.join(split, TASK), "crowded", rows=n)
    table = shingle_table(open_nodes.select("node").distinct(), docs, own, text_col, width, min(n, open_nodes.count()))
    rows = open_nodes.join(table, "node").select(*TASK, "node", "root", "shingles").repartition(*TASK).sortWithinPartitions(*TASK)

    def join(batches):
        claim_worker("similar")
        at, names, roots, sets = None, [], [], []

        def done():
            if len(names) < 2:
                return []
            _, group = np.unique(np.array(roots), return_inverse=True)
            return [(max(names[a], names[b]), min(names[a], names[b])) for a, b in exact_links(sets, group, similarity)]

        for batch in batches:
            out = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for key, name, root, raw in zip(keys, *(batch.column(i).to_pylist() for i in (4, 5, 6))):
                if key != at:
                    out += done()
                    at, names, roots, sets = key, [], [], []
                names.append(name)
                roots.append(root)
                sets.append(np.frombuffer(raw, np.uint64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["u", "v"])
        if last := done():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*last)], names=["u", "v"])

    return rows.mapInArrow(join, "u string, v string").distinct()


def links(nodes: DataFrame, docs: DataFrame, own: DataFrame, text_col: str, width: int, similarity: float, chunk: int, blocks: int) -> tuple[DataFrame, int]:
    """Verified edges that connect all nodes found near each other, and about how many."""
    shared = written(shared_blocks(nodes), "shared", rows=blocks * own.count())  # read several times from here on
    n = shared.count()
    small, hot = shared.filter(F.col("n") <= chunk), shared.filter(F.col("n") > chunk)
    dealt, first = dealt_small(small), None
    if hot.limit(1).count():
        pivots = written(pivot_edges(hot), "pivots", rows=n)
        tried = pivots.count()
        first = written(verified(pivots, docs, own, text_col, width, similarity, tried), "pivot-links", rows=tried, in_file=IN_TASK)
        dealt = dealt.unionByName(dealt_hot(hot, components(first, rows=first.count()), chunk))
    found = written(candidates(dealt), "candidates", rows=n, in_file=IN_TASK)
    tried = found.count()
    linked = verified(found.filter("v is not null").select("u", "v").distinct(), docs, own, text_col, width, similarity, tried)
    linked = linked if first is None else first.unionByName(linked)
    crowded = found.filter("v is null").select(F.col("u").alias("node"), *TASK)
    if not crowded.limit(1).count():
        return linked, tried
    roots = written(components(linked, rows=tried), "links", rows=tried)
    more = rest(crowded, roots, docs, own, text_col, width, similarity, tried)
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), tried


def shingle_table(ends: DataFrame, docs: DataFrame, own: DataFrame, text_col: str, width: int, n: int) -> DataFrame:
    """``(node, shingles)`` of the nodes in ``ends``, n at most: ascending 64-bit hashes."""

    def sets(batches):
        for batch in batches:
            found = [shingle_set(raw.lower().split(), width).tobytes() for raw in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "shingles"])

    # one row of each node in question, fetched by the hash of that row: copies do not meet
    rows = bounded(written(own.join(ends, "node").select("node", "first._row_a", "first._row_b"), "ends", rows=n))
    texts = docs.select(docs[text_col].cast("string").alias("t"), *row_keys(docs)).join(rows, ["_row_a", "_row_b"]).select("node", "t")
    return written(texts.mapInArrow(sets, "node string, shingles binary"), "shingles").dropDuplicates(["node"])


def verified(edges: DataFrame, docs: DataFrame, own: DataFrame, text_col: str, width: int, similarity: float, n: int) -> DataFrame:
    """The edges, n at most, whose texts have at least that share of distinct shingles in common."""
    table = shingle_table(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), docs, own, text_col, width, 2 * n)
    pairs = edges.join(table.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(table.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v").select("u", "v", "a", "b")

    def check(batches):
        for batch in batches:
            kept = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(common >= similarity * (len(a) + len(b) - common) - 1e-9)
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    return pairs.mapInArrow(check, "u string, v string")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, blocks: int = 12, sample: int = 4, chunk: int = 256) -> DataFrame:
    """The rows of ``docs``, one of each group of near duplicates, all columns kept."""
    keys = row_keys(docs)
    found = written(sketches(docs, id_col, text_col, width, blocks, sample, keys), "sketches")
    n = found.count()
    nodes = found.select("node", "blocks", "print", "few").dropDuplicates(["node"])
    # the least row of each node: copies are one row from here on
    own = written(found.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row_a", "_row_b")).alias("first")), "nodes", rows=n)
    edges, tried = links(nodes, docs, own, text_col, width, similarity, chunk, blocks)
    roots = components(edges, rows=tried).withColumnRenamed("node", "n")
    winners = own.join(roots, F.col("node") == F.col("n"), "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    every = found.groupBy("_row_a", "_row_b").agg(F.count(F.lit(1)).alias("copies"))
    first = winners.select(F.col("first._row_a").alias("wa"), F.col("first._row_b").alias("wb"))
    marked = every.join(first, (F.col("_row_a") == F.col("wa")) & (F.col("_row_b") == F.col("wb")), "left")
    # what goes is a smaller table than what stays; rows equal in all columns are one of these two
    marked = written(marked.select(F.col("_row_a").alias("ra"), F.col("_row_b").alias("rb"), "copies", F.col("wa").isNotNull().alias("stays")), "marked", rows=n)
    names = [_free(docs, n) for n in ("_row_a", "_row_b")]
    rows = docs.select("*", *(k.alias(n) for k, n in zip(keys, names)))
    chosen = lambda which: bounded(marked.filter(which).select(F.col("ra").alias(names[0]), F.col("rb").alias(names[1])))
    alone = rows.join(chosen("not stays or copies > 1"), names, "left_anti")
    again = chosen("stays and copies > 1")
    if again.limit(1).count():
        alone = alone.unionByName(rows.join(again, names, "left_semi").dropDuplicates(names))
    return alone.drop(*names)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name
