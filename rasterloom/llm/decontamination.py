"""Benchmark items found in documents, though slightly changed.

Every window of an item's number of words that shares a word shingle with the
item (others have similarity 0) gets a SimHash fingerprint over its shingles,
from running sums of their bits.  An index of the items' fingerprints, cut
into blocks, returns all items within ``radius`` bits: two fingerprints that
close differ by at most ``radius // blocks`` bits in some block, and each block
has a table of all values that near.  What the index returns is verified by
the exact weighted similarity: the sum of the smaller over the sum of the
larger multiplicities of all shingles, at least ``threshold``.

Texts are lowered and cut into words of letters, digits and underscores.  An
item shorter than a shingle is one shingle and must be found as it is; a
document shorter than an item is one window.

Defined results: null or empty texts and items without words match nothing;
each row is handled on its own, so repeated rows repeat; empty tables give an
empty result; other columns are not read.  Items are broadcast in slices of
bounded size, one pass over the documents for each.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import as_texts, claim_worker, map_batches, worker_table

_WORDS = re.compile(r"\w+")
_STEP = 1 << 13
_FILTER = 1 << 20
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def _shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out += hashes[i:i + n] * np.uint64(_MIX[i % 5] + 2 * (i // 5))
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the ``size`` shingles from each start; starts ascend."""
    out = np.zeros(len(starts), np.uint64)
    for at in range(0, len(starts), _STEP):
        here = starts[at:at + _STEP]
        for group in np.split(np.arange(len(here)), np.flatnonzero(np.diff(here) > _STEP) + 1):
            lo, hi = int(here[group[0]]), int(here[group[-1]]) + size
            bits = np.unpackbits(shingles[lo:hi].view(np.uint8), bitorder="little").reshape(-1, 64)
            sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
            ones = sums[here[group] - lo + size] - sums[here[group] - lo]
            out[at + group] = np.packbits(ones * 2 > size, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


class HammingIndex:
    """All fingerprints within a radius, by block tables."""

    def __init__(self, prints: np.ndarray, radius: int, blocks: int = 8):
        self.prints, self.radius, self.blocks = prints, radius, blocks
        self.width = 64 // blocks
        values = np.arange(1 << self.width, dtype=np.uint64)
        near = radius // blocks
        self.tables = []
        for j in range(blocks):
            own = self._block(prints, j)
            hit = np.bitwise_count(values[:, None] ^ own[None, :]) <= near
            ends = np.cumsum(hit.sum(axis=1))
            self.tables.append((np.concatenate([[0], ends]), np.nonzero(hit)[1]))

    def _block(self, prints: np.ndarray, j: int) -> np.ndarray:
        return (prints >> np.uint64(self.width * j)) & np.uint64((1 << self.width) - 1)

    def query(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of the query, number of the indexed print) within the radius."""
        asked, found = [], []
        for j, (ends, members) in enumerate(self.tables):
            value = self._block(prints, j).astype(np.int64)
            counts = ends[value + 1] - ends[value]
            q = np.repeat(np.arange(len(prints)), counts)
            offset = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
            asked.append(q)
            found.append(members[ends[value[q]] + offset])
        pairs = np.unique(np.concatenate(asked) * len(self.prints) + np.concatenate(found))
        q, k = pairs // len(self.prints), pairs % len(self.prints)
        close = np.bitwise_count(prints[q] ^ self.prints[k]) <= self.radius
        return q[close], k[close]


def weighted_similarity(a: list, b: list) -> float:
    """Sum of smaller over sum of larger multiplicities."""
    x, y = Counter(a), Counter(b)
    least = sum(min(n, y[k]) for k, n in x.items())
    return least / (len(a) + len(b) - least) if a or b else 0.0


def shingles_of(words: list[str], width: int) -> list[tuple[str, ...]]:
    return [tuple(words[i:i + width]) for i in range(max(0, len(words) - width + 1))]


class Benchmark:
    """Items with their shingles, and for each length an index of fingerprints."""

    def __init__(self, items: list[tuple[int, str]], width: int, threshold: float, radius: int):
        self.width, self.threshold, self.radius = width, threshold, radius
        self.words = [(i, words_of(t or "")) for i, t in items]
        self.words = [(i, w) for i, w in self.words if w]
        self.of_width: dict[int, tuple] = {}
        self.hashes = [_shingle_hashes(self._hash(w), min(width, len(w))) for _, w in self.words]
        for k in {min(width, len(w)) for _, w in self.words}:
            mine = [n for n, (_, w) in enumerate(self.words) if min(width, len(w)) == k]
            values = np.concatenate([self.hashes[n] for n in mine])
            owner = np.concatenate([np.full(len(self.hashes[n]), n) for n in mine])
            rank = np.argsort(values, kind="stable")
            bitmap = np.zeros(_FILTER, bool)
            bitmap[(values & np.uint64(_FILTER - 1)).astype(np.int64)] = True
            self.of_width[k] = values[rank], owner[rank], bitmap
        self.prints = np.array([_fingerprints(h, np.array([0]), len(h))[0] for h in self.hashes], np.uint64)
        self.by_length: dict[int, tuple[np.ndarray, HammingIndex]] = {}
        for length in {len(w) for _, w in self.words}:
            mine = np.array([n for n, (_, w) in enumerate(self.words) if len(w) == length])
            self.by_length[length] = mine, HammingIndex(self.prints[mine], radius)

    def _hash(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

    def matches(self, text: str) -> list[tuple[int, int, int, float]]:
        """``(item, first word, words, similarity)`` of the best window of each item found."""
        words = words_of(text)
        if not words or not self.words:
            return []
        hashes = self._hash(words)
        best: dict[int, tuple[int, int, float]] = {}
        for k, (values, owner, bitmap) in self.of_width.items():
            doc = _shingle_hashes(hashes, k)
            at = np.flatnonzero(bitmap[(doc & np.uint64(_FILTER - 1)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(values, doc[at], "left"), np.searchsorted(values, doc[at], "right")
            counts = hi - lo
            place = np.repeat(at, counts)
            item = owner[np.repeat(lo, counts) + np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)]
            for length in {len(self.words[n][1]) for n in set(item.tolist())}:
                mine, index = self.by_length[length]
                hits = np.unique(place[np.isin(item, mine)])
                size = min(length, len(words)) - k + 1  # shingles of a window
                last = len(doc) - size
                # every window that holds a hit
                marks = np.zeros(len(doc) + 1, np.int32)
                np.add.at(marks, np.maximum(0, hits - size + 1), 1)
                np.add.at(marks, np.minimum(hits, last) + 1, -1)
                starts = np.flatnonzero(np.cumsum(marks)[:last + 1] > 0)
                for at_start in range(0, len(starts), _STEP):
                    here = starts[at_start:at_start + _STEP]
                    q, found = index.query(_fingerprints(doc, here, size))
                    self._verify(words, doc, here[q], mine[found], size, k, best)
        return [(self.words[n][0], *x) for n, x in sorted(best.items())]

    def _verify(self, words, doc, starts, items, size, k, best) -> None:
        for n in np.unique(items).tolist():
            own = np.sort(self.hashes[n])
            scored = []
            for s in starts[items == n].tolist():
                part = doc[s:s + size]
                # at most so many shingles are shared; exact counts only where that may be enough
                place = np.minimum(np.searchsorted(own, part), len(own) - 1)
                shared = int((own[place] == part).sum())
                if shared >= self.threshold * max(size, len(own)) - 1e-9:
                    scored.append((-shared, s))
            item = shingles_of(self.words[n][1], k)
            for _, s in sorted(scored):
                got = weighted_similarity(shingles_of(words[s:s + size + k - 1], k), item)
                if got >= self.threshold and got > best.get(n, (0, 0, 0.0))[2]:
                    best[n] = s, size + k - 1, got
                    if got == 1.0:
                        break


class _Shared:
    """A benchmark built once in each Python worker from broadcast items."""

    _open: dict[str, Benchmark] = {}

    def __init__(self, items, *settings):
        self.items, self.settings, self.name = items, settings, uuid.uuid4().hex

    def get(self) -> Benchmark:
        claim_worker("decontamination")
        if self.name not in self._open:
            self._open.clear()
            self._open[self.name] = Benchmark(self.items.value, *self.settings)
        return self._open[self.name]


worker_table("decontamination", _Shared._open.clear)


def _slices(items: DataFrame, item_col: str, text_col: str, max_bytes: int):
    """The items on the driver, in slices of about ``max_bytes`` at most."""
    rows = items.select(items[item_col].alias("i"), F.coalesce(items[text_col], F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    count = -(-total // max_bytes) or 1
    for k in range(count):
        part = rows if count == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k)
        yield [(r.i, r.t) for r in part.collect()]


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, radius: int = 23, max_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, first_word, n_words, similarity)`` of every item found in a document."""
    spark = docs.sparkSession
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    id_type, item_type = dict(source.dtypes)["doc_id"], dict(items.dtypes)[item_col]
    out = None
    for part in _slices(items, item_col, item_text, max_bytes):
        shared = _Shared(spark.sparkContext.broadcast(part), width, threshold, radius)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            found = [shared.get().matches(t) for t in as_texts(batch.column(1))]
            at = pa.array([k for k, x in enumerate(found) for _ in x], pa.int64())
            item, first, n, score = zip(*(m for x in found for m in x)) if len(at) else ((), (), (), ())
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(item), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(score, pa.float64())] if len(at) else [batch.column(0).take(at), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

        rows = map_batches(source, run, f"doc_id {id_type}, item_id {item_type}, first_word long, n_words long, similarity double")
        out = rows if out is None else out.unionAll(rows)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, radius: int = 23, max_bytes: int = 16 << 20, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of documents in which no item is found, all columns kept, unshuffled."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for part in _slices(items, item_col, item_text, max_bytes):
        shared = _Shared(spark.sparkContext.broadcast(part), width, threshold, radius)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            return batch.filter(pa.array([not shared.get().matches(t) for t in as_texts(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(lambda batches, run=run: map(run, batches), docs.schema)
    return docs
