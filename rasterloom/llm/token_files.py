"""Token ids of a corpus in wavelet matrix files, one per shard.

Documents are range-partitioned by the order asked for, encoded, and packed
into shards of about ``shard_tokens`` ids.  A shard is one self-contained
compressed file: a document index and one bit plane per bit of an id, in
wavelet matrix order.  A plane is cut into blocks of 2**15 bits, each compressed
on its own together with its counts of ones by 512 bits; the file's directory
says where a block begins and how many ones are before it.  So ``Shard`` answers
token access, counting and occurrence lookup by rank and select from the few
blocks they meet, and builds nothing when it is opened; ``decode`` reads all
documents back.  ``save`` writes shards as files of their own.

Shards are rows of a Parquet table in shared storage, so any store Spark can
write to will do and a lost task is run again.  The start of a document is the
number of ids before its partition (one sum per partition), plus the ids
before its shard and before itself.

Defined results: a null or empty text holds the end id only; null ids come
first; rows that share an id stay next to each other, in any order; an empty
table gives no shard and an empty result; other columns are not read.  A text
with more ids than ``shard_tokens`` has a shard to itself.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.raster_files import RasterFiles
from ._base import as_texts, claim_worker, map_batches, worker_table, written

#: Words a worker remembers, and the longest of them: some 130 MB at most.
CACHE, LONGEST = 600_000, 64
_MAGIC, _HEAD = b"WMX2", "<4sQQIQ"
#: Bits of a block, which is compressed on its own, and of a part, whose ones are counted in it.
BLOCK, PART = 1 << 15, 512
_BLOCK_BYTES, _PART_WORDS, _COUNT_BYTES = BLOCK // 8, PART // 64, 2 * (BLOCK // PART)
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
# The byte-level split for texts of the characters below, where its letters and numbers are these.
_SPLIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡-±´-¸º»¿-ɏ]")


class Encoder:
    """Ids by the tokenizers library, with its model asked once for each distinct word.

    A byte-level model encodes the pieces of its split one by one.  Texts with
    characters for which the split here is not known to be the library's, or
    with a special token's string, go through the library whole.
    """

    def __init__(self, file: str, end_id: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        said = json.loads(self.library.to_str())
        pre = said.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not said.get("normalizer")
        self.special = [x["content"] for x in said.get("added_tokens", ())]
        self.dtype = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.end = np.array([end_id], self.dtype).tobytes()
        self.words = _Words(self.library.model, self.dtype)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian bytes, the end id last."""
        if not self.by_word or _OTHER.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes() + self.end
        if len(self.words) > CACHE:
            self.words.clear()
        return b"".join([*map(self.words.__getitem__, _SPLIT.findall(text)), self.end])


class _Words(dict):
    """Ids of words, asked from the model when first met."""

    def __init__(self, model, dtype):
        super().__init__()
        self.tokenize = model.tokenize
        # byte-level models write each byte as a printable character: itself, or one past 255
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        self.letters = "".join(chr(b if b in shown else next(hidden)) for b in range(256))
        self.kind = "H" if dtype == np.uint16 else "I"

    def __missing__(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        ids = array(self.kind, [x.id for x in self.tokenize(letters)]).tobytes()
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(file: str, end_id: int) -> Encoder:
    return Encoder(file, end_id)


worker_table("token_files", encoder.cache_clear)


def build(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The file of a shard: header, document index, directory and blocks of bit planes."""
    n = len(ids)
    planes = max(1, int(ids.max()).bit_length()) if n else 1
    packer = zstandard.ZstdCompressor(level=1)
    index = b"".join(
        (np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(), np.packbits(np.array([x is None for x in doc_ids], bool)).tobytes(), np.array(lengths, "<i8").tobytes())
    )
    index = packer.compress(index)
    per_plane = -(-n // BLOCK)
    directory = np.zeros((planes, per_plane + 1, 2), "<u4")  # ones before each block, bytes before it
    blocks: list[bytes] = []
    size = 0
    for k, level in enumerate(range(planes - 1, -1, -1)):
        one = (ids & ids.dtype.type(1 << level)).astype(bool)
        bits = np.packbits(one)
        padded = np.zeros(per_plane * _BLOCK_BYTES, np.uint8)
        padded[:len(bits)] = bits
        counts = np.bitwise_count(padded.view(np.uint64)).reshape(per_plane, BLOCK // PART, _PART_WORDS).sum(axis=2, dtype=np.int64)
        directory[k, 1:, 0] = np.cumsum(counts.sum(axis=1))
        within = (np.cumsum(counts, axis=1) - counts).astype("<u2")
        for j in range(per_plane):
            directory[k, j, 1] = size
            blocks.append(packer.compress(within[j].tobytes() + padded[j * _BLOCK_BYTES:(j + 1) * _BLOCK_BYTES].tobytes()))
            size += len(blocks[-1])
        directory[k, per_plane, 1] = size
        ids = np.concatenate((np.compress(~one, ids), np.compress(one, ids)))
    return b"".join((struct.pack(_HEAD, _MAGIC, len(doc_ids), n, planes, len(index)), index, directory.tobytes(), *blocks))


class Shard:
    """A shard file, opened: a wavelet matrix over its ids.

    ``file`` is anything that can be sliced by bytes.  Only the head, the document
    index and the directory are read here; ``blocks_read`` counts the blocks inflated
    since.  A block is kept until another of its plane is needed.
    """

    def __init__(self, file):
        head = struct.calcsize(_HEAD)
        magic, self.n_docs, self.n, self.planes, size = struct.unpack(_HEAD, file[:head])
        if magic != _MAGIC:
            raise ValueError("no shard file")
        self._file, self._unpack = file, zstandard.ZstdDecompressor()
        index = self._unpack.decompress(file[head:head + size])
        void = np.unpackbits(np.frombuffer(index, np.uint8, -(-self.n_docs // 8), 8 * self.n_docs), count=self.n_docs)
        self.doc_ids = [None if v else x for x, v in zip(np.frombuffer(index, "<i8", self.n_docs).tolist(), void.tolist())]
        self.lengths = np.frombuffer(index, "<i8", self.n_docs, len(index) - 8 * self.n_docs)
        per_plane = -(-self.n // BLOCK)
        at = head + size
        self._first = at + 8 * self.planes * (per_plane + 1)
        table = np.frombuffer(file[at:self._first], "<u4").reshape(self.planes, per_plane + 1, 2)
        self._ones, self._starts = table[:, :, 0].astype(np.int64), table[:, :, 1].astype(np.int64)
        self.zeros = self.n - self._ones[:, -1]
        self._held: dict[int, tuple[int, bytes]] = {}
        self.blocks_read = 0

    def _block(self, plane: int, j: int) -> bytes:
        """The counts and bits of a block."""
        held = self._held.get(plane)
        if held is None or held[0] != j:
            a, b = self._first + self._starts[plane, j], self._first + self._starts[plane, j + 1]
            held = self._held[plane] = j, self._unpack.decompress(self._file[a:b])
            self.blocks_read += 1
        return held[1]

    def _bits(self, plane: int) -> np.ndarray:
        a, b = self._first + self._starts[plane, 0], self._first + self._starts[plane, -1]
        raw = self._file[a:b]
        cuts = (self._starts[plane] - self._starts[plane, 0]).tolist()
        bits = b"".join([self._unpack.decompress(raw[x:y])[_COUNT_BYTES:] for x, y in zip(cuts, cuts[1:])])
        return np.unpackbits(np.frombuffer(bits, np.uint8), count=self.n).view(bool)

    def _rank(self, plane: int, at: int) -> int:
        """Ones among the first ``at`` bits of a plane."""
        j, rest = divmod(at, BLOCK)
        ones = int(self._ones[plane, j])
        if rest:
            block = self._block(plane, j)
            part, bits = divmod(rest, PART)
            if part:
                ones += int.from_bytes(block[2 * part:2 * part + 2], "little") if part < BLOCK // PART else 0
            start = _COUNT_BYTES + part * PART // 8
            if bits:
                ones += (int.from_bytes(block[start:start + PART // 8], "big") >> (PART - bits)).bit_count()
        return ones

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of a kind in a plane."""
        ones = self._ones[plane]
        seen = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        if not 0 <= k < seen[-1]:
            raise IndexError(k)
        j = int(np.searchsorted(seen, k, side="right")) - 1
        block = self._block(plane, j)
        k -= int(seen[j])
        counts = np.frombuffer(block, "<u2", BLOCK // PART).astype(np.int64)
        counts = counts if bit else np.arange(len(counts)) * PART - counts
        part = int(np.searchsorted(counts, k, side="right")) - 1
        k -= int(counts[part])
        own = np.unpackbits(np.frombuffer(block, np.uint8, PART // 8, _COUNT_BYTES + part * PART // 8))
        return j * BLOCK + part * PART + int(np.flatnonzero(own == bit)[k])

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for plane in range(self.planes):
            ones = self._rank(plane, at)
            bit = self._rank(plane, at + 1) - ones
            value = value << 1 | bit
            at = int(self.zeros[plane]) + ones if bit else at - ones
        return value

    def _range(self, symbol: int, start: int, stop: int) -> tuple[int, int]:
        for plane in range(self.planes):
            a, b = self._rank(plane, start), self._rank(plane, stop)
            if symbol >> (self.planes - 1 - plane) & 1:
                zeros = int(self.zeros[plane])
                start, stop = zeros + a, zeros + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, symbol: int, start: int = 0, stop: int | None = None) -> int:
        """How often an id occurs in a range of positions."""
        if symbol < 0 or symbol >> self.planes:
            return 0
        stop = self.n if stop is None else stop
        if not 0 <= start <= stop <= self.n:
            raise IndexError((start, stop))
        a, b = self._range(symbol, start, stop)
        return b - a

    def occurrences(self, symbol: int) -> list[int]:
        """All positions of an id, ascending."""
        if symbol < 0 or symbol >> self.planes:
            return []
        first, last = self._range(symbol, 0, self.n)
        out = []
        for at in range(first, last):
            for plane in range(self.planes - 1, -1, -1):
                bit = symbol >> (self.planes - 1 - plane) & 1
                at = self._select(plane, bit, at - int(self.zeros[plane]) if bit else at)
            out.append(at)
        return out

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes from the last to the first."""
        values = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for plane in range(self.planes - 1, -1, -1):
            one, zeros = self._bits(plane), int(self.zeros[plane])
            out = np.empty_like(values)
            out[np.flatnonzero(~one)] = values[:zeros]
            out[np.flatnonzero(one)] = values[zeros:] | values.dtype.type(1 << (self.planes - 1 - plane))
            values = out
        return values


def _dealt_by_id(rows: DataFrame) -> DataFrame:
    """Rows in as many ranges of ids as a shuffle has partitions, in order.

    The bounds are approximate quantiles of the ids, from a scan of the id column
    alone: a range partitioner would read all texts once more to sample them.
    Bounds only decide how even the ranges are; equal ids stay together.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = [i / parts for i in range(1, parts)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", at, 10 * parts)).first()[0] or [])) if at else []
    step = max(1, int(len(bounds) ** 0.5))
    whole, coarse = F.array(*map(F.lit, bounds)).cast("array<long>"), F.array(*map(F.lit, bounds[step - 1::step])).cast("array<long>")
    # how many bounds lie below the id: whole steps first, then within one
    below = lambda bound: bound < F.col("doc_id")
    steps = F.size(F.filter(coarse, below)) * step
    place = F.when(F.col("doc_id").isNull(), 0).otherwise(steps + F.size(F.filter(F.slice(whole, steps + 1, step), below)))
    return rows.repartitionById(len(bounds) + 1, place)


SHARD = "part int, shard int, first long, n_docs long, n_tokens long, payload binary"


def write_shards(docs: DataFrame, tokenizer_file: str, end_id: int = 2, shard_tokens: int = 1 << 19, order: list | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard files in the order asked for (default: ascending id), one row each."""
    keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *(c.alias(f"k{i}") for i, c in enumerate(order or ())))
    if order:
        keys = [F.col(f"k{i}").asc_nulls_first() for i in range(len(order))]
        dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    else:
        dealt = _dealt_by_id(keyed).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def run(batches):
        claim_worker("token_files")
        model = encoder(tokenizer_file, end_id)
        width = np.dtype(model.dtype).itemsize
        part, shard, first = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def packed():
            lengths = [len(x) // width for x in held]
            file = build(ids, lengths, np.frombuffer(b"".join(held), model.dtype))
            row = (part, shard, first, len(ids), size, file)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "shard", "first", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), as_texts(batch.column(1))):
                raw = model.encode(text)
                n = len(raw) // width
                if ids and size + n > shard_tokens:
                    yield packed()
                    shard, first, size = shard + 1, first + size, 0
                    ids, held = [], []
                ids.append(doc_id)
                held.append(raw)
                size += n
        if ids:
            yield packed()

    return written(dealt.mapInArrow(run, SHARD), "tokens", "uncompressed")


def save(shards: DataFrame, path: str) -> None:
    """Shards as files ``<part>-<shard>.wm``, in a folder of the shared store; they appear when the job has been committed."""
    shards.sparkSession.dataSource.register(RasterFiles)
    name = F.format_string("%08d-%08d.wm", "part", "shard")
    shards.select(name.alias("name"), F.col("payload").alias("file")).write.format("rasterfiles").mode("append").save(path)


def read_back(shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in shard files."""

    def run(batch: pa.RecordBatch):
        claim_worker("token_files.read_back")
        for part, first, file in zip(*(batch.column(i).to_pylist() for i in range(3))):
            shard = Shard(file)
            ids = shard.decode().astype("<u4")
            ends = np.cumsum(shard.lengths)
            starts = ends - shard.lengths
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * shard.n_docs, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(starts + first, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(sums, pa.int64())],
                names=["part", "doc_id", "at", "n_tokens", "ids_crc32"],
            )

    rows = map_batches(shards.select("part", "first", "payload"), run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # one row for each partition that wrote shards: what the sums run over is as short as its task list
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
