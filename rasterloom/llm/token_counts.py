"""Exact token counts at every prefix, by dynamic programming over pieces.

A text is cut before each word mark that follows another character, around
line ends, and where a letter or digit is followed by something else: no piece
of the vocabulary spans such a place (checked when the model is loaded), so
the encoding of a text is the encodings of its parts, in order.
For every distinct part a table holds the token count of each of its prefixes:
the last piece of the encoding of ``part[:i]`` is the piece ending at ``i``
that the encoding of what is before it bears, so each prefix takes one step
from a shorter one.  Counts of a text's prefixes are sums over parts, so "how
many tokens has this text", "how many has this prefix" and "how much fits into
this budget" are all read from the tables, without encoding again.  A part for
which the steps find no encoding is the only thing the library is asked for:
its prefixes are encoded one by one, and ``n_by_library`` counts such parts.

Defined results: a null or empty text has no tokens; rows are handled one by
one, so repeated rows repeat and empty tables stay empty; other columns are
not read.  The tables of a worker are bounded by ``CACHE`` parts; those not met
for longest are dropped first.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import accumulate
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._base import as_texts, claim_worker, map_batches, worker_table

MARK = "▁"
#: Parts a worker remembers, and the longest of them; pairs of pieces it remembers.
CACHE, LONGEST, PAIRS = 1_000_000, 64, 400_000
_L = "0-9A-Za-z\u00c0-\u024f"
_FINE = re.compile(f"\n|{MARK}+[^{_L}{MARK}\n]*[{_L}]*|[^{_L}{MARK}\n]+[{_L}]*|[{_L}]+")
_COARSE = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


class _Tables(dict):
    """Tables of parts, made when first met; of two halves the older one is dropped when the younger is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, part: str):
        got = self.older.pop(part, None)
        if got is None:
            got = self.make(part)
        if len(part) <= LONGEST:
            if len(self) >= CACHE // 2:
                self.older = dict(self)
                self.clear()
            self[part] = got
        return got


class PrefixCounter:
    """Prefix token counts for one sentencepiece BPE model."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.sp.get_piece_size()
        skip = (self.sp.is_control, self.sp.is_unknown, self.sp.is_byte, self.sp.is_unused)
        self.rank = {self.sp.id_to_piece(i): -self.sp.get_score(i) for i in range(size) if not any(f(i) for f in skip)}
        self.longest = max(map(len, self.rank))
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.rank):
            raise ValueError("this vocabulary has pieces that go on past a word's end")
        self.cut = _COARSE if any(re.search(f"[{_L}][^{_L}{MARK}]", p) for p in self.rank) else _FINE
        self.line_end = self.sp.piece_to_id("<0x0A>")
        if self.sp.encode("\n")[-1] != self.line_end:
            raise ValueError("this vocabulary does not write a line end as a byte")
        self.alphabet = frozenset(p for p in self.rank if len(p) == 1)
        # pieces that merging their own characters does not rebuild never end an encoding
        self.whole = ahocorasick.Automaton()
        for p in self.rank:
            if len(p) == 1 or self._merged(p) == [p]:
                self.whole.add_word(p, p)
        self.whole.make_automaton()
        self.tables = _Tables(self._made)
        self.asked = 0  # parts the library was asked for
        self.joins: dict[tuple[str, str], bool] = {}

    def _merged(self, part: str) -> list[str]:
        """Greedy merging by rank, for short strings."""
        pieces = list(part)
        while len(pieces) > 1:
            ranks = [self.rank.get(a + b, 1e18) for a, b in zip(pieces, pieces[1:])]
            best = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[best] >= 1e18:
                break
            pieces[best:best + 2] = [pieces[best] + pieces[best + 1]]
        return pieces

    def _stays(self, a: str, b: str) -> bool:
        """Whether two pieces next to each other are both left as they are."""
        got = self.joins.get((a, b))
        if got is None:
            if len(self.joins) >= PAIRS:
                self.joins.clear()
            got = self.joins[a, b] = self._merged(a + b) == [a, b]
        return got

    def _cost(self, piece: str) -> int:
        return 1 if piece in self.rank else len(piece.encode())

    def table(self, part: str):
        """Token counts of ``part[:0]``, ``part[:1]`` and so on."""
        return self.tables[part]

    def _made(self, part: str):
        """The table as bytes or, where counts are larger, an array; a tuple where the library was asked."""
        counts = self._steps(part)
        if counts is None:
            self.asked += 1
            return tuple(self._by_library(part))
        return bytes(counts) if counts[-1] < 256 and max(counts) < 256 else array("q", counts)

    def _steps(self, part: str) -> list[int] | None:
        n = len(part)
        last, counts = [""] * (n + 1), [0] * (n + 1)
        if self.alphabet.issuperset(part):
            for end, piece in self.whole.iter(part):  # ends ascend; of those that end alike, the longest is first
                i = end + 1
                if not last[i]:
                    before = last[i - len(piece)]
                    if i == len(piece) or before and self._stays(before, piece):
                        last[i], counts[i] = piece, counts[i - len(piece)] + 1
        else:
            for i in range(1, n + 1):
                if part[i - 1] not in self.alphabet:
                    last[i], counts[i] = part[i - 1], counts[i - 1] + len(part[i - 1].encode())
                    continue
                for width in range(min(self.longest, i), 0, -1):
                    piece = part[i - width:i]
                    before = last[i - width]
                    if self.whole.exists(piece) and (i == width or before and (before not in self.rank or self._stays(before, piece))):
                        last[i], counts[i] = piece, counts[i - width] + 1
                        break
        return counts if all(last[1:]) else None

    def _library(self, parts: list[str]) -> list[int]:
        """Counts by the library, of parts as they are within a text.

        Line ends belong to no piece, so parts between line ends are encoded in one go.
        """
        if "\n" in parts:
            counts = iter(self._library([p for p in parts if p != "\n"]))
            return [1 if p == "\n" else next(counts) for p in parts]
        ids = self.sp.encode("\n" + "".join(p.replace(MARK, " ") + "\n" for p in parts))
        return (np.diff(np.flatnonzero(np.array(ids) == self.line_end)) - 1).tolist()

    def _by_library(self, part: str) -> list[int]:
        return [0, *self._library([part[:i] for i in range(1, len(part) + 1)])] if part != "\n" else [0, 1]

    def parts(self, text: str) -> list[str]:
        """The text as the model sees it, cut where no piece goes on."""
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of ``text[:0]`` ... ``text[:n]``, n the length in code points."""
        out = [0]
        done = 0
        for k, part in enumerate(self.parts(text)):
            table = self.table(part)
            # the first mark of the text stands for nothing in it
            steps = table[2:] if k == 0 else table[1:]
            out += [done + c for c in steps]
            done += table[-1]
        return np.array(out, np.int64)

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of the text with at most ``budget`` tokens."""
        fits = np.flatnonzero(self.prefix_counts(text) <= budget)
        return text[:int(fits[-1])] if len(fits) else ""

    def count_and_fit(self, text: str, budget: int) -> tuple[int, int, int]:
        """Tokens of the text, the length of its longest prefix within the budget, and the parts the library counted."""
        parts = self.parts(text)
        tables = list(map(self.tables.__getitem__, parts))
        asked = sum(type(t) is tuple for t in tables) if self.asked else 0
        ends = list(accumulate(map(itemgetter(-1), tables)))
        if not ends or ends[-1] <= budget:
            return (ends[-1] if ends else 0), len(text), asked
        k = int(np.searchsorted(ends, budget, side="right"))
        # the budget runs out inside part k; longer prefixes of the part need not have more tokens
        before = ends[k - 1] if k else 0
        length = sum(map(len, parts[:k])) - 1 if k else -1
        inside = [i for i, c in enumerate(tables[k]) if before + c <= budget]
        return ends[-1], max(0, length + inside[-1]), asked


@lru_cache(maxsize=2)
def counter(model_file: str) -> PrefixCounter:
    return PrefixCounter(model_file)


worker_table("token_counts", counter.cache_clear)


def count_tokens(docs: DataFrame, model_file: str, budget: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, n_fitting, n_by_library)`` per input row.

    ``n_fitting`` is the length, in code points, of the longest prefix with at
    most ``budget`` tokens; ``n_by_library`` counts the parts without a table of
    our own.
    """
    source = docs.select(docs[id_col], docs[text_col])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        claim_worker("token_counts")
        model = counter(model_file)
        texts = as_texts(batch.column(1))
        found = [model.count_and_fit(t, budget) for t in texts]
        n = np.array([x[0] for x in found], np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > budget), *(pa.array([x[k] for x in found], pa.int64()) for k in (1, 2))],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_fitting", "n_by_library"],
        )

    return map_batches(source, run, f"doc_id {dict(source.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean, n_fitting long, n_by_library long")
