"""The thin queries over a whole small table, each held against a plain version of its contract."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from rasterloom.llm import queries


@pytest.fixture(scope="module")
def texts(spark, tiny):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}


def rows_of(found, texts, key="doc_id"):
    rows = {r[key]: r for r in found.collect()}
    assert rows.keys() == texts.keys()
    return rows


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_op2(spark, tiny, texts):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    for k, r in rows_of(queries.op2_pii(spark, tiny), texts).items():
        spans = {n: [m.span() for m in re.finditer(p, texts[k]) if ok(m[0])] for n, (p, ok) in kinds.items()}
        assert [r[f"n_{n}"] for n in kinds] == [len(spans[n]) for n in kinds]
        base = [f"{n}:{a}:{b}" for n in kinds for a, b in spans[n]]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        told = r.spans.split(",") if r.spans else []
        assert [s for s in told if s.split(":")[0] in kinds] == base and r.n_spans == len(told)


def test_op3(spark, tiny, texts):
    prints = {}
    for k, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {k: k for k in prints}
    for _ in range(len(root)):
        before = dict(root)
        for a in prints:
            root[a] = min(root[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3)
        if root == before:
            break
    for k, r in rows_of(queries.op3_simhash(spark, tiny), texts).items():
        assert (r.fingerprint, r.component_id) == (f"{prints[k]:016x}", root[k])


def test_op4(spark, tiny, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, start = rows_of(queries.op4_tokens(spark, tiny), texts), 0
    for k in sorted(texts):
        ids = [*library.encode(texts[k], add_special_tokens=False).ids, 2]
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op7(spark, tiny, texts):
    stored = {}
    for k, r in rows_of(queries.op7_media(spark, tiny), texts).items():
        raw = texts[k].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes > r.payload_bytes and stored.setdefault(texts[k], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert len({m for m, _ in stored.values()}) == len(stored)


def test_op9(spark, tiny, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for k, r in rows_of(queries.op9_token_counts(spark, tiny), texts).items():
        n = len(library.encode(texts[k]))
        assert (r.n_bytes, r.n_tokens, r.over_limit, r.n_by_library) == (len(texts[k].encode()), n, n > 4096, 0)
