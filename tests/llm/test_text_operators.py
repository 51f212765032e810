"""Operators on single texts, held against plain versions of themselves."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from rasterloom.llm import line_dedup, media, pii, simhash, token_counts, token_files

SCHEMA = "doc_id long, text string, source string, spans string, fp string"
ODD = [
    (1, None, None, "x", "y"),
    (2, "", "a", None, "y"),
    (3, " \t\n ", "a", "x", None),
    (None, "mail me: a.b@c-d.example.org, +1 (555) 010-9999 ok", "b", "x", "y"),
    (5, "same words here and there", "b", "x", "y"),
    (5, "same words here and there", "b", "x", "y"),
    (6, "same words here and there", "c", "x", "y"),
    (7, "long " * 40_000, "c", "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- personal data


def plain_base(text):
    """The contract's patterns, straight."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(1)
    pieces = ["a", "b.c", "@", "@x.y", ".", "+", "+1 ", "-", " ", "12", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "300.1.1.1", "é", "(", ")", "0", "00123.1.2.255", "%", "\n", "5500-0000-0000-0004"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        got = [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]
        assert got == plain_base(text), text


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    kinds = lambda t: [s[0] for s in pii.find_spans(t)]
    assert kinds("my iban DE89 3704 0044 0532 0130 00 thanks") == ["iban"]
    assert kinds("number 378282246310005") == []
    assert kinds("amex card 378282246310005") == ["short_card"]
    assert kinds("social security 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert pii.redact("write a@b.cd now", pii.find_spans("write a@b.cd now")) == "write [email] now"


def test_ibans_end_where_their_country_says():
    for text in ("DE89 3704 0044 0532 0130 00.", "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", "to DE89370400440532013000 2024", "DE12 GB82 WEST 1234 5698 7654 32 A"):
        found = [(a, b) for k, a, b, _ in pii.find_spans(text) if k == "iban"]
        assert len(found) == 1 and pii.mod97(text[slice(*found[0])].replace(" ", "")), text
    assert not [s for s in pii.find_spans("DE89 3704 0044 0532 0130 01 and XX89 3704 0044 0532 0130 00") if s[0] == "iban"]


def test_secrets_are_values_that_look_random():
    text = 'set token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and go'
    (kind, a, b, score), = [s for s in pii.find_spans(text) if s[0] == "secret"]
    assert text[a:b] == "04dbebab91ab85687d33eeaaf9ac699e1188f962" and score >= 0.6
    assert "[secret]" in pii.redact(text, pii.find_spans(text))
    for other in ("token = 1111111111111111111", "the token: nothingbutlettersinhere", "password: short1", "tokens = 04dbebab91ab85687d33eeaaf9ac699e1188f962"):
        assert not [s for s in pii.find_spans(other) if s[0] == "secret"], other


def test_long_runs_take_linear_time():
    began = time.time()
    for unit in ("a", "1", "1.", "+1", "a@", "1 ", "A1", "DE12"):
        pii.find_spans(unit * 150_000)
    assert time.time() - began < 20


def test_pii_rows(odd, empty):
    rows = pii.detect(odd, with_redacted=True).collect()
    assert len(rows) == len(ODD) and pii.detect(empty).count() == 0
    found = {tuple(s[0] for s in r.spans) for r in rows if r.doc_id is None}
    assert found == {("email", "phone")}
    assert all(not r.spans for r in rows if r.doc_id in (1, 2, 3))


# --- fingerprints and groups


def plain_fingerprint(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints):
    """Least id reachable, over all pairs."""
    n = len(prints)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d if d is not None else -1, f, least.get(find(i), -1)) for i, (d, f) in enumerate(prints))


def groups_of(df, **how):
    rows = simhash.groups(df, **how).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.fp & (1 << 64) - 1, -1 if r.component_id is None else r.component_id) for r in rows)


def test_groups_are_those_over_all_pairs(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    rng = random.Random(2)
    base = " ".join(rng.choice(["and", "the", "of", "in", "house", "tree", "blue"]) + str(rng.randrange(90)) for _ in range(300)).split()
    for k in range(60):  # many near copies of one text, close to one another in chains
        words = list(base)
        for _ in range(k % 6):
            words[rng.randrange(300)] = "changed"
        docs.append((1000 + k, " ".join(words)))
    docs += [(2000, None), (2001, ""), (2002, " \n"), (None, "one two"), (2003, "ONE Two"), (2003, "ONE Two")]
    expected = plain_components([(d, plain_fingerprint(t)) for d, t in docs])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert groups_of(df) == expected
    assert groups_of(df, chunk=3) == expected  # keys cut into chunks


def test_groups_of_odd_tables(odd, empty):
    assert simhash.groups(empty).count() == 0
    assert len(groups_of(odd)) == len(ODD)
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 5, 7]
    assert simhash.representatives(empty).count() == 0


def test_near_prints_always_share_a_key(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(1, 4)):
            b ^= 1 << bit
        pairs.append((a, b))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for p in pairs for x in p], "fp long").distinct()
    found = {frozenset((r.u, r.v)) for r in simhash.links(nodes).collect()}
    assert {frozenset(map(signed, p)) for p in pairs} <= found


# --- token files


@pytest.fixture(scope="module")
def encoder():
    return token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2)


def test_words_encode_as_the_library_does(encoder, spark, tiny):
    assert encoder.by_word
    marks = [chr(c) for c in range(1, 0x260)] + [" ", "　", "​", "日", "😀", "́"]
    texts = [f(c) for c in marks for f in (lambda c: f"a{c}b", lambda c: f" {c}{c} x", lambda c: f"1{c}  {c}'s", lambda c: f"{c}\n\n {c}'LL")]
    texts += ["<|endoftext|> in a text", "don't we'll I'd  they've", ""] + [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    for t in texts:
        own = np.frombuffer(encoder.encode(t), np.uint16).tolist()
        assert own == [*encoder.library.encode(t, add_special_tokens=False).ids, 2], repr(t)


def test_shard_answers_from_its_file():
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.integers(0, 50_000, 3000), rng.integers(0, 9, 2000)]).astype(np.uint16)
    shard = token_files.Shard(token_files.build([3, None, 9], [4000, 0, 1000], ids))
    assert shard.doc_ids == [3, None, 9] and shard.lengths.tolist() == [4000, 0, 1000]
    assert (shard.decode() == ids).all()
    for at in rng.integers(0, len(ids), 200).tolist() + [0, len(ids) - 1]:
        assert shard.access(at) == ids[at]
    for symbol in (0, 3, 8, int(ids[5]), 60_000, 70_000):
        assert shard.occurrences(symbol) == np.flatnonzero(ids == symbol).tolist()
        assert shard.count(symbol, 1000, 4500) == (ids[1000:4500] == symbol).sum()
    for bounds in ((-1, 5), (5, 4), (0, len(ids) + 1)):
        with pytest.raises(IndexError):
            shard.count(3, *bounds)
    for at in (-1, len(ids)):
        with pytest.raises(IndexError):
            shard.access(at)
    assert shard.count(-1) == 0 and shard.occurrences(-1) == []
    assert (token_files.Shard(token_files.build([], [], ids[:0])).decode() == ids[:0]).all()


@pytest.mark.parametrize("n", [1, 511, 512, 513, token_files.BLOCK - 1, token_files.BLOCK, token_files.BLOCK + 1, 5 * token_files.BLOCK + 77])
def test_shards_of_any_number_of_blocks(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_000).astype(np.uint16)
    shard = token_files.Shard(token_files.build([1], [n], ids))
    assert (shard.decode() == ids).all()
    for at in rng.integers(0, n, 30).tolist() + [0, n - 1]:
        assert shard.access(at) == ids[at]
    for symbol in {int(ids[0]), int(ids[-1]), 1}:
        places = np.flatnonzero(ids == symbol)
        assert shard.count(symbol) == len(places) and (len(places) > 2000 or shard.occurrences(symbol) == places.tolist())


def test_an_access_reads_a_block_a_plane():
    class Slices:  # a file that counts what is read of it
        def __init__(self, data):
            self.data, self.read = data, 0

        def __getitem__(self, part):
            self.read += part.stop - (part.start or 0)
            return self.data[part]

    rng = np.random.default_rng(8)
    ids = rng.integers(0, 50_000, 1 << 19).astype(np.uint16)
    file = Slices(token_files.build([1, 2], [1 << 18, 1 << 18], ids))
    shard = token_files.Shard(file)
    opened = file.read
    assert opened < len(file.data) / 100
    assert shard.access(300_000) == ids[300_000]
    assert shard.blocks_read <= 2 * shard.planes and file.read - opened <= len(file.data) / 10
    held = sum(len(raw) for _, raw in shard._held.values())
    assert held <= shard.planes * (token_files.BLOCK // 8 + 128)


def test_shards_as_files(spark, odd, tmp_path):
    shards = token_files.write_shards(odd, public_tokenizers.path("byte_bpe_50k.json"), shard_tokens=64)
    path = f"file://{tmp_path}/shards"
    token_files.save(shards, path)
    files = {p.name: p.read_bytes() for p in (tmp_path / "shards").iterdir()}
    assert files == {f"{r.part:08d}-{r.shard:08d}.wm": bytes(r.payload) for r in shards.collect()}
    assert sum(token_files.Shard(x).n_docs for x in files.values()) == odd.count()


def test_ids_are_dealt_in_ranges(spark):
    rng = random.Random(9)
    for ids in ([], [5], [None, 5, 5, 5], [rng.randrange(-50, 10_000) for _ in range(3000)] + [None] * 3 + [7] * 500):
        rows = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        for parts in (1, 4, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = token_files._dealt_by_id(rows).sortWithinPartitions("doc_id").rdd.glom().collect()
            flat = [r.doc_id for p in got for r in p]
            assert flat == sorted(ids, key=lambda x: (x is not None, x or 0))
            assert len(got) <= parts and (len(ids) < 100 or max(map(len, got)) <= 700 + 3 * len(ids) // parts)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_token_files_round_trip(spark, odd, empty, encoder):
    file = public_tokenizers.path("byte_bpe_50k.json")
    shards = token_files.write_shards(odd, file, shard_tokens=64)
    rows = token_files.read_back(shards).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids == [None, 1, 2, 3, 5, 5, 6, 7]
    start = 0
    texts = {i: t for i, t, *_ in ODD}
    for r in rows:
        own = [*encoder.library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert token_files.read_back(token_files.write_shards(empty, file)).count() == 0


# --- token counts


@pytest.fixture(scope="module")
def pieces():
    return token_counts.PrefixCounter(public_tokenizers.path("piece_bpe_32k.model"))


def test_counts_of_all_prefixes(pieces, spark, tiny):
    texts = ["a  b", " a", "a ", "\n\na\tb", "", " ", "   ", "<s>hi</s> <unk>", "ａé①x y", "▁x a▁▁b ▁", "日本 語 é́ 😀", "x_{1} .com (a). 3.14", "Thething.thE"]
    texts += [r.text[:120] for r in spark.read.parquet(f"{tiny}/documents.parquet").limit(40).collect()]
    for t in texts:
        assert pieces.prefix_counts(t).tolist() == [len(pieces.sp.encode(t[:i])) for i in range(len(t) + 1)], repr(t)
        assert pieces.count_and_fit(t, 7)[0] == len(pieces.sp.encode(t))
        if t:
            fits = pieces.truncate(t, 7)
            assert pieces.count_and_fit(t, 7)[1] == len(fits) and len(pieces.sp.encode(fits)) <= 7


def test_steps_reach_the_library_count(pieces, spark, tiny):
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    parts = {p for t in texts for p in pieces.parts(t)}
    assert all(pieces._steps(p)[-1] == pieces._library([p])[0] for p in parts)
    assert [pieces.count_and_fit(t, 4096)[0] for t in texts] == [len(x) for x in pieces.sp.encode(texts)]


def test_counts_come_from_the_tables(pieces, spark, tiny, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").limit(20).collect()]
    own = token_counts.PrefixCounter(public_tokenizers.path("piece_bpe_32k.model"))
    right = own._steps
    with monkeypatch.context() as m:  # nothing is encoded by the library while counting
        m.setattr(own, "_library", lambda parts: pytest.fail("the library was asked"))
        assert [own.count_and_fit(t, 50)[0] for t in texts] == [len(x) for x in pieces.sp.encode(texts)]
    own.tables = token_counts._Tables(own._made)
    monkeypatch.setattr(own, "_steps", lambda part: [c + 1 for c in right(part)])
    assert all(own.count_and_fit(t, 1 << 40)[0] != len(x) for t, x in zip(texts, pieces.sp.encode(texts)) if t)
    own.tables = token_counts._Tables(own._made)
    monkeypatch.setattr(own, "_steps", lambda part: None)  # without a table the library counts, and this is told
    found = [own.count_and_fit(t, 50) for t in texts]
    assert [x[0] for x in found] == [len(x) for x in pieces.sp.encode(texts)] and all(x[2] == len(own.parts(t)) for x, t in zip(found, texts))


def test_tables_not_met_for_longest_go_first(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 8)
    made = []
    tables = token_counts._Tables(lambda p: made.append(p) or p)
    for p in [*"abcd", "a", *"efg", "a", *"hijk", "a"]:
        assert tables[p] == p and len(tables) <= 4 and len(tables.older) <= 4
    assert made.count("a") == 1 and len(made) == 11


def test_token_count_rows(odd, empty):
    file = public_tokenizers.path("piece_bpe_32k.model")
    rows = token_counts.count_tokens(odd, file).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert {r.over_limit for r in rows if r.doc_id == 7} == {True}
    assert token_counts.count_tokens(empty, file).count() == 0


# --- line dedup


def plain_dedup(docs, min_chars=20, min_docs=3):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x).strip("\x20\x09\x0a\x0b\x0c\x0d")
    held = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(d)
    gone = {k: max(x for x in v if x is not None) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == d]
        out.append((-1 if d is None else d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bits", [1 << 8, 1 << 24])
def test_lines_dropped_are_those_of_the_plain_count(spark, tiny, bits):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    common = "  The Same Line again, everywhere é "
    docs += [(5000 + i, f"own {i} text which is here only\n{common}\n{common.upper().replace('É', 'é')}\n") for i in range(20)]
    docs += [(6000, None), (6001, ""), (None, common), (6002, "short\nshort"), (6003, "ééééééééééééééééééé"), (6004, "éééééééééééééééééééé"), (6005, "éééééééééééééééééééé"), (6006, "éééééééééééééééééééé"), (5003, "other text under an id that is there already\n" + common)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = line_dedup.dedup_lines(df, filter_bits=bits).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in rows)
    assert got == plain_dedup(docs)


def test_line_dedup_rows(odd, empty):
    assert line_dedup.dedup_lines(odd).count() == len(ODD)
    assert line_dedup.dedup_lines(empty).count() == 0


# --- media


def test_containers_hold_their_payload():
    for raw in (b"", b"a", b"x" * 575, b"x" * 576, bytes(range(256)) * 9):
        file = media.pack(raw)
        info = media.inspect(file)
        payload = media.unpack(file)
        assert payload == raw + b"\xff" * (len(payload) - len(raw)) and len(payload) % 576 == 0 and payload
        assert info["codec"] == "raw" and info["n_bytes"] == len(raw) and info["samples"] == len(payload) // 576 == info["ticks"]
        (offset, length, frames), = info["key_ranges"]
        assert file[offset:offset + length] == payload and frames == info["samples"]
        for cut in (3, len(file) // 3, len(file) - 1):
            with pytest.raises(ValueError):
                media.inspect(file[:cut])


def test_key_frames_and_chunks_by_table():
    import struct

    full = lambda kind, *p: media._full(kind, 0, *p)
    stbl = media._box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), media._box(b"avc1", bytes(78))),
        full(b"stts", struct.pack(">5I", 2, 3, 10, 2, 5)),
        full(b"stss", struct.pack(">3I", 2, 1, 4)),
        full(b"stsc", struct.pack(">7I", 2, 1, 2, 1, 2, 1, 1)),
        full(b"stsz", struct.pack(">7I", 0, 5, 10, 20, 30, 40, 50)),
        full(b"stco", struct.pack(">5I", 4, 1000, 2000, 3000, 4000)),
    )
    mdhd = full(b"mdhd", struct.pack(">4I2H", 0, 0, 30, 40, 0, 0))
    file = media._box(b"moov", media._box(b"trak", media._box(b"mdia", mdhd, media._box(b"minf", stbl))))
    info = media.inspect(file)
    assert info["codec"] == "avc1" and info["ticks"] == 40 and info["timescale"] == 30
    assert info["all_ranges"][0].tolist() == [1000, 1010, 2000, 3000, 4000]
    assert info["key_ranges"] == [(1000, 10, 1), (3000, 40, 1)]


def test_damaged_containers_are_error_rows(spark):
    file = media.pack(b"some payload")
    head = len(file) - media.FRAME
    for at in range(head):
        for value in (0, 1, 127, 255, file[at] ^ 1):
            try:
                media.unpack(file[:at] + bytes([value]) + file[at + 1:])
            except ValueError:
                pass  # and nothing else
    for cut in range(0, len(file), 7):
        with pytest.raises(ValueError):
            media.inspect(file[:cut])
    deep = b""
    for _ in range(3000):
        deep = media._box(b"moov", deep)
    with pytest.raises(ValueError):
        media.inspect(deep)
    rows = {r.doc_id: r for r in media.features(spark.createDataFrame([(1, file), (2, file[:-1]), (3, b"text"), (4, None)], "doc_id long, media binary")).collect()}
    assert rows[1].error is None and rows[1].payload is not None
    assert all(rows[k].error and rows[k].feature is None for k in (2, 3, 4))


def test_media_rows(odd, empty):
    rows = media.features(media.store(odd)).collect()
    assert len(rows) == len(ODD)
    texts = {i: (t or "").encode() for i, t, *_ in ODD}
    for r in rows:
        assert bytes(r.payload)[:r.n_bytes] == texts[r.doc_id] and r.tail_crc32 == zlib.crc32(bytes(r.payload)[-32:])
    assert len({bytes(r.media) for r in rows if r.doc_id in (5, 6)}) == 1
    assert media.features(media.store(empty)).count() == 0
