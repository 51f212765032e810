"""Operators on whole tables, held against brute force or simulations."""

import gzip
import hashlib
import math
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import decontamination, mixing, quality, queries, warc

SCHEMA = "doc_id long, text string, source string, slot string"


def simulated(shares, blocks):
    """Earliest deadline first over released blocks, slot by slot, with exact fractions; a source that ends begins an epoch."""
    active, done, base, start, epoch, out = sorted(shares), dict.fromkeys(shares, 0), dict.fromkeys(shares, 0), 0, 0, []
    while active:
        total, t = sum(shares[s] for s in active), len(out)
        ready = []
        for s in active:
            w, k = Fraction(shares[s], total), done[s] - base[s]
            if math.floor(k / w) <= t - start:
                ready.append((math.ceil((k + 1) / w), s, math.floor(k / w)))
        due, s, free = min(ready)
        out.append((s, done[s], start + free, start + due, t, epoch))
        done[s] += 1
        if done[s] == blocks[s]:
            active.remove(s)
            base, start, epoch = dict(done), t + 1, epoch + 1
    return out


# --- mixing


@pytest.mark.parametrize(
    "weights, blocks",
    [
        ({"a": 1.0, "b": 1.0}, {"a": 30, "b": 40}),
        ({"a": 0.5, **{f"s{i}": 0.005 for i in range(100)}}, {"a": 400, **{f"s{i}": 3 for i in range(100)}}),  # half, not 451 of 1000
        ({"a": 7.0, "b": 2.0, "c": 1.3, "d": 0.0007}, {"a": 900, "b": 50, "c": 333, "d": 1}),
    ],
)
def test_schedule_stays_within_a_block_of_the_target(spark, weights, blocks):
    table = spark.createDataFrame([(k, w, blocks[k]) for k, w in weights.items()], "skey string, w double, blocks long")
    dealt = mixing.shares(table)
    shares = {r.skey: r.u for r in dealt.collect()}
    rows = sorted((r.skey, r.block, r.release, r.deadline, r.slot, r.epoch) for r in mixing.schedule(dealt).collect())
    plain = simulated(shares, blocks)
    assert rows == sorted(plain)
    assert all(free <= t < due for _, _, free, due, t, _ in plain) and [x[4] for x in plain] == list(range(sum(blocks.values())))
    total = Fraction(0) + sum(Fraction(w) for w in weights.values())
    given = dict.fromkeys(weights, 0)
    for s, _, _, _, t, epoch in plain:
        given[s] += 1
        if epoch == 0:  # the weights asked for, not rounded ones
            assert all(abs(given[x] - (t + 1) * Fraction(w) / total) < 1 for x, w in weights.items())


def test_a_small_weight_is_kept_and_sources_may_be_many(spark):
    weights = {"large": 1.0, "small": 0.0001}
    table = spark.createDataFrame([(k, w, 6000) for k, w in weights.items()], "skey string, w double, blocks long")
    early = mixing.schedule(mixing.shares(table)).filter("skey = 'small' and epoch = 0").count()
    assert early <= 1  # of 6001 slots, not one of every thousand
    many = spark.createDataFrame([(f"s{i}", 1.0 + i % 3, 1) for i in range(1500)], "skey string, w double, blocks long")
    rows = mixing.schedule(mixing.shares(many)).collect()
    assert sorted(r.slot for r in rows) == list(range(1500)) and len({r.skey for r in rows}) == 1500


def test_mix_of_rows(spark):
    rng = random.Random(5)
    rows = [(i, "x" * rng.randrange(0, 60), rng.choice(["a", "a", "b", "c", None]), "kept" if i % 2 else None) for i in range(800)]
    rows += [(None, "lost id", "a", "kept"), (None, "another", "a", None), (3, "again", "b", "kept"), (3, "again", "b", "kept"), (900, None, "c", "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.1, None: 0.1}
    out = mixing.mixed(df, weights, block_bytes=256, buckets=8).collect()
    assert sorted((str(r.doc_id), str(r.text), str(r.source), str(r.other)) for r in out) == sorted(tuple(map(str, r)) for r in rows)
    slots = {}
    for r in out:
        assert r.release <= r.slot < r.deadline and r.on_target == (r.epoch == 0)
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    ends = sorted({r.slot: r.epoch for r in out}.items())
    assert [e for _, e in ends] == sorted(e for _, e in ends)
    # while all take part, blocks are within one of the target
    last = max(t for t, e in ends if e == 0)
    for s, w in weights.items():
        got = 1 + max(r.block for r in out if r.source == s and r.epoch == 0)
        assert abs(got - w * (last + 1)) < 1
    # within a source the bytes are numbered without gaps or overlaps
    for s in weights:
        at = 0
        for r in sorted((r for r in out if r.source == s), key=lambda r: (r.at_byte, len((r.text or "").encode()))):
            assert r.at_byte == at and r.block == at // 256
            at += len((r.text or "").encode())
    # larger blocks where the mix would have too many
    fewer = mixing.mixed(df, weights, block_bytes=256, max_blocks=20, buckets=8).collect()
    size = sum(len((r[1] or "").encode()) for r in rows)
    unit = next(1 << k for k in range(40) if (1 << k) * 20 >= size)
    assert unit > 256 and all(r.block == r.at_byte // unit for r in fewer)
    assert mixing.mixed(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="no weight"):
        mixing.mixed(df, {"a": 1.0}).collect()
    clash = df.withColumn("slot", F.lit("mine"))
    assert mixing.mixed(clash, prefix="p_").select("slot").distinct().first()[0] == "mine"


def test_mixing_runs_no_python_on_executors(spark, tiny):
    plan = queries.op1_mixing(spark, tiny)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- decontamination


def plain_matches(docs, items, width=5, threshold=0.8):
    """All windows of all documents against all items."""
    out = {}
    for d, text in docs:
        words = decontamination.words_of(text or "")
        for i, item in items:
            own = decontamination.words_of(item or "")
            if not own or not words:
                continue
            k = min(width, len(own))
            size = min(len(own), len(words))
            mine = decontamination.shingles_of(own, k)
            best = max(decontamination.weighted_similarity(decontamination.shingles_of(words[s:s + size], k), mine) for s in range(len(words) - size + 1))
            if best >= threshold:
                out[d, i] = round(best, 9)
    return out


def test_matches_are_those_of_all_windows(spark, tiny):
    rng = random.Random(6)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").limit(12).collect()]
    items += [(500, "two words"), (501, ""), (502, None), (503, "again and again and again and again and again and again and")]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").limit(25).collect()]
    filler = "lorem ipsum dolor sit amet consectetur".split()
    for k in range(120):
        item = rng.choice(items)[1] or ""
        words = item.split()
        for _ in range(rng.randrange(4)):
            if words:
                at = rng.choice([rng.randrange(len(words)), 0, len(words) - 1])
                rng.choice([lambda: words.pop(at), lambda: words.insert(at, "extra"), lambda: words.__setitem__(at, "changed")])()
        lead = [rng.choice(filler) for _ in range(rng.randrange(30))]
        docs.append((10_000 + k, " ".join(lead + words + [rng.choice(filler) for _ in range(rng.randrange(30))]).upper() if k % 5 == 0 else " ".join(lead + words + lead[::-1])))
    docs += [(20_000, None), (20_001, ""), (20_002, "and two, WORDS here"), (20_003, "...")]
    expected = plain_matches(docs, items)
    assert len(expected) > 40
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found.collect()} == expected
    sliced = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_bytes=900)
    assert {(r.doc_id, r.item_id) for r in sliced.collect()} == set(expected)
    left = decontamination.without_contaminated(spark.createDataFrame([(d, t, "s", "x") for d, t in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in expected}
    assert left.columns == ["doc_id", "text", "source", "slot"]


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, items).count() == 0
    assert decontamination.without_contaminated(docs, items).count() == 1
    some = spark.createDataFrame([(1, "some text here")], "item_id long, text string")
    assert decontamination.contaminated(docs.limit(0), some).count() == 0
    twice = docs.unionAll(docs)
    assert decontamination.contaminated(twice, some).count() == 2


def test_index_returns_all_within_the_radius():
    rng = np.random.default_rng(7)
    prints = rng.integers(0, 1 << 63, 200, np.uint64)
    asked = prints[rng.integers(0, 200, 400)].copy()
    for i in range(400):
        for bit in rng.choice(64, int(rng.integers(0, 30)), replace=False):
            asked[i] ^= np.uint64(1) << np.uint64(bit)
    q, k = decontamination.HammingIndex(prints, 23).query(asked)
    near = np.argwhere(np.bitwise_count(asked[:, None] ^ prints[None, :]) <= 23)
    assert sorted(zip(q.tolist(), k.tolist())) == sorted(map(tuple, near.tolist()))


# --- quality


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op8_quality(spark, folder).join(queries.table(spark, folder, "labels"), "doc_id").filter("held_out").collect()
    assert len(rows) > 80 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.97
    assert sum(r.predicted for r in rows if r.quality == 1) / sum(r.quality for r in rows) >= 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_scores_of_odd_tables(spark, tiny):
    docs = spark.createDataFrame([(1, None, "a", "x"), (2, "", "a", "x"), (None, "text", None, None), (3, "w " * 30_000, "b", "x"), (3, "w " * 30_000, "b", "x")], SCHEMA)
    labels = spark.createDataFrame([(1, 1, None), (3, 0, 1), (None, 1, 0), (77, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.filter("quality = 1")):
        model = quality.fit(docs, known)
        rows = quality.scored(docs, model, score="slot").collect()
        assert len(rows) == 5 and all(0 <= r.slot <= 1 for r in rows)
    assert quality.scored(docs.limit(0), model).count() == 0
    model = quality.fit(spark.read.parquet(f"{tiny}/documents.parquet"), spark.read.parquet(f"{tiny}/labels.parquet"))
    assert quality.scored(docs, model).filter("score is null").count() == 0
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.exceptAll(quality.scored(docs, model, score="s").filter("s >= 0.5").select(docs.columns)).count() == 0
    assert "regexp_replace" not in [x for x in kept._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x][0]


def test_compiled_rules_give_the_fitted_scores(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    model = quality.fit_rules(x, y, ["a", "b", "c"])
    assert 0 < len(model.rules) < 200
    rows = spark.createDataFrame(x.tolist(), "a double, b double, c double").select(model.score()).collect()
    raw = model.bias + quality.holds(x, [p for p, _ in model.rules]) @ np.array([w for _, w in model.rules])
    assert np.allclose([r[0] for r in rows], 1 / (1 + np.exp(-raw)))
    assert ((raw > 0) == y).mean() > 0.97


def test_what_is_learnt_does_not_depend_on_the_order_of_rows(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    doubled = docs.unionAll(docs.select("doc_id", F.reverse("text").alias("text")))
    first = quality.fit(doubled, labels, sample=60)
    assert quality.fit(doubled.orderBy(F.desc("doc_id"), "text").repartition(7), labels.orderBy(F.rand(1)), sample=60) == first
    clash = docs.withColumn("_stat_row", F.lit(3)).withColumn("_stat_words", F.lit("mine"))
    kept = quality.accepted(clash, first, 0.0)
    assert kept.columns == clash.columns and kept.select("_stat_words").distinct().first()[0] == "mine" and kept.count() == docs.count()


# --- WARC


PAGES = [
    (1, "http://a/", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (3, "http://b/\r\nInjected: 1", "small"), (4, "u", "small"),
    (5, "u", None), (6, "u", ""), (None, "u", "<p>" + "x" * 200), (7, "u", "WARC/1.1\r\n\r\n" * 40), (7, "u", "WARC/1.1\r\n\r\n" * 40), (8, "u", "é" * 50), (9, "u", "é" * 50), (10, "u", "é" * 49), (11, "u", "é" * 49),
]


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_pages_survive_the_archives(spark, broadcast_rows):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("gz", F.lit(b"z"))
    monolithic = warc.archive(df, roll=700, broadcast_rows=broadcast_rows)
    normal = warc.normalise(monolithic)
    rows = warc.read(normal).collect()
    assert len(rows) == len(PAGES)
    payloads = {i: (h or "").encode() for i, _, h in PAGES}
    least = {}
    for i, p in payloads.items():
        if i is not None and len(p) >= 100:
            least[p] = min(least.get(p, i), i)
    for r in rows:
        p = payloads[r.page_id]
        first = least.get(p, r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(p), hashlib.sha256(p).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
    whole = sorted(b"".join(gzip.decompress(bytes(r.gz)) for r in monolithic.collect()))
    assert whole == sorted(b"".join(gzip.decompress(bytes(r.gz)) for r in normal.collect()))
    for r in normal.collect():
        for o, n in zip(r.offsets, r.lengths):
            raw = gzip.decompress(bytes(r.gz)[o:o + n])
            assert warc.parse(raw)[2] == len(raw)
    assert warc.read(warc.normalise(warc.archive(df.limit(0)))).count() == 0


def test_normaliser_takes_any_members():
    raw = [warc.record(i, "u", bytes([65 + i]) * 5000 * i, "d", None) for i in range(6)]
    many = gzip.compress(raw[0] + raw[1][:20]) + gzip.compress(raw[1][20:] + raw[2]) + b"".join(map(gzip.compress, raw[3:]))
    out, index = warc.normalise_archive(many)
    assert [gzip.decompress(out[o:o + n]) for o, n in index] == raw
    with pytest.raises(ValueError):
        warc.normalise_archive(gzip.compress(raw[0][:-3]))


def test_damaged_archives_are_error_rows(spark):
    raw = warc.record(1, "u", b"x" * 300, hashlib.sha256(b"x" * 300).hexdigest(), None)
    gz = gzip.compress(raw)
    for bad in (gz[:-1], gz[:-8], gz[:-9], gz[:40], gz[:-6] + b"\0" * 6, gz + b"more", b"text", gzip.compress(raw.replace(b"Content-Length: ", b"Content-Length: x"))):
        with pytest.raises(ValueError):
            warc.normalise_archive(bad)
    rows = warc.normalise(spark.createDataFrame([(gz,), (gz[:-1],), (None,)], "gz binary"))
    found = sorted((r.error or "", len(r.lengths or [])) for r in rows.collect())
    assert found[:2] == [("", 0), ("", 1)]
    assert any("cut off" in e for e, _ in found)
    with pytest.raises(Exception, match="cut off"):
        warc.read(rows).collect()
    assert warc.read(rows.filter("error is null")).count() == 1


def test_archives_as_files(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    normal = warc.normalise(warc.archive(df, roll=700))
    path = f"file://{tmp_path}/archives"
    warc.save(normal, path)
    names = sorted(p.name for p in (tmp_path / "archives").iterdir())
    assert len(names) == 2 * normal.count() and all(n.endswith((".warc.gz", ".idx")) for n in names)
    plain = b"".join(gzip.open(p).read() for p in (tmp_path / "archives").glob("*.warc.gz"))
    assert plain.count(b"WARC-Payload-Digest") == len(PAGES)
    rows = lambda x: sorted(map(str, warc.read(x).collect()))
    assert rows(warc.load_indexed(spark, path)) == rows(normal) == rows(warc.normalise(warc.load(spark, path)))


# --- SQL, pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    got = queries.QUERIES[name](spark, tiny)
    columns = sorted(got.columns)
    expected = con.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(rows, key=key) == sorted(expected, key=key)


def test_pipeline_stages(spark, tiny, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tiny)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] == seen[4] == seen[5]
    assert [r.doc_id for r in spark.read.parquet(f"{tmp_path}/3").collect()] == [r.doc_id for r in docs.orderBy("start").collect()]
    assert corpus_pipeline.run(spark, tiny).count() == seen[-1]


def test_pipeline_of_odd_rows(spark, tmp_path):
    import os

    import corpus_pipeline

    for t in ("labels", "benchmark"):
        os.symlink(f"/root/testdata/sf0.001/{t}.parquet", f"{tmp_path}/{t}.parquet")
    rows = [(1, None, "en", None, 1, "a"), (2, "", None, "s", None, None), (None, "A text of some words that stands here alone.", "en", "s", 5, "b"), (4, "Another text, of other words, in the middle of it.", "en", "t", 5, "c"), (4, "Another text, of other words, in the middle of it.", "en", "t", 5, "c")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, slot string"
    for name, table in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(table, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot"]
    assert docs.count() == 0
