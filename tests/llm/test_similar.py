"""Near duplicates by exact similarity, held against all pairs."""

import random

import numpy as np
import pytest

from rasterloom.llm import similar

SCHEMA = "doc_id long, text string, lang string, node string"


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def expected(rows, similarity=0.8):
    """Least ids of the groups over all pairs; texts without words are copies of each other."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= similarity * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, *_) in enumerate(rows):
        groups.setdefault(find(i), []).append((d is None, d))
    return sorted(str(min(g, key=lambda x: (x[0], x[1] or 0))[1]) for g in groups.values())


def made(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.mark.parametrize("chunk", [1024, 5])
def test_one_row_of_each_group_stays(spark, chunk):
    rng = random.Random(1)
    rows = []
    for g in range(12):
        base = made(rng, rng.choice([3, 8, 40, 150, 600]))
        for k in range(8):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 60) if k else 0):
                words[rng.randrange(len(words))] = "changed"
            rows.append((100 * g + k, " ".join(words).upper() if k == 5 else " ".join(words), "x", None))
    large = made(rng, 300)  # a group larger than a chunk: near copies of one text, and some a little farther
    for k in range(60):
        words = list(large)
        for _ in range(k % 8):
            words[rng.randrange(300)] = "other"
        rows.append((3000 + k, " ".join(words), "x", "z"))
    shared = " ".join(made(rng, 55))  # a passage that unlike texts share
    rows += [(5000 + k, " ".join(made(rng, 200)) + " " + shared, "x", "y") for k in range(20)]
    rows += [(7000, None, None, "a"), (7001, "", "x", "b"), (7002, " \n ", "x", "c"), (None, "no id here but some words", "x", "d"), (7004, "once more and again and more", "x", "e"), (7004, "once more and again and more", "x", "e")]
    rng.shuffle(rows)
    kept = similar.representatives(spark.createDataFrame(rows, SCHEMA), chunk=chunk)
    assert kept.columns == ["doc_id", "text", "lang", "node"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == expected(rows)


def test_empty_and_single_tables(spark):
    assert similar.representatives(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, "long " * 30_000, "x", "y")] * 3, SCHEMA)
    assert similar.representatives(one).count() == 1


def test_forest_is_least_and_spans():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 63, (40, similar.WORDS), np.uint64)
    edges = similar.least_forest(prints, 256)
    assert len(edges) == 39
    distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    # Kruskal's total over all pairs
    root, total = list(range(40)), 0
    find = lambda i: i if root[i] == i else find(root[i])
    for d, i, j in sorted((int(distance[i, j]), i, j) for i in range(40) for j in range(i)):
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += d
    assert sum(int(distance[a, b]) for a, b in edges) == total
    assert similar.least_forest(prints, 0) == []
    halves = np.arange(40) % 2
    (a, b), = similar.least_forest(prints, 256, halves)
    assert distance[a, b] == distance[halves[:, None] != halves[None]].min()


def test_block_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(400):
        common, own = rng.integers(0, 1 << 63, 160, np.uint64), rng.integers(0, 1 << 63, 40, np.uint64)
        a, b = np.unique(np.concatenate([common, own[:20]])), np.unique(np.concatenate([common, own[20:]]))
        x, y = similar.block_prints(a, 12, 4), similar.block_prints(b, 12, 4)
        found += any(p is not None and p == q for p, q in zip(x, y))
    assert found >= 392  # of pairs of similarity 0.8


@pytest.mark.parametrize("chunk", [1024, 60])
def test_pairs_among_many_texts_just_below_the_threshold(spark, chunk):
    base = [f"b{i}" for i in range(499)]
    rows = []
    for k in range(260):  # a template, of which each text fills in 60 words in a row of its own
        text = list(base)
        text[200:260] = [f"t{k}x{i}" for i in range(60)]
        rows.append((k, " ".join(text), "x", None))
    for k in range(0, 260, 13):  # a few have a copy that fills in fifteen of the words alike
        text = rows[k][1].split()
        text[215:260] = [f"u{k}x{i}" for i in range(45)]
        rows.append((1000 + k, " ".join(text), "x", None))
    sets = [shingles(t) for _, t, *_ in rows]
    near = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert near == 20 and len(sets[0] & sets[1]) / len(sets[0] | sets[1]) > 0.77
    kept = similar.representatives(spark.createDataFrame(rows, SCHEMA), chunk=chunk)
    assert sorted(str(r.doc_id) for r in kept.collect()) == expected(rows)


@pytest.mark.parametrize("chunk", [1024, 1])
def test_short_texts_are_not_cut_by_distance(spark, chunk):
    rows = []
    for k in range(4000):  # four of five shingles shared: some of these pairs lie over FAR bits apart
        words = [f"s{k}x{i}" for i in range(9)]
        a, b = (similar.shingle_set([w.encode() for w in x], 5) for x in (words[:8], words))
        if np.bitwise_count(similar.whole_print(a) ^ similar.whole_print(b)).sum() > similar.FAR:
            rows += [(2 * k, " ".join(words[:8]), "x", None), (2 * k + 1, " ".join(words), "x", None)]
    assert len(rows) > 40
    kept = similar.representatives(spark.createDataFrame(rows, SCHEMA), chunk=chunk)
    share = [any(p is not None and p == q for p, q in zip(*(similar.block_prints(similar.shingle_set(t.encode().split(), 5), 12, 4) for t in (x[1], y[1])))) for x, y in zip(rows[::2], rows[1::2])]
    assert kept.count() == len(rows) - sum(share) and sum(share) > 20


@pytest.mark.parametrize("share, chunk", [(0.92, 64), (0.93, 1024)])
def test_families_that_straddle_the_threshold(spark, share, chunk):
    """300 texts of some 200 words that keep each stretch of a common text with this probability."""
    rng = random.Random(7)
    rows = []
    for k in range(300):
        words = [f"{'b' if rng.random() < share else k}w{i}n{j}" for i in range(40) for j in range(5)]
        rows.append((k, " ".join(words), "x", None))
    sets = [shingles(t) for _, t, *_ in rows]
    near = [(i, j) for i in range(300) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    # recall of the proposals: pairs that share a block and lie within the radius
    prints = [[similar.block_prints(h, 12, 4), similar.whole_print(h)] for h in (similar.shingle_set([w.encode() for w in t.split()], 5) for _, t, *_ in rows)]
    met = sum(any(p is not None and p == q for p, q in zip(prints[i][0], prints[j][0])) and np.bitwise_count(prints[i][1] ^ prints[j][1]).sum() <= similar.FAR for i, j in near)
    assert len(near) > 500 and met >= 0.99 * len(near)
    want = expected(rows)
    assert 2 < len(want) < 280
    kept = similar.representatives(spark.createDataFrame(rows, SCHEMA), chunk=chunk)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_columns_of_any_name_and_type_are_kept(spark):
    rows = [(1, "a b c d e f g", 5, {"k": 1}, 0.5), (2, "a b c d e f g", 6, {"k": 2}, 0.5), (3, "h i j k l m n", 7, {}, None), (3, "h i j k l m n", 7, {}, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row_a int, `shingles.x` map<string,int>, ra double")
    kept = similar.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r._row_a) for r in kept.collect()) == [(1, 5), (3, 7)]


def test_narrow_tables_go_into_few_files(spark, monkeypatch):
    """Scratch tables have files by their rows, not by the shuffle's partitions; the rows that stay are the same."""
    from rasterloom.llm import _base, _components

    files = {}

    def counted(df, what, *more, **options):
        table = _base.written(df, what, *more, **options)
        files[what] = max(files.get(what, 0), len(table.inputFiles()))
        return table

    monkeypatch.setattr(similar, "written", counted)
    monkeypatch.setattr(_components, "written", counted)
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    rng = random.Random(4)
    base = made(rng, 120)
    rows = [(k, " ".join([*base[:119 - k % 3], f"own{k}"]) if k < 90 else " ".join(made(rng, 30)), "x", None) for k in range(140)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        kept = similar.representatives(spark.createDataFrame(rows, SCHEMA), chunk=8)
        assert sorted(str(r.doc_id) for r in kept.collect()) == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {"nodes", "shared", "pivots", "pivot-links", "candidates", "edges", "ends", "marked"} <= set(files)
    assert all(n <= spark.sparkContext.defaultParallelism for what, n in files.items() if what not in ("sketches", "shingles"))


@pytest.mark.parametrize("share, chunk", [(0.92, 64), (0.93, 1024)])
def test_families_that_keep_stretches_whole(spark, share, chunk):
    """As the families above, but a stretch of five words is kept or changed as one, so that many pairs do lie over 0.8."""
    rng = random.Random(7)
    rows = []
    for k in range(300):
        kept = ["b" if rng.random() < share else k for _ in range(40)]
        rows.append((k, " ".join(f"{own}w{i}n{j}" for i, own in enumerate(kept) for j in range(5)), "x", None))
    sets = [shingles(t) for _, t, *_ in rows]
    near = sum(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 for i in range(300) for j in range(i))
    want = expected(rows)
    assert near > 500 and 2 < len(want) < 280
    kept = similar.representatives(spark.createDataFrame(rows, SCHEMA), chunk=chunk)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
