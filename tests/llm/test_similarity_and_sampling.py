"""Shingle similarity, hard negatives and resampling against plain Python, on edge cases and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tillwise.llm import jaccard, resample, rtree

# -- shingle similarity --------------------------------------------------------


def plain_similar(rows, width=3, percent=90):
    """(n, component, links) of each (id, text), by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[root(i)] = min(own, least.get(root(i), own))
    return sorted(((own, len(s), least.get(root(i)), n) for i, ((own, _), s, n) in enumerate(zip(rows, sets, links))), key=str)


def similar(df, **more):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.similar(df, **more).collect()), key=str)


def near_copies(seed=3):
    """Texts with few words, so that prefixes are shared, and copies with some words replaced."""
    r = random.Random(seed)
    out = []
    for _ in range(30):
        base = [f"w{r.randrange(40)}" for _ in range(r.randrange(3, 60))]
        out.append(base)
        for _ in range(r.randrange(5)):
            copy = list(base)
            for _ in range(r.randrange(3)):
                copy[r.randrange(len(copy))] = f"w{r.randrange(45)}"
            out.append(copy[r.randrange(2) :])
    return [(i, " ".join(t)) for i, t in enumerate(out)]


@pytest.mark.parametrize("width,percent", [(3, 90), (2, 70)])
def test_links_equal_all_pairs(spark, monkeypatch, width, percent):
    # Homes of a few members each, shared shingles in several parts.
    monkeypatch.setattr(jaccard, "HOME_BYTES", 4096)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rows = near_copies(width)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = similar(df, width=width, percent=percent)
    assert got == plain_similar(rows, width, percent)
    assert any(n for *_, n in got)


def test_links_at_the_threshold(spark):
    a = [f"a{i}" for i in range(21)]  # 19 shingles
    rows = [(5, " ".join(a)), (4, " ".join([*a[:20], "x"])), (3, " ".join([*a, "y"])), (2, " ".join([*a[:19], "x", "y"])), (9, "a b"), (8, "A\tB")]
    assert similar(spark.createDataFrame(rows, "doc_id long, text string")) == plain_similar(rows)


def test_a_hot_group_is_cut_into_homes(spark, monkeypatch):
    """Sets that share prefix and size: one group, several homes, every link found once."""
    monkeypatch.setattr(jaccard, "HOME_BYTES", 4096)
    monkeypatch.setattr(jaccard, "classes", lambda counts: np.zeros(len(counts), dtype=np.uint8))
    r = random.Random(1)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join([*base[: (k := r.randrange(300))], f"x{i}", *base[k:]])) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(30)]
    assert similar(spark.createDataFrame(rows, "doc_id long, text string")) == plain_similar(rows)


def test_long_sets_are_told_apart_by_their_whole_profiles(spark, monkeypatch):
    """Long texts that all share a passage: one large candidate component before the whole profiles are read."""
    monkeypatch.setattr(jaccard, "HOME_BYTES", 40_000)
    monkeypatch.setattr(jaccard, "classes", lambda counts: np.zeros(len(counts), dtype=np.uint8))
    r = random.Random(2)
    passage = [f"p{i}" for i in range(300)]
    bases = [[f"w{r.randrange(10**6)}" for _ in range(r.choice([1200, 1300, 2500, 9000]))] for _ in range(10)]
    rows = []
    for base in bases:
        for _ in range(3):
            copy = list(base)
            for _ in range(r.choice([0, 5, 40, 300])):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy + passage)))
    assert similar(spark.createDataFrame(rows, "doc_id long, text string")) == plain_similar(rows)
    h = np.random.default_rng(1).integers(2**63, size=20_000, dtype=np.uint64)
    whole = jaccard.profile(h)
    assert len(whole) == 4096 and (jaccard.folded(whole, 64) == np.bincount((h % np.uint64(64)).astype(int), minlength=64)).all()


def test_similar_edges(edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert similar(edge) == plain_similar(rows)
    assert similar(edge.withColumnsRenamed({"spans": "_text", "score": "key"}).withColumn("GID", edge.lang)) == plain_similar(rows)
    assert similar(nothing) == []
    alone = similar(edge.where("doc_id is null and text is not null"))
    assert alone == [(None, 1, None, 0)]


# -- hard negatives ------------------------------------------------------------


def plain_negatives(rows, every=50, positives=5, negatives=3, scale=256):
    data = []
    for own, vector, label in rows:
        if own is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            data.append((own, label, [math.floor(scale * x) for x in vector]))
    out = []
    for own in {d[0] for d in data if d[0] % every == 0}:
        label, q = min((d[1], d[2]) for d in data if d[0] == own)
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, at == label) for i, at, v in data if i != own)
        for p, i, _ in [s for s in scored if s[2]][:positives]:
            found = [(n, j) for n, j, same in scored if not same and 50 * -p <= 100 * -n <= 95 * -p][:negatives]
            out += [(own, i, k + 1, j, -p, -n) for k, (n, j) in enumerate(found)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def mined(df, **more):
    return sorted(tuple(r) for r in rtree.mine(df, **more).collect())


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(9)
    near = [[r.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    rows = []
    for i in range(700):
        center = near[r.randrange(6)]
        rows.append((i, [float(np.float32(x + r.gauss(0, 0.2))) for x in center], r.choice([0, 1, 2, 2, 2])))
    return rows + [(1000 + i, rows[50][1], i % 3) for i in range(80)]


def test_negatives_equal_all_pairs(spark, vectors, monkeypatch):
    for name, value in {"TREE": 64, "CHUNK": 3, "PASS_BYTES": 2_000}.items():
        monkeypatch.setattr(rtree, name, value)
    df = spark.createDataFrame(vectors, VECTORS).repartition(4)
    want = plain_negatives(vectors)
    assert len(want) > 100 and mined(df) == want
    assert mined(df, every=35, positives=2, negatives=7) == plain_negatives(vectors, 35, 2, 7)


def test_boxes_are_dropped_on_clustered_vectors(vectors):
    """The queue opens few leaves, and those that it leaves out hold nothing better."""
    r = np.random.default_rng(2)
    x = np.floor(256 * (r.normal(size=(20, 8))[r.integers(20, size=20_000)] + r.normal(scale=0.05, size=(20_000, 8))))
    by = np.concatenate(rtree.packed(x, rtree.LEAF))
    assert sorted(by.tolist()) == list(range(len(x)))
    tree = rtree.Tree(by, np.zeros(len(x), dtype=np.int64), x[by])
    least, most = tree.intervals(x[:50])
    opened = 0
    for i in range(50):
        search = rtree.Search(tree, i, 0, x[i], [b[i] for b in least], [b[i] for b in most], True, True)
        score = x @ x[i]
        want = sorted((-s, j) for j, s in enumerate(score.tolist()) if j != i)[:5]
        assert search.first(5, *rtree.WHOLE) == want
        top = -want[0][0]
        window = sorted((-s, j) for j, s in enumerate(score.tolist()) if j != i and 0.4 * top <= s <= 0.5 * top)[:5]
        assert search.first(5, math.ceil(0.4 * top), math.floor(0.5 * top)) == window
        opened += len(search.known)
    assert opened < 50 * len(most[0][0]) / 3


def test_negatives_edges(spark):
    big, nan = 1e30, float("nan")
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [3.0, -1.0], 0), (None, [1.0, 1.0], 1), (50, None, 1), (100, [nan, 1.0], 1),
        (150, [1.0, None], 1), (200, [float("inf"), 0.0], 1), (250, [], 2), (300, [1.0], None), (1, [2.0, 2.0], 1), (2, [1.0, 1.5], 2),
        (3, [1.0, 1.5], 3), (4, [1.0, 1.5], 3), (5, [1.0, 1.5], 3), (5, [1.0, 1.5], 3), (6, [0.0, 0.0], 2), (-50, [1.0, 1.0], 2),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS + ", id string, v int")
    padded = [(i, v if v is None else [*v, *[0.0] * (2 - len(v))], label) for i, v, label in rows]
    assert mined(df) == plain_negatives(padded)
    assert mined(df.where("false")) == [] and mined(df.where("vec_id = 250")) == [] and mined(df.where("vec_id is null")) == []
    far = [(0, [big, 1.0], 1), (1, [big, 2.0], 1), (2, [big / 2**90, 0.0], 2), (3, [0.0, 1.0], 2)]
    assert all(r[3] in (2, 3) for r in mined(spark.createDataFrame(far, VECTORS)))


# -- resampling ----------------------------------------------------------------


def plain_resample(docs, target, percent=25, least=20, seed=7, n=10_000):
    def features(text):
        low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(f.encode()) % n for f in [*w, *map(" ".join, zip(w, w[1:]))]]

    each = [(own, *features(text)) for own, text in docs]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for text in target for b in features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + n) / ((s[b] + 1) * (big_t + n)))) for b in range(n)]
    rows = []
    for own, words, f in each:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if own is None else own}".encode()).hexdigest()[:8], 16)
        rows.append([own, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words])
    drawn = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): i + 1 for i, r in enumerate(drawn[: len(drawn) * percent // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def resampled(docs, target, **more):
    return sorted((tuple(r) for r in resample.resample(docs, target, **more).collect()), key=str)


def test_resample_equals_plain_python(spark, documents, folder):
    target = spark.read.parquet(f"{folder}/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    items = [r.text for r in target.collect()]
    assert resampled(documents.repartition(3), target) == plain_resample(docs, items)
    assert resampled(documents, target, percent=60, least_words=3, seed=1) == plain_resample(docs, items, 60, 3, 1)


def test_any_head_gives_the_same_buckets(spark, documents, monkeypatch):
    texts = documents.selectExpr("text as _text")
    whole = [(r._text or "").encode() for r in texts.collect()]
    want = [sorted(np.concatenate([[], *resample.Head().features(t)]).tolist()) for t in whole]
    monkeypatch.setattr(resample, "KEPT", 50)
    for size, paired, pairs in ((1, 1, 1), (30, 1024, 0), (30, 8, 20), (5000, 64, 1000)):
        monkeypatch.setattr(resample, "PAIRED", paired)
        head = resample.head(texts, size=size, pairs=pairs)
        assert len(head.words) <= size and (head.table >= 0).sum() <= pairs
        assert [sorted(np.concatenate([[], *head.features(t)]).tolist()) for t in whole] == want
    counts = Counter(w for t in whole for some in resample.words(t, resample.TABLE) for w in some)
    assert [counts[w] for w in head.words] == sorted(counts.values(), reverse=True)[: len(head.words)]


def test_pieces_of_a_long_text_have_the_features_of_the_whole():
    text = " ".join(random.Random(4).choices(["ab", "c1", "Ü", "d-e"], k=3000)).encode()
    whole = [list(w) for w in resample.words(text, resample.TABLE)]
    cut = [list(w) for w in resample.words(text, resample.TABLE, 40)]
    assert len(whole) == 1 and len(cut) > 100 and sum(cut, []) == whole[0]
    head = resample.Head([b"ab", b"c1"], np.array([0, 1, resample.PAIRED]))
    long = b" ".join([text] * 200)
    at_once, plain = list(head.features(long)), re.findall(rb"[0-9a-z\x80-\xff]+", long.lower())
    assert len(at_once) > 2
    want = [zlib.crc32(f) % 10_000 for f in [*plain, *map(b" ".join, zip(plain, plain[1:]))]]
    assert sorted(np.concatenate(at_once).tolist()) == sorted(want)


def test_resample_edges(spark, edge, nothing):
    target = spark.createDataFrame([("the of", "a"), (None, "b"), ("日本語 zz", "c")], "text string, score string")
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    items = ["the of", None, "日本語 zz"]
    assert resampled(edge, target, percent=50, least_words=1) == plain_resample(docs, items, 50, 1)
    assert resampled(edge.withColumnRenamed("score", "_text").withColumnRenamed("spans", "rank"), target) == plain_resample(docs, items)
    assert resampled(nothing, target) == []
    assert resampled(edge, target.where("false"), least_words=1) == plain_resample(docs, [], least=1)
    empty = edge.where("text is null or doc_id = 2")
    assert resampled(empty, target.where("false")) == plain_resample([(r.doc_id, r.text) for r in empty.collect()], [])
