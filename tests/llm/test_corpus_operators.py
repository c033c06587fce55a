"""WARC, URLs, near copies, benchmark overlaps, nearest vectors and the pipeline against plain Python."""

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tillwise.llm import bpe, components, decontaminate, simhash, urls, voronoi, warc
from tillwise.llm.queries import oracles, queries
from tillwise.scratch import materialize

# -- WARC --------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(3, "http://a/", "same"), (1, "http://b/", "same"), (2, None, None), (4, "u", ""), (1, "http://b/", "same"),
            (None, "v", "same"), (5, "http://ü/", "日本" * 5000), (6, "x\r\ny", "one\r\n\r\nWARC/1.0")]
    return spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, payload int")


def test_archive_round_trip(pages):
    rows = warc.archive(pages).collect()
    text = {1: "same", 3: "same", 2: "", 4: "", 5: "日本" * 5000, 6: "one\r\n\r\nWARC/1.0", None: "same"}
    assert len(rows) == 8
    for r in rows:
        data = text[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows)
    assert kinds == [(0, "response", None), (1, "response", None), (1, "response", None), (2, "response", None),
                     (3, "revisit", 1), (4, "revisit", 2), (5, "response", None), (6, "response", None)]
    assert warc.archive(pages.where("false")).count() == 0
    assert {r.record_type for r in warc.archive(pages, smallest=5).collect()} == {"response"}


def test_predicates_reach_the_scan_and_leave_other_queries_alone(spark, pages, tmp_path):
    path = warc.write(warc.page_records(pages), str(tmp_path / "w"))
    every = warc.read(spark, path)
    revisits = warc.read(spark, path, payloads=False, where="record_type = 'revisit'")
    assert (revisits.count(), every.where("record_type = 'revisit'").count(), every.count()) == (2, 2, 8)
    assert "PythonScan" in (plan := revisits._jdf.queryExecution().executedPlan().toString()) or "record_type" in plan
    assert warc.read(spark, path, where="record_id in ('urn:x-page:5', 'urn:x-page:6')").count() == 2
    assert {r.payload for r in warc.read(spark, path, payloads=False).collect()} == {None}


def test_plain_and_foreign_files_are_read_and_lost_attempts_are_not(spark, pages, tmp_path):
    path = tmp_path / "w"
    warc.write(warc.page_records(pages).coalesce(1), str(path))
    (path / "left-over.warc.gz").write_bytes(b"a lost attempt")
    assert warc.read(spark, str(path)).count() == 8
    data = b"".join(gzip.open(f).read() for f in path.glob("*.warc.gz") if "left" not in f.name)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "x.warc").write_bytes(data)
    (tmp_path / "plain" / "y.warc.gz").write_bytes(gzip.compress(warc.record(dict.fromkeys(warc.RECORD.names) | {"record_type": "resource", "payload": b"z"})))
    got = warc.read(spark, str(tmp_path / "plain")).collect()
    assert len(got) == 9 and {r.payload for r in got if r.record_type == "resource"} == {b"z"}


def test_a_stream_of_many_records_in_one_member_is_read_whole(spark, tmp_path):
    bodies = [b"a", b"", b"one\r\n\r\nWARC/1.0" * 9, b"x" * (3 << 20), b"\r\n", b"end"]
    kinds = ["response", "revisit", "resource", "response", "response", "response"]
    each = [
        warc.record(dict.fromkeys(warc.RECORD.names) | {"record_type": k, "payload": b, "record_id": f"urn:{i}"})
        for i, (k, b) in enumerate(zip(kinds, bodies, strict=True))
    ]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(each)))
    (tmp_path / "b.warc.gz").write_bytes(warc.gzip_member(b"".join(each[:3])) + gzip.compress(b"".join(each[3:])))
    got = warc.read(spark, str(tmp_path)).collect()
    want = {f"urn:{i}": None if k == "revisit" else b for i, (k, b) in enumerate(zip(kinds, bodies, strict=True))}
    assert len(got) == 12 and all((r.payload if r.payload is None else bytes(r.payload)) == want[r.record_id] for r in got)
    some = warc.read(spark, str(tmp_path), payloads=False, where="record_type = 'response'").collect()
    assert sorted(r.record_id for r in some) == sorted(["urn:0", "urn:3", "urn:4", "urn:5"] * 2)
    assert {r.payload for r in some} == {None} and {r.http_length for r in some} == {1, 3 << 20, 2, 3}


# -- URLs --------------------------------------------------------------------


def plain_rule(url):
    if "://" not in (url or ""):
        return "", "", None
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    best = None
    for rule, _ in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best or ""):
            best = rule
    return host, path, best


def test_rules_equal_plain_python(spark, folder):
    odd = ["HTTP://A.Example.ORG/es/x?y", "http://example.org", "http://org/", "http://xorg/", "http://a.org?x/", None, "",
           "no scheme", "http://example.org/en/19#x", "http://a.com/fr/", "http://É.COM/de/", "x://y://org/", "http://corg/en/"]
    pages = spark.createDataFrame([(i, u, "s") for i, u in enumerate(odd)], "page_id long, url string, score string")
    pages = pages.unionAll(spark.read.parquet(f"{folder}/pages.parquet").selectExpr("page_id + 1000", "url", "html"))
    want = {r.page_id: plain_rule(r.url) for r in pages.collect()}
    verdict = dict(urls.RULES)
    rows = urls.judge(pages).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.host, r.path, r.rule) == want[r.page_id]
        assert r.verdict == verdict[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert urls.judge(pages.where("false")).count() == 0
    assert {r.verdict for r in urls.judge(pages.where("url is null")).collect()} == {"allow"}


def test_scores_of_the_url_model_equal_plain_counts(spark):
    """Counts of contexts of up to four bytes in dicts, mixed order by order."""
    good, bad = ["http://aa.org/x1", "http://ab.org/x22"], ["http://ba.com/de/7", "http://bb.com/de/8"]
    table = urls.count(
        spark.createDataFrame([(u, 0) for u in good] + [(u, 1) for u in bad], "url string, side int")
    )

    def grams(u):
        data = b"\0" * urls.ORDER + u.encode() + bytes([urls.END])
        for at in range(urls.ORDER, len(data)):
            for k in range(urls.ORDER + 1):
                yield at - urls.ORDER, (k, data[at - k : at]), data[at]

    counts = []
    for side in (good, bad):
        seen = {}
        for u in side:
            for _, context, byte in grams(u):
                seen[context] = seen.get(context, 0) + 1
                seen[context, byte] = seen.get((context, byte), 0) + 1
        counts.append(seen)
    asked = [*good, *bad, "http://aa.com/de/1", "", "ftp://zz", "http://ab.org/x2/ü"]
    for u, score in zip(asked, urls.ratio(asked, table), strict=True):
        logs = []
        for seen in counts:
            p = {}
            for at, context, byte in grams(u):
                n = seen.get(context, 0)
                p[at] = (seen.get((context, byte), 0) + urls.WEIGHT * p.get(at, 1 / 256)) / (n + urls.WEIGHT)
            logs.append(np.log(list(p.values())))
        assert score == pytest.approx((logs[0] - logs[1]).mean(), abs=1e-9)


def test_the_model_tells_the_sides_apart(spark):
    r = random.Random(5)
    good = [f"http://news{r.randrange(99)}.org/{r.randrange(9999)}" for _ in range(400)]
    bad = [f"http://bets{r.randrange(99)}.com/de/{r.randrange(9999)}" for _ in range(400)]
    asked = ["http://news5.net/12", "http://bets5.net/de/77"]
    rows = urls.judge(spark.createDataFrame(list(enumerate(good + bad + asked)), "page_id long, url string")).collect()
    assert {r.page_id: r.verdict for r in rows if r.rule is None} == {800: "allow", 801: "block"}


# -- near copies -------------------------------------------------------------


def plain_fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    if not found:
        return 0
    grams = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """Smallest place that each place reaches by steps of at most two bits."""
    found = [-1] * len(prints)
    for i in range(len(prints)):
        open_ = [i] if found[i] < 0 else []
        while open_:
            j = open_.pop()
            if found[j] < 0:
                found[j] = i
                open_ += [k for k in range(len(prints)) if found[k] < 0 and (prints[j] ^ prints[k]).bit_count() <= 2]
    return found


def test_near_duplicates_equal_plain_python(spark, documents):
    r = random.Random(6)
    base = "one two three four five six seven eight nine ten eleven twelve".split()
    extra = [(10_000 + i, " ".join(r.sample(base, 12) if i % 3 else base)) for i in range(40)]
    extra += [(20_000 + i, t) for i, t in enumerate([None, "", " ", "A", "a", "a b", "A  b", "a b c"])]
    docs = documents.select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = sorted((x.doc_id, x.text) for x in docs.collect())
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{p:016x}", rows[c][0]) for (d, _), p, c in zip(rows, prints, roots, strict=True)}


def test_links_connect_all_within_two_bits(spark):
    r = random.Random(7)
    values = {0, (1 << 64) - 1}
    for _ in range(30):
        v = r.getrandbits(64)
        for _ in range(20):
            values.add(v)
            for _ in range(r.randrange(1, 4)):
                v ^= 1 << r.randrange(64)
    values = sorted(values)
    roots = plain_components(values)
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fingerprint long")
    found = {x.node: x.root for x in components.components(simhash.links(df)).collect()}
    own = {v: found.get(simhash.signed(v), simhash.signed(v)) for v in values}
    groups = lambda keys: sorted(map(sorted, {k: [v for v, q in zip(values, keys, strict=True) if q == k] for k in keys}.values()))
    assert groups([own[v] for v in values]) == groups(roots)


def test_bk_tree_walk_equals_all_pairs():
    values = np.unique(np.random.default_rng(8).integers(0, 1 << 12, 300, dtype=np.uint64))
    near = {n: set(f.tolist()) for n, f in simhash.BkTree(values).near(2)}
    for i, v in enumerate(values):
        assert near.get(i, set()) == {j for j, w in enumerate(values) if j != i and int(v ^ w).bit_count() <= 2}


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 301), (301, 300), (None, 1)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = dict.fromkeys(range(51), 0) | dict.fromkeys(range(100, 160), 100) | {300: 300, 301: 300}
    assert got == want


def test_one_of_each_group_stays(edge, nothing):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 4, 6]
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["no id here"]
    assert simhash.keep_one(nothing).count() == 0 and simhash.near_duplicates(nothing).count() == 0


# -- benchmark ---------------------------------------------------------------


def test_replaced_words_do_not_hide_a_passage(spark, edge, nothing):
    r = random.Random(9)
    fresh = lambda n: ["w" + str(r.randrange(10**9)) for _ in range(n)]
    item = fresh(30)
    items = spark.createDataFrame(
        [(1, " ".join(item)), (1, " ".join(item)), (2, "a b"), (3, None), (None, "")], "item_id long, text string"
    )
    changed = list(item)
    changed[7], changed[20] = "x1", "x2"
    half = item[:13] + fresh(17)
    few = item[:8] + fresh(22)
    texts = {1: item, 2: changed, 3: half, 4: few, 5: fresh(30), 6: ["a", "b"], 7: item[3:]}
    rows = [(i, " ".join(fresh(20) + t + fresh(20)).upper() + ".", 1) for i, t in texts.items()]
    rows += [(None, " ".join(item), 1), (9, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = decontaminate.contaminated(docs, items).collect()
    assert {x.doc_id for x in got if x.item_id == 1} == {1, 2, 3, 7, None}
    # The item of two words is found where it stands whole.
    assert {(x.doc_id, x.item_id, x.share) for x in got if x.item_id != 1} == {(6, 2, 1.0)}
    assert sorted(x.doc_id for x in decontaminate.clean(docs, items).collect()) == [4, 5, 9]
    many = decontaminate.overlaps(docs, items, most_seeds=30).select("diagonal").count()
    assert many == decontaminate.overlaps(docs, items).count()
    assert decontaminate.clean(edge, items).count() == 9
    assert decontaminate.clean(nothing, items).count() == 0 and decontaminate.clean(edge, items.where("false")).count() == 9


def plain_overlaps(docs, items):
    """(doc, item) -> first word, last word and best share over all windows on all diagonals."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, text in docs:
        w = split(text)
        for i, item in items:
            v = split(item)
            span = min(13, len(v))
            for diagonal in range(-len(v), len(w)) if v else ():
                same = [0 <= diagonal + k < len(w) and w[diagonal + k] == x for k, x in enumerate(v)]
                for s in range(len(v) - span + 1):
                    if (share := sum(same[s : s + span]) / span) >= 0.8:
                        first, last, best = out.get((d, i), (10**9, -1, 0))
                        at = diagonal + s
                        out[d, i] = min(first, max(0, at)), max(last, min(len(w) - 1, at + span - 1)), max(best, share)
    return out


def found_overlaps(spark, docs, items, **more):
    got = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    return {(r.doc_id, r.item_id): (r.first_word, r.last_word, r.share) for r in got.collect()}


def test_every_confirmable_overlap_is_found_whatever_the_length_of_the_item(spark):
    """All ways to replace up to two words of items of 1 to 15 words (three of 14 and 15)."""
    from itertools import combinations

    docs, items = [], []
    for n in range(1, 16):
        items.append((n, " ".join(f"i{n}w{k}" for k in range(n))))
        for gone in [g for m in range(3 + (n > 13)) for g in combinations(range(n), m)]:
            passage = ["other" if k in gone else f"i{n}w{k}" for k in range(n)]
            docs.append((len(docs), " ".join(["x", "y", *passage, "z"])))
    got = found_overlaps(spark, docs, items)
    want = plain_overlaps(docs, items)
    assert got == want and len({i for _, i in got}) == 15


def test_overlaps_of_few_words_equal_all_diagonals(spark):
    """Repeated words, runs and cut passages: many hits on many diagonals."""
    r = random.Random(12)
    line = ["a", "b", "c", "d", "a", "b"]
    docs = [(i, " ".join(r.choices("abcd", weights=[9, 3, 2, 1], k=r.randrange(1, 70)))) for i in range(60)]
    docs += [(100, "a " * 300), (101, "b " + "a " * 90 + "c " + "a " * 40), (102, " ".join(line * 20)), (103, "a"), (104, "")]
    items = [(i, " ".join(r.choices("abcd", k=n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 8, 10, 12, 13, 14, 20, 30])]
    items += [(50, "a " * 50), (51, " ".join(line * 4)), (52, "a " * 13), (53, "a " * 20 + "b c d")]
    assert found_overlaps(spark, docs, items) == plain_overlaps(docs, items)


def test_long_runs_of_one_word_stay_small(spark):
    docs = [(i, "word " * 20_000) for i in range(3)]
    items = [(i, "word " * (31 + i)) for i in range(20)]
    got = found_overlaps(spark, docs, items)
    assert got == {(d, i): (0, 19_999, 1.0) for d in range(3) for i in range(20)}


def test_decontamination_runs_no_python(documents, spark, folder):
    df = decontaminate.contaminated(documents, spark.read.parquet(f"{folder}/benchmark.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


# -- vectors -----------------------------------------------------------------


def plain_top(rows, k):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % 100 == 0}):
        a = min(v for i, v in good if i == q)
        s = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in good if i != q)[:k]  # noqa: B905
        out += [(q, n, i, -p) for n, (p, i) in enumerate(s, 1)]
    return out


def test_top_k_equals_brute_force(spark):
    g = np.random.default_rng(10)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(g.normal(size=(350, 5)).astype(np.float32))]
    rows += [(400, [1.0] * 5), (401, [1.0] * 5), (402, [1.0] * 5), (500, [2.0]), (600, []), (None, [1.0] * 5), (700, None),
             (701, [1.0, None, 1.0, 1.0, 1.0]), (800, [float("nan")] * 5), (801, [float("inf")] * 5), (300, [0.5] * 5), (402, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    want = plain_top(rows, 10)
    for blocks in ({}, {"query_block": 2, "data_block": 40}):
        got = sorted(tuple(r) for r in voronoi.top_k(df, **blocks).collect())
        assert got == want
    assert voronoi.top_k(df.where("false")).count() == 0
    assert voronoi.top_k(df.where("vec_id = 400")).count() == 0


def test_top_k_on_clustered_vectors(spark):
    g = np.random.default_rng(11)
    centre = np.eye(16)[g.integers(0, 16, 3000)] * 10
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(centre + g.normal(size=centre.shape) * 0.1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in voronoi.top_k(df).collect())
    assert got == plain_top([(i, np.float32(v)) for i, v in rows], 10)


def test_products_beyond_doubles_are_whole():
    a = np.array([[2.0**40, 1.0]])
    b = np.array([[2.0**20, 1.0], [2.0**40, 0.0]])
    assert voronoi.scores(a, b).tolist() == [[2**60 + 1, 2**63 - 1]]


# -- queries and pipeline ----------------------------------------------------


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_equals_sql(spark, folder, name):
    import duckdb
    import pandas as pd

    from check import TABLES, normal

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = queries()[name](spark, folder).toPandas()
    pd.testing.assert_frame_equal(normal(got), normal(db.execute(oracles()[name]).fetchdf()), check_dtype=False)


def test_pipeline_stages_do_what_their_operators_find(spark, folder, documents):
    docs = documents
    benchmark = {r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 0").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = materialize(stage(spark, docs, folder))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
    first, second, third, fourth, last = kept.values()
    assert len(bad & set(first)) < 0.2 * len(bad)
    rows = sorted((d, r.text) for d, r in first.items())
    roots = plain_components([plain_fingerprint(t) for _, t in rows])
    assert set(second) == {rows[c][0] for c in roots}
    assert not any(b in (r.text or "") for r in third.values() for b in benchmark)
    assert {d: r.text for d, r in fourth.items() if "[SECRET]" not in r.text} == {
        d: third[d].text for d, r in fourth.items() if "[SECRET]" not in r.text
    }
    assert all(r.n_chars == len(r.text) for r in fourth.values())
    own = bpe.WordBpe(bpe.VOCABULARY)
    assert {d: r.ids for d, r in last.items()} == {d: own.encode([r.text])[0] for d, r in fourth.items()}
    assert all(r.decoded == own.decode(r.ids) for r in last.values())
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {d: r.n_tokens for d, r in last.items()}


def test_pipeline_stages_take_edge_cases(spark, folder, edge, nothing):
    for docs in (edge, nothing):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, folder).count() <= docs.count()


#: Names that operators and stages use inside; a table may have columns with any of them, in any case.
INSIDE = """_k1 _k2 _score score spans SPANS _live _new _text fingerprint root component_id key0 key1 words item item_words item_key
position seed at diagonal first last first_word last_word share hits _row _repository _owner value _k1_ n key prefix profile gid
least copies ids decoded n_tokens weight rank place _item _words _found""".split()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_columns_with_inner_names_keep_their_values(spark, folder, documents, name, stage):
    from pyspark.sql import functions as F

    names = list({n.lower(): n for n in INSIDE}.values())
    extra = {n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names}
    plain = {r.doc_id: r.text for r in stage(spark, documents, folder).collect()}
    done = stage(spark, documents.withColumns(extra), folder)
    assert done.columns == [*documents.columns, *names]
    rows = done.collect()
    assert {r.doc_id: r.text for r in rows} == plain
    for r in rows:
        assert all(r[n] == f"{n}{r.doc_id}" for n in names)


def test_computed_columns_replace_those_of_the_same_name_in_any_case(spark):
    from tillwise.llm import secrets

    docs = spark.createDataFrame([(1, "password = abcdef12", "x")], "doc_id long, text string, SPANS string")
    done = secrets.scan(docs)
    assert done.columns == ["doc_id", "text", "spans"] and done.first().spans[0].start == 0
