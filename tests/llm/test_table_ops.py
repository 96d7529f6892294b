"""Operators over whole tables: WARC, mixing, near duplicates, top-k, and the pipeline."""

import base64
import gzip
import hashlib
import io
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantide.llm import mixing, near_dedup, registry, topk, warc
from quantide.llm.common import left_join_small, shared_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGES = "page_id bigint, url string, html string"
SF = "/root/testdata/sf0.001"


# -- WARC -----------------------------------------------------------------------------


def through_archives(spark, pages, **options):
    path = shared_path(spark, "warc-test")
    warc.write(warc.typed(pages, **options), path)
    return path, warc.assemble(warc.read(spark, path))


def test_warc_round_trip(spark):
    rows = [(3, "http://a.org/x?q=1#f", "same"), (1, "http://b.org", "same"), (2, None, None), (5, "http://c.org/\r\nX: y", "a\r\n\r\nWARC/1.1\r\n\r\né日本"), (4, "u", ""), (1, "http://b.org", "same"), (None, "n", "same"), (9, "z", "x" * 300_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("kind", F.lit("clash")).withColumn("payload_digest", F.lit(1))
    path, assembled = through_archives(spark, pages)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digests(assembled).collect()), key=str)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = min(k for k, _, x in rows if (x or "") == (h or "") and k is not None)
        again = i is not None and i != first
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    nested = assembled.first()
    assert nested.request.block.startswith(b"GET ") and b"capture-key" in nested.metadata.block
    # the files are plain WARC: every record is there, by its Content-Length
    kinds = Counter()
    for name in os.listdir(path.removeprefix("file:")):
        if name.endswith(".gz") and not name.startswith("."):
            with gzip.open(f"{path.removeprefix('file:')}/{name}") as f:
                kinds.update(h["warc-type"] for h, _ in warc.parse(f))
    assert kinds == {"warcinfo": 1, "request": 8, "metadata": 8, "response": 6, "revisit": 2}


def test_warc_least_bytes_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], PAGES)
    _, assembled = through_archives(spark, pages, least_bytes=3)
    assert {r.page_id: r.record_type for r in warc.digests(assembled).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    _, assembled = through_archives(spark, pages.limit(0))
    assert warc.digests(assembled).count() == 0


def test_warc_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "SIZE_CLASSES", ((100, 50), (1000, 2), (1 << 31, 1)))
    pages = spark.createDataFrame([(i, "u", "x" * (10 if i < 60 else 900 if i < 70 else 5000 + i)) for i in range(73)], PAGES).coalesce(1)
    path, assembled = through_archives(spark, pages, least_bytes=1000)
    sizes = Counter()
    for name in os.listdir(path.removeprefix("file:")):
        if name.endswith(".gz") and not name.startswith("."):
            with gzip.open(f"{path.removeprefix('file:')}/{name}") as f:
                blocks = [len(b) for h, b in warc.parse(f) if h["warc-type"] == "response"]
                sizes[len(blocks), max(blocks, default=0) > 1000] += 1
    assert sizes[1, True] == 3 and sizes[2, False] == 5 and max(n for n, _ in sizes) <= 50
    assert {r.page_id for r in warc.digests(assembled).collect()} == set(range(73))


def test_revisits_are_resolved_and_checked(spark):
    from pyspark.errors import PySparkException

    _, assembled = through_archives(spark, spark.createDataFrame([(1, "u", "same"), (2, "v", "same")], PAGES))
    # without the record it refers to, a revisit has no refers_to; with another payload there, it is refused
    (only,) = warc.digests(assembled.where("kind = 'revisit'")).collect()
    assert (only.page_id, only.record_type, only.refers_to) == (2, "revisit", None)
    other = base64.b32encode(hashlib.sha1(b"other").digest()).decode()
    forged = assembled.withColumn("response", F.when(F.col("kind") == "revisit", F.col("response").withField("payload_digest", F.lit(f"sha1:{other}"))).otherwise(F.col("response")))
    with pytest.raises(PySparkException):
        warc.digests(forged).collect()


def test_warc_damage():
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")))


# -- mixing -----------------------------------------------------------------------------


def documents(spark, sizes):
    rows = [(k, f"text {k}", "en", s, 6) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, DOCS)


def poisson_quantile(rate, u):
    k, p = 0, np.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


def test_mixing_inverts_poisson(spark):
    docs = documents(spark, {"big": 600, "small": 60, None: 30})
    rates = {r.source: r.rate for r in mixing.rates(docs).collect()}
    weights = {s: n**0.5 for s, n in (("big", 600), ("small", 60), (None, 30))}
    for s, n in (("big", 600), ("small", 60), (None, 30)):
        assert rates[s] == pytest.approx(690 * weights[s] / sum(weights.values()) / n)
    got = Counter(r.doc_id for r in mixing.replicate(docs).collect())
    u = {r.doc_id: (r.u, r.source) for r in docs.select("doc_id", "source", mixing.uniform(F.lit(f"count{mixing.SEED}"), F.col("doc_id"), F.md5("text")).alias("u")).collect()}
    assert all(got[d] == poisson_quantile(rates[s], x) for d, (x, s) in u.items())


def test_mixing_targets(spark):
    docs = documents(spark, {"a": 2000, "b": 200, "c": 10})
    out = mixing.replicate(docs, targets={"a": 1, "b": 1, "absent": 5}, copy=None)
    assert out.columns == docs.columns
    n = Counter(r.source for r in out.collect())
    assert n["c"] == 0 and n["a"] / n["b"] == pytest.approx(1, rel=0.15)
    assert mixing.replicate(docs.limit(0)).count() == 0
    assert [r.doc_id for r in out.collect()] == [r.doc_id for r in mixing.replicate(docs.repartition(7), targets={"b": 2, "a": 2}, copy=None).collect()]
    with pytest.raises(ValueError):
        mixing.rates(docs, {"a": -1})
    nulls = documents(spark, {None: 300, "a": 30})
    assert {r.source for r in mixing.replicate(nulls, targets={None: 1.0}).collect()} == {None} and mixing.replicate(nulls, targets={None: 0.0}).count() == 0


def test_mixing_derived_input(spark):
    """A table that is computed, not read, with adaptive execution."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit(1).alias("n_chars"))
    out = mixing.replicate(docs)
    assert out.count() == len(out.collect()) > 3500
    bare = mixing.replicate(docs.select("doc_id", "source"))
    assert bare.columns == ["doc_id", "source", "copy"] and bare.count() > 3500


@pytest.mark.parametrize("hot", ["cast(null as long)", "7L"])
def test_mixing_hot_ids(spark, hot):
    """A third of the rows without an id, or with the same one: even partitions, and the rate as for others."""
    docs = spark.range(40_000).selectExpr(f"if(id % 3 = 0, {hot}, id) AS doc_id", "concat('text ', id) AS text", "'en' AS lang", "if(id % 3 = 0, 'hot', 'b') AS source", "1 AS n_chars")
    rate = {r.source: (r.rate, r.n) for r in mixing.rates(docs).collect()}
    out = mixing.replicate(docs)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1.1 * sum(sizes) / len(sizes)
    mean, n = rate["hot"]
    assert abs(out.where("source = 'hot'").count() - mean * n) < 4 * math.sqrt(mean * n)
    copies = Counter(out.where("source = 'hot'").groupBy("text").count().select("count").toPandas()["count"])
    assert len(copies) > 3


def test_small_join_spreads_equal_rows(spark):
    """Beyond what is broadcast: equal rows are spread, and columns that can't be hashed are no trouble."""
    left = spark.range(20_000, numPartitions=40).selectExpr("if(id % 3 = 0, 0L, id) AS k", "'same' AS x", "array(map(1, 2)) AS nested", "map(1, 2) AS m")
    right = spark.range(30_000).selectExpr("id AS k", "id * 2 AS twice")
    out = left_join_small(left.drop("twice"), right, ["k"], limit=10)
    assert out.columns == ["k", "x", "nested", "m", "twice"] and out.where("twice <> 2 * k or twice is null").count() == 0
    salts = left.select(F.pmod(F.xxhash64("k", "x", F.spark_partition_id()), F.lit(64)).alias("s")).groupBy("s").count().collect()
    assert out.count() == 20_000 and max(r["count"] for r in salts) < 3_000


def test_mixing_order_and_clashing_names(spark):
    """Partitions are in order of the hash; rows and columns survive names that the operator uses inside."""
    docs = documents(spark, {"a": 500, "b": 50}).selectExpr("*", "1 as cdf", "2 as n", "3 as rate", "4 as first", "5 as _mix_n", "6 as _mix_order", "7 as _salt", "8 as _r_source", "9 as k")
    out = mixing.replicate(docs)
    assert out.columns == [*docs.columns, "copy"] and out.where("cdf <> 1 or _mix_n <> 5 or k <> 9").count() == 0
    order = [hashlib.md5(f"order{mixing.SEED}|{r.doc_id}|{hashlib.md5(r.text.encode()).hexdigest()}|{r.copy}".encode()).hexdigest() for r in out.collect()]
    assert order == sorted(order) and len(order) > 400
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


@pytest.mark.parametrize("rate", [0.0, 0.01, 3.0, 19.5, 150.0, 4000.0])
def test_distribution_in_a_window_of_terms(spark, rate):
    d = mixing.with_distribution(spark.createDataFrame([("s", rate)], "source string, rate double")).first()
    total, p = 0.0, math.exp(-rate) if rate < 700 else None
    if p is None:
        assert len(d.cdf) < 30 * math.sqrt(rate) + 60 and d.cdf[-1] == pytest.approx(1, abs=1e-9) and d.cdf[int(rate) - d["first"]] == pytest.approx(0.5, abs=0.01)
        return
    for k in range(d["first"] + len(d.cdf)):
        p = p * rate / k if k else p
        total += p
        assert k < d["first"] or d.cdf[k - d["first"]] == pytest.approx(total, abs=1e-12)


def test_join_beyond_the_broadcast_limit(spark):
    left = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None) for i in range(100)], "x int, k string")
    right = spark.createDataFrame([("a", 1), (None, 3)], "k string, v int")
    few, many = (sorted((r.x, r.v) for r in left_join_small(left, right, ["k"], limit=n).collect()) if n else sorted((r.x, r.v or 0) for r in left_join_small(left, right, ["k"], limit=0).collect()) for n in (0, 0))
    assert few == many
    assert sorted((r.x, r.v or 0) for r in left_join_small(left, right, ["k"]).collect()) == many


# -- near duplicates ------------------------------------------------------------------


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    x, y = bag(a), bag(b)
    either = sum((x | y).values())
    return sum((x & y).values()) / either if either else 0.0


def brute_classes(rows, threshold=0.8):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    items = [(i, t or "") for i, t in rows]
    for n, (i, a) in enumerate(items):
        for j, b in items[:n]:
            if find(i) != find(j) and (a == b or similarity(a, b) >= threshold):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i, _ in items}


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = rnd.choice(["new", "other", "words"]) + str(rnd.randrange(99))
    return out


def corpus(seed=1):
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    texts = [None, "", "one", "one", "one two", " one", "a b c d e", "a b c d e"]
    for _ in range(12):
        base = fresh(rnd.choice([30, 80, 300]))
        texts.append(" ".join(base))
        texts += [" ".join(edited(rnd, base, rnd.randint(0, 4))) for _ in range(rnd.randint(1, 5))]
    # a large group around a text that isn't there, a passage that many share, heavy repeats
    base = fresh(120)
    texts += [" ".join(edited(rnd, base, rnd.randint(1, 6))) for _ in range(40)]
    passage = fresh(60)
    texts += [" ".join(passage + fresh(rnd.randint(10, 60))) for _ in range(30)]
    texts += ["ha " * n for n in (50, 55, 61, 300)]
    texts += [" ".join(fresh(100)) for _ in range(30)]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_bags_and_signatures():
    rnd = random.Random(7)
    errors = []
    for _ in range(40):
        a = rnd.choices([f"w{i}" for i in range(rnd.choice([2, 20, 3000]))], k=rnd.choice([3, 5, 8, 200, 900]))
        b = edited(rnd, a, rnd.choice([0, 1, 3, len(a) // 10])) + (a[: len(a) // 3] if rnd.random() < 0.3 else [])
        ta, tb = " ".join(a), " \n".join(b)
        doc, shingle, count = near_dedup.bags([ta.encode(), tb.encode()])
        k = np.searchsorted(doc, 1)
        want = similarity(ta, tb)
        assert near_dedup.weighted_jaccard((shingle[:k], count[:k]), (shingle[k:], count[k:])) == pytest.approx(want)
        sig = near_dedup.signatures(2, doc, shingle, count)
        errors.append((sig[0] == sig[1]).mean() - want)
    # unbiased, with the spread of 252 draws
    assert abs(np.mean(errors)) < 0.015 and np.sqrt(np.mean(np.square(errors))) < 0.05


@pytest.mark.parametrize(("pivots", "per_cut"), [((1, 32, 1024), 256), ((1, 2), 3)])
def test_near_duplicates(spark, monkeypatch, pivots, per_cut):
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    monkeypatch.setattr(near_dedup, "PER_CUT", per_cut)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("node", F.lit(1)).withColumn("bucket", F.lit("x"))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()}
    assert got == brute_classes(rows)


def test_keep_one(spark):
    text = "a b c d e f g h i j"
    rows = [(5, text), (3, text), (3, text), (4, "quite another text with other words in it"), (None, text), (7, None), (8, ""), (None, "nameless words one two three four five"), (None, "nameless words one two three four five")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    kept = sorted((r.doc_id or -1) for r in near_dedup.keep_one(docs).collect())
    assert kept == [-1, 3, 4, 7] and near_dedup.keep_one(docs).columns == docs.columns
    assert near_dedup.keep_one(docs.limit(0)).count() == 0
    ids = sorted(((r.doc_id, min(r.class_id, 99)) for r in near_dedup.classes(docs).collect()), key=str)
    assert ids == sorted([(5, 3), (3, 3), (3, 3), (4, 4), (None, 3), (7, 7), (8, 7), (None, 99), (None, 99)], key=str)


def test_ids_with_several_texts_and_clashing_names(spark):
    """Each text of an id is judged by itself; columns of the documents may be called anything."""
    a, b = "a b c d e f g h i j", "other words stand here and there and so on"
    near = b + " more"
    rows = [(3, a), (5, a), (5, b), (6, near), (9, "alone with its own words to the end"), (9, "another text of the same id and no other")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    names = ["node", "n2", "_node", "_id", "_digest", "digest", "id", "bucket", "n", "comp", "kept", "_other_id", "rep", "first"]
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(3, a), (5, b), rows[4], rows[5]])
    # repeated rows change nothing
    assert sorted((r.doc_id, r.text) for r in near_dedup.keep_one(docs.union(docs)).collect()) == sorted((r.doc_id, r.text) for r in kept.collect())
    got = [(r.doc_id, r.class_id) for r in near_dedup.classes(docs).collect()]
    assert len(got) == 6 and len({c for _, c in got}) == 4 and (5, 3) in got and (3, 3) in got


def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 30)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.comp for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent) if find(x) != x}


# -- top-k --------------------------------------------------------------------------------


def brute_top(rows, k=10):
    ok = [(i, [int(np.floor(1024.0 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in ok if i % 100 == 0}:
        # scores beyond 64 bits are set to the nearest 64-bit number
        scored = sorted((-min(max(sum(x * y for x, y in zip(a, b)), -(1 << 63)), (1 << 63) - 1), i) for i, b in ok if i != q and len(b) == len(a))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "TREE_ROWS", 150)
    monkeypatch.setattr(topk, "PAGE", 8)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((4, 6))
    rows = [(i, [float(x) for x in np.float32(centres[i % 4] + 0.3 * rng.standard_normal(6))]) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # a hot vector
    rows += [(2000, None), (2001, []), (2002, [1.0, None]), (2003, [float("nan")] * 6), (2100, [1.0, 2.0]), (2101, [3.0, -1.0]), (None, [1.0] * 6), (300, rows[300][1])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("tree", F.lit(1)).withColumn("label", F.lit(2))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, "id % 100 = 0").collect())
    assert got == brute_top(rows)
    assert topk.top_k(frame.limit(0), "id % 100 = 0").count() == 0


def test_tree_prunes():
    rng = np.random.default_rng(1)
    x = np.floor(1024 * np.concatenate([c + 0.02 * rng.standard_normal((2000, 8)) for c in 3 * rng.standard_normal((5, 8))]))
    tree = topk.MTree.of_pages(topk.MTree(np.arange(10000), x).pages())
    want = sorted((-int(s), i) for i, s in enumerate(x @ x[0]) if i != 0)[:10]
    assert tree.search(0, x[0], 10) == [(-s, i) for s, i in want] and 0 < tree.computed < 3000
    # the upper tree gives objects by their bound, all of them or down to a floor
    cover = rng.random(10000) * 50
    upper = topk.MTree.of_pages(topk.MTree(np.arange(10000), x, cover).pages())
    got = [(b, int(upper.keys[n])) for b, n in upper.nearest(x[0])]
    bounds = x @ x[0] + cover * np.linalg.norm(x[0])
    assert sorted(n for _, n in got) == list(range(10000)) and np.allclose([b for b, _ in got], np.sort(bounds)[::-1])
    floor = float(np.sort(bounds)[-50]) - 1
    assert {int(upper.keys[n]) for _, n in upper.nearest(x[0], floor)} == set(np.flatnonzero(bounds >= floor).tolist())


@pytest.mark.parametrize(("n", "own"), [(200, 15), (2000, 40)])
def test_top_k_of_repeated_query_rows(spark, monkeypatch, n, own):
    monkeypatch.setattr(topk, "TREE_ROWS", 300)
    monkeypatch.setattr(topk, "PAGE", 32)
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((n, 8)).tolist()
    rows = [*enumerate(vectors), *[(100, vectors[100])] * own, (0, vectors[3]), (300, [1e9] * 8), (301, [1e12] * 8), (400, [3e8] * 8), (11, [1e300] + [0.0] * 7)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("part", F.lit(1)).withColumn("query", F.lit(2))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, "id % 100 = 0").collect())
    assert got == brute_top(rows)


@pytest.mark.parametrize("own", [1, 11, 12, 40])
def test_repeated_query_id_hides_no_candidate(own):
    """However many rows share the query's id, the page's others are candidates, ties by id."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.full((own, 4), 1000), rng.integers(0, 30, (60, 4)) * 30]).astype(np.int64)
    ids = np.array([0] * own + list(range(1, 61)))
    want = sorted((-int(s), i) for s, i in zip(x @ x[0], ids) if i != 0)[:10]
    assert topk.MTree(ids, x).search(0, x[0], 10) == [(-s, i) for s, i in want]


def test_big_components(spark):
    rows = [(0, [1e15, 1.0]), (1, [1e15, 2.0]), (2, [-1e15, 3.0])]
    got = [(r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "id = 0").orderBy("rank").collect()]
    assert got == [(1, (1 << 63) - 1), (2, -(1 << 63))]


# -- registered queries and the pipeline -------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF), con.sql(registry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda v: int(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    b = sorted((tuple(plain(v) for v in r) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()), key=str)
    assert a == b


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as cp

    from quantide.llm import bpe, quality, secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = {r.doc_id: r for r in docs.collect()}
    kept = [r.doc_id for r in quality.judge(docs).where("kept").collect()]
    classes = brute_classes([(i, table[i].text) for i in sorted(kept)])
    ones = sorted(set(classes.values()))
    sources = Counter(table[i].source for i in ones)
    weights = {s: n**0.5 for s, n in sources.items()}
    want = []
    library = bpe.encoder(bpe.default_vocabulary())
    for i in ones:
        s = table[i].source
        rate = round(len(ones) * weights[s] / sum(weights.values()) / sources[s], 9)
        u = int(hashlib.md5(f"count{mixing.SEED}|{i}".encode()).hexdigest()[:13], 16) / 2**52
        text = secrets.redacted(table[i].text)
        ids = library.encode(text)
        want += [(i, len(ids), hashlib.sha256(text.encode()).hexdigest())] * poisson_quantile(rate, u)
    got = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in cp.run(spark, SF).collect())
    assert got == sorted(want)
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "secrets", "mix", "encode"]


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_pivots_of_a_large_bucket(spark):
    """The first members of a bucket of 50,000 in 196 cuts are right, and no task of the tree gets more than a few groups' firsts."""
    n, cuts = 50_000, 196
    members = spark.range(n).selectExpr("1L AS bucket", "id AS node", f"cast(pmod(hash(id), {cuts}) AS int) AS cut", f"{cuts} AS cuts", "id AS comp", "cast(pmod(hash(id, 7), 1000) AS int) AS place", "10 AS weight", "9 AS shared", "array(1) AS parts")
    members = members.unionByName(spark.range(5).selectExpr("2L AS bucket", "id AS node", "0 AS cut", "1 AS cuts", "id AS comp", "cast(id AS int) AS place", "10 AS weight", "9 AS shared", "array(1) AS parts"))
    rows = members.select("bucket", "place", "node").collect()
    for most in (1, 32, 300):
        got = {(r.bucket, r.p_place, r.p_node) for r in near_dedup._pivots(members, most).collect()}
        want = {x for b in (1, 2) for x in sorted(tuple(r) for r in rows if r.bucket == b)[:most]}
        assert got == want
