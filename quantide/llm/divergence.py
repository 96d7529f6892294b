"""Source divergence audit: how far the sources of a language differ in their words, and by which words.

Terms are runs of letters and of non-ASCII characters; only A to Z are lower-cased. A language keeps the
terms that at least ``MIN_DOCS`` of its documents hold. Each group (a source in a language) and each language
gives every kept term a smoothed share p in billionths, in exact integer arithmetic. The audit has two parts:

* ``pair``: for each other source of the language, the sum over all kept terms of the distance of the two shares;
* ``term``: the kept terms that a group uses more than its language does, the ``top`` first by the difference.

The first terms are found by a dominance skyband. A term's difference can't be smaller, nor its place later, than that
of a term with at most its count in the group, at least its count in the language and a later spelling. So a term that
k others dominate isn't among the first k, whatever the totals are. Each partition keeps, of each group, the terms
that fewer than k others of the partition dominate (``skyband``); the bands are merged in the same way, by groups
of partitions, and what is left is ranked exactly. The members of a band are enough to count a term's dominators up to k, as
the k first dominators of any term are in the band themselves.

Counting is done by a pass over the texts in which each task adds up counts per group and term and hands them on
whenever ``ENTRIES`` have gathered, so a hot source is summed up where it is read. Distances of sources are summed over
chunks of terms and blocks of sources, dense inside a block; where both sources lack a term the term's share
comes from a closed form. The result has a row for every ordered pair of sources of a language, as its contract says; nothing larger is made.

Defined results: null text, lang and source count as empty; every row counts as a document, repeated ones too; a group
without terms has its pairs and no terms; a language without kept terms has distances of 0; ties go to the item that is
earlier in UTF-8; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantide.llm.common import drop_stored, left_join_small, stored, table

#: documents of a language that hold a kept term
MIN_DOCS = 30
#: ranks of terms that are reported
TOP = 50
#: counts that a task gathers before it hands them on
ENTRIES = 400_000
#: kept terms of a chunk and sources of a block, about
CHUNK = 256
BLOCK = 64
#: rows of a band that are compared with it at once
STEP = 512

_COUNTS = "lang string, source string, term string, n long, docs long"
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: ASCII other than letters separates, all other bytes belong to a term."""
    return text.translate(_LETTERS).split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            # the empty term stands for the group itself
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(n) + 1)), pa.array([source] * (len(n) + 1)), pa.array([*n, b""], pa.binary()).cast(pa.string()), pa.array([*n.values(), 0], pa.int64()), pa.array([*(docs[t] for t in n), 0], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    entries = 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2)):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found, before = words(text.as_py()), len(n)
            n.update(found)
            docs.update(set(found))
            entries += len(n) - before
            if entries >= ENTRIES:
                yield from rows()
                entries = 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs; each group has a row with the empty term and zeros."""
    empty = F.lit("")
    read = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.coalesce("text", empty).cast("binary").alias("text"))
    return read.mapInArrow(_counts, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), exactly."""
    wide = "decimal(38,0)"
    above = (n.cast(wide) + F.lit(5)).cast("decimal(28,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    below = (total.cast(wide) + terms.cast(wide) * F.lit(5)).cast("decimal(28,0)")
    # the quotient of the numbers without the remainder has no fraction
    return F.when(below > 0, F.expr("1L") + F.call_function("div", above.cast(wide), below.cast(wide)).cast("long"))


def in_band(group_n: np.ndarray, lang_n: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Whether fewer than k others dominate each row: group_n not less, lang_n not more, place (distinct) less."""
    order = np.lexsort((place, lang_n, -group_n))
    lang_s, place_s = lang_n[order], place[order]
    keep = np.zeros(len(order), bool)
    band_l, band_p = lang_s[:0], place_s[:0]
    for at in range(0, len(order), STEP):
        l, p = lang_s[at : at + STEP], place_s[at : at + STEP]
        by = np.zeros(len(l), np.int64)
        for b in range(0, len(band_l), 32 * STEP):
            by += ((band_l[None, b : b + 32 * STEP] <= l[:, None]) & (band_p[None, b : b + 32 * STEP] < p[:, None])).sum(1)
        # of the step's own rows, those before in order
        within = (l[None, :] <= l[:, None]) & (p[None, :] < p[:, None])
        by += np.tril(within, -1).sum(1)
        good = by < k
        keep[order[at : at + STEP]] = good
        band_l, band_p = np.concatenate([band_l, l[good]]), np.concatenate([band_p, p[good]])
    return keep


def _band(k: int):
    """Of rows sorted by group, those in the band of their group's rows; one group is held at a time."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        # the same column, by bytes: this is the order of UTF-8
        place = rows["term"].map(str.encode).argsort().argsort().to_numpy()
        return rows[in_band(rows["n"].to_numpy(), rows["lang_n"].to_numpy(), place, k)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, parts = None, []
        for batch in batches:
            for this, rows in batch.groupby(["lang", "source"], sort=False):
                if this != key and parts:
                    yield of(pd.concat(parts))
                    parts = []
                key = this
                parts.append(rows)
                if sum(map(len, parts)) > 8 * STEP and len(parts) > 1:
                    # what the rows so far rule out stays out
                    parts = [of(pd.concat(parts))]
        if parts:
            yield of(pd.concat(parts))

    return run


def skyband(kept: DataFrame, k: int = TOP) -> DataFrame:
    """Rows of lang, source, term, n, lang_n that fewer than k others of their group dominate, and perhaps a few more."""
    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = kept.repartition(parts, "lang", "source", "term").sortWithinPartitions("lang", "source").mapInPandas(_band(k), kept.schema)
    # bands of about the root of all partitions are merged in a task
    salt = F.pmod(F.xxhash64("term"), F.lit(max(1, round(parts**0.5))))
    merged = spread.repartition(parts, F.col("lang"), F.col("source"), salt).sortWithinPartitions("lang", "source")
    return merged.mapInPandas(_band(k), kept.schema)


def _distances(key: tuple, rows: pa.Table) -> pa.Table:
    """Summed distances of the sources of two blocks, over the terms of a chunk that one of them has."""
    lang, _, one, two = (x.as_py() for x in key)
    frame = rows.to_pandas()
    sources = frame[frame["term"] == ""].sort_values("place")
    frame = frame[frame["term"] != ""]
    terms, t = np.unique(frame["term"].to_numpy(), return_inverse=True)
    place = sources["place"].to_numpy()
    shares = np.repeat(sources["floor"].to_numpy()[:, None], len(terms), axis=1)
    shares[np.searchsorted(place, frame["place"].to_numpy()), t] = frame["p"].to_numpy()
    left = np.flatnonzero(sources["block"].to_numpy() == one)
    right = np.flatnonzero(sources["block"].to_numpy() == two)
    a, b, value = [], [], []
    for i in left:
        others = right[place[right] > place[i]]
        a += [place[i]] * len(others)
        b += place[others].tolist()
        value += np.abs(shares[others] - shares[i]).sum(1).tolist()
    n = len(a)
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "value": pa.array(value, pa.int64()), "seen": pa.array([len(terms)] * n, pa.int64())})


def pair_distances(kept: DataFrame, sources: DataFrame) -> DataFrame:
    """lang, source, item and value of every ordered pair of sources of a language.

    ``kept`` has lang, source, term, p; ``sources`` has lang, source, place (from 0 in the language), floor (the share
    of a term that the source lacks) and terms (the language's kept terms).
    """
    placed = sources.withColumn("block", F.expr(f"place div {BLOCK}").cast("int"))
    last = sources.groupBy("lang").agg(F.expr(f"max(place) div {BLOCK}").cast("int").alias("last"))
    rows = left_join_small(kept.select("lang", "source", "term", "p"), placed.join(last, "lang"), ["lang", "source"])
    chunks = F.greatest(F.expr(f"terms div {CHUNK}"), F.lit(1))
    columns = ["lang", "term", "p", "place", "block", "last", "floor", "chunk"]
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("term"), chunks)).select(columns)
    # every source has a row without a term in each chunk, as one that lacks all terms of a chunk still has distances there
    bare = placed.join(last, "lang").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).withColumn("term", F.lit("")).withColumn("p", F.col("floor")).select(columns)
    # a block meets every block of its language: once if there is only one
    meets = F.transform(F.sequence(F.lit(0), F.col("last")), lambda o: F.struct(F.least("block", o).alias("one"), F.greatest("block", o).alias("two")))
    rows = rows.unionByName(bare).withColumn("m", F.explode(meets)).select("*", "m.one", "m.two").drop("m", "last")
    part = rows.groupBy("lang", "chunk", "one", "two").applyInArrow(_distances, "lang string, a int, b int, value long, seen long")
    sums = part.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    one = sources.select("lang", F.col("source").alias("s"), F.col("place").alias("a"), F.col("floor").alias("floor_a"), "terms")
    two = sources.select(F.col("lang").alias("l"), F.col("source").alias("t"), F.col("place").alias("b"), F.col("floor").alias("floor_b"))
    pairs = one.join(two, (F.col("lang") == F.col("l")) & (F.col("a") < F.col("b"))).drop("l").join(sums, ["lang", "a", "b"], "left")
    rest = (F.col("terms") - F.coalesce("seen", F.lit(0))) * F.coalesce(F.abs(F.col("floor_a") - F.col("floor_b")), F.lit(0))
    both = F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"))))
    return pairs.select("lang", (F.coalesce("value", F.lit(0)) + rest).alias("value"), both.alias("x")).select("lang", "x.source", "x.item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank."""
    counts = stored(term_counts(docs), "terms")
    terms = counts.where(F.col("term") != "")
    kept = stored(terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    rows = stored(terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-counts")
    languages = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = counts.where(F.col("term") == "").select("lang", "source").join(rows.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    zero = F.lit(0).cast("long")
    groups = groups.join(languages, "lang", "left").select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"), F.coalesce("lang_total", zero).alias("lang_total"))
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place")
    groups = stored(groups.select("*", place, share(zero, F.col("total"), F.col("terms")).alias("floor")), "groups")
    drop_stored(counts)

    def with_shares(x: DataFrame) -> DataFrame:
        totals = groups.select("lang", "source", "total", F.col("terms").alias("v"), "lang_total")
        return left_join_small(x, totals, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))

    first = with_shares(skyband(rows, top)).withColumn("value", F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("v"))).where(F.col("value") > 0)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    chosen = first.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", rank).where(F.col("rank") <= top)
    pairs = pair_distances(with_shares(rows), groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    return pairs.unionByName(chosen)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS MATERIALIZED (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT d) >= {MIN_DOCS}),
lv AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
g AS MATERIALIZED (SELECT lang, source FROM d GROUP BY ALL),
n AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
  (1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (coalesce(gn.total, 0) + 5 * lv.v))::BIGINT AS p,
  (1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (lv.total + 5 * lv.v))::BIGINT AS q
  FROM g JOIN kept k USING (lang) JOIN lv USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
both_parts AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM every LEFT JOIN pair USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM both_parts
QUALIFY part = 'pair' OR rank <= {TOP}
"""
