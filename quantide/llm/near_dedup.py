"""Near-duplicate classes by BagMinHash signatures, banding and verified multiset overlap.

A text is the bag of its five-word shingles with their counts as weights. Equal
texts are collapsed first. Each remaining text gets a BagMinHash signature: every
shingle owns Poisson processes over the weight axis, one per dyadic range [0,1),
[1,2), [2,4), ... of discretised (integer) weights. A process' points come in order
of time, each with a random component of the signature and a position in the range;
a text of weight w sees those at positions below w. A component keeps the earliest
point, so two texts agree in it with a probability equal to their weighted Jaccard
similarity. Points are made only up to the time by which all components are filled.

Six components make a band, 42 bands a signature: a pair at 0.8 shares none of
them with probability 3e-6. Of the texts that share a band with another, the
weight of shingles that no other such text has is counted; a text with more than a
fifth of its weight in those can't reach 0.8 with any and is done. Shared weights are
also kept by hash class of the shingle: a pair's overlap is at most the sum of the
smaller of both in each class, and where that is too small for both totals the pair
is none. These bounds are exact. The rest meet so that no group is expanded into all
its pairs and none is cut short: in every bucket the members are compared with the
pivot, the one with the least weight of its own; links join components; buckets whose
members are in one component are done, and in the others the next pivots (see
``PIVOTS``) are compared with the members of other components after them, until no
bucket is left with an uncompared pair of two components. A compared pair goes through the whole signature first (see ``LEAST_AGREEMENT``) and is then
verified on the multisets of both texts; shingles are told apart by 64-bit hashes throughout.

Buckets with many members (see ``PER_CUT``) are cut by member for every join, and their
pivots are found by a tree: the first of each cut, then of ``FAN`` cuts, and so on: no task holds a bucket, or more
than ``FAN`` times the pivots of a round.

Components are found by hooking to smaller neighbours and doubling, each step written
to the shared folder. Nothing of the corpus comes to the driver but counts.

Defined results: a null text counts as empty; equal texts, empty ones too, are one
class; words are runs of non-space characters (ASCII spaces); a text of one to four
words is one shingle of all of them; a text without words has no near copies; rows are
judged by their texts: equal texts are in one class, and rows that share an id are so only if
their texts are equal or near; the class id is its smallest id, where that stands for one text only,
or else for that of its texts with the smallest digest; a class without such an id has a hash above
2**62; ``keep_one`` keeps of equal texts that with the smallest id, and one of rows equal in id and text; an empty
table gives an empty result; extra columns, whatever their names, are kept by
``keep_one`` and left alone by ``classes``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantide.llm.common import drop_stored, fresh, left_join_small, stored, table

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 42, 6
COMPONENTS = BANDS * ROWS
#: members of a bucket that are compared with the others in the first, second and each later round
PIVOTS = (1, 32, 1024)
#: members of a bucket that are joined as one
PER_CUT = 256
#: cuts, or groups of cuts, whose first members are put together
FAN = 16
#: hash classes by which shared weights bound a pair's overlap
PARTS = 64
#: of the components: nearly five standard deviations below what a pair at the threshold has (lost with probability 1e-6)
LEAST_AGREEMENT = 0.68
#: ids that are broadcast to fetch or drop documents; beyond it the documents are shuffled by id
BROADCAST_IDS = 500_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD1B54A32D192ED03)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 64, 16, dtype=np.uint64) | _U(1)
_ROW = _rng.integers(0, 1 << 64, ROWS, dtype=np.uint64) | _U(1)
_BAND = _rng.integers(0, 1 << 64, BANDS, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the SplitMix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b))]) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of all shingles of the texts, ordered by text and hash."""
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(data):
        return none
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    filled = np.flatnonzero(np.diff(off))
    before[off[filled]] = True
    after[off[filled + 1] - 1] = True
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    if not len(start):
        return none
    power, inverse = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
    word = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _STEP)
    first = np.searchsorted(start, off)
    words = np.diff(first)
    shingles = np.where(words >= SHINGLE, words - SHINGLE + 1, (words > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), shingles)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[doc]
    padded = np.concatenate([word, np.zeros(SHINGLE, np.uint64)])
    hashed = np.zeros(len(doc), np.uint64)
    for j in range(SHINGLE):
        there = at + j < first[doc + 1]
        hashed += np.where(there, padded[at + j] * _PLACE[j], _PLACE[8 + j])
    hashed = mix(hashed)
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            hashed[a:b].sort()
    new = np.empty(len(doc), bool)
    new[:1] = True
    new[1:] = (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashed[at], np.diff(np.append(at, len(doc)))


def signatures(n: int, doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """The (n, m) times of the earliest points; infinite for texts without shingles."""
    out = np.full((n, m), np.inf)
    total = np.bincount(doc, count, minlength=n)
    until = np.zeros(n)
    until[total > 0] = m * (np.log(m) + 4) / total[total > 0]
    # a row for each dyadic range that a shingle's weight reaches into
    ranges = 1 + np.ceil(np.log2(count)).astype(np.int64)
    row = np.repeat(np.arange(len(doc)), ranges)
    level = np.arange(len(row)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    seed = mix(shingle[row] + level.astype(np.uint64) * _STEP)
    rows = {"doc": doc[row], "seed": seed, "low": low.astype(np.uint64), "width": width.astype(np.uint64), "count": count[row].astype(np.uint64)}
    todo = total > 0
    while todo.any():
        size = np.full(n, -1)
        size[todo] = np.clip(np.ceil(np.log2(until[todo])), 0, 6)
        for s in np.unique(size[todo]):
            pick = np.flatnonzero(size[rows["doc"]] == s)
            step = max(1, (1 << 20) >> int(s))
            for a in range(0, len(pick), step):
                _points(out, {k: v[pick[a : a + step]] for k, v in rows.items()}, until, 1 << int(s))
        todo = todo & np.isinf(out).any(axis=1)
        until[todo] *= 2
    return out


def _points(out: np.ndarray, r: dict[str, np.ndarray], until: np.ndarray, k: int) -> None:
    m = out.shape[1]
    flat = out.reshape(-1)
    time, at = np.zeros(len(r["doc"])), 0
    while len(time):
        number = np.arange(at, at + k, dtype=np.uint64) * _BASE
        point = mix(r["seed"][:, None] + number[None, :])
        gap = -np.log(((point >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / r["width"][:, None]
        gap[:, 0] += time
        when = np.cumsum(gap, axis=1)
        other = mix(point + _STEP)
        place = r["low"][:, None] + (((other & _U(0xFFFFFFFF)) * r["width"][:, None]) >> _U(32))
        seen = (when <= until[r["doc"]][:, None]) & (place < r["count"][:, None])
        i, j = np.nonzero(seen)
        component = ((other[i, j] >> _U(32)) * _U(m)) >> _U(32)
        np.minimum.at(flat, r["doc"][i] * m + component.astype(np.int64), when[i, j])
        going = when[:, -1] <= until[r["doc"]]
        time, at = when[going, -1], at + k
        r = {key: v[going] for key, v in r.items()}


def sketch(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bands (n, BANDS), one byte per component (n, COMPONENTS), and which texts have shingles."""
    sig = signatures(len(texts), *bags(texts))
    some = ~np.isinf(sig[:, 0])
    bits = sig.view(np.uint64)
    bands = mix((bits.reshape(len(texts), BANDS, ROWS) * _ROW).sum(axis=2, dtype=np.uint64) + _BAND)
    return bands.view(np.int64), (mix(bits) & _U(255)).astype(np.uint8), some


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - shared
    return shared / either if either else 0.0


def _chunks(values: list, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    at, now, size = 0, [], 0
    for k, v in enumerate(values):
        data = (v or "").encode()
        if now and size + len(data) > most:
            yield at, now
            at, now, size = k, [], 0
        now.append(data)
        size += len(data)
    if now:
        yield at, now


def _sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, digest (128 bits of the text's SHA-256), bands (empty without shingles) and sig of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _chunks(batch.column(1).to_pylist()):
                bands, sig, some = sketch(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array([hashlib.sha256(t).digest()[:16] for t in texts], pa.binary()),
                        pa.array([b if s else [] for b, s in zip(bands.tolist(), some, strict=True)], pa.list_(pa.int64())),
                        pa.array([b.tobytes() for b in sig], pa.binary()),
                    ],
                    names=["id", "digest", "bands", "sig"],
                )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, digest binary, bands array<long>, sig binary")


def _filtered(signed: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, and two signatures) that agree in enough components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, COMPONENTS) for k in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= least) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return signed.mapInArrow(run, "a long, b long")


def _agreeing(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b), a > b, whose signatures agree in enough components."""
    a, b = reps.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), reps.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    return _filtered(pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b"), least)


def _few(ids: DataFrame, limit: int = BROADCAST_IDS) -> bool:
    return ids.limit(limit + 1).count() <= limit


def _texts(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """node and text of each of the nodes (node, digest, rep: the id that stands for the text, if any)."""
    source = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", _digest(F.col("text")))
    few = F.broadcast(nodes) if _few(nodes) else nodes
    found = source.join(few, "digest").where("id <=> rep").select("node", "text")
    return stored(found.dropDuplicates(["node"]), "texts")


def _shared_weights(texts: DataFrame) -> DataFrame:
    """node, weight (all shingles), shared (those that some other node has too) and parts (shared, by PARTS hash classes).

    Hot shingles are combined before the shuffle, and the join back may split them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            for at, some in _chunks(batch.column(1).to_pylist()):
                doc, shingle, count = bags(some)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at + doc]), pa.array(shingle.view(np.int64)), pa.array(count.astype(np.int32))], names=["node", "shingle", "n"])

    rows = texts.select("node", "text").mapInArrow(run, "node long, shingle long, n int")
    held = rows.groupBy("shingle").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("shingle")
    weight = rows.groupBy("node").agg(F.sum("n").alias("weight"))
    parts = rows.join(held, "shingle").groupBy("node", F.pmod("shingle", F.lit(PARTS)).cast("int").alias("part")).agg(F.sum("n").cast("int").alias("n"))
    shared = parts.groupBy("node").agg(F.sum("n").alias("shared"), F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("m"))
    each = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)))
    return weight.join(shared, "node").select("node", "weight", "shared", each.alias("parts"))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose texts' shingle multisets overlap enough."""
    j = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    j = j.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep: list[bool] = []
            both = [t for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True) for t in (x, y)]
            for k in range(0, len(both), 128):
                some = [t.encode() for t in both[k : k + 128]]
                doc, shingle, count = bags(some)
                at = np.searchsorted(doc, np.arange(len(some) + 1))
                bag = [(shingle[at[i] : at[i + 1]], count[at[i] : at[i + 1]]) for i in range(len(some))]
                keep += [weighted_jaccard(bag[i], bag[i + 1]) >= threshold - 1e-12 for i in range(0, len(some), 2)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(j.mapInArrow(run, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node that isn't the smallest of its component, from links (a, b).

    Every node hooks to its smallest neighbour below it; hooks are followed to their roots by doubling; links
    are carried over to the roots, where those inside a component vanish. At least half of the nodes with links are
    no roots, so the rounds are logarithmic in the size of a component; stars take one.
    """
    edges = links.where("a <> b").select("a", "b")
    labels: DataFrame | None = None
    while True:
        both = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("comp"))
        hooks = stored(both.groupBy("node").agg(F.min("comp").alias("comp")), "hooks")
        while True:
            above = hooks.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
            if hooks.join(above, "comp", "left_semi").isEmpty():
                break
            jumped = stored(hooks.join(above, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "hooks")
            drop_stored(hooks)
            hooks = jumped
        if labels is None:
            labels = hooks
        else:
            above = hooks.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
            labels = stored(labels.join(above, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")).unionByName(hooks), "labels")
        for side in ("a", "b"):
            edges = edges.join(hooks.select(F.col("node").alias(side), F.col("comp").alias("to")), side, "left").withColumn(side, F.coalesce("to", side)).select("a", "b")
        edges = stored(edges.where("a <> b").distinct(), "edges")
        if edges.isEmpty():
            return labels


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links: the links join components of the earlier labels."""
    if labels is None:
        return components(links)
    for side in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(side), F.col("comp").alias(f"c_{side}")), side, "left").withColumn(side, F.coalesce(f"c_{side}", side)).select("a", "b")
    more = components(links)
    moved = labels.join(more.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return stored(moved.unionByName(more), "labels")


def _digest(text: Column) -> Column:
    """The digest that ``_sketched`` gives, from Spark functions."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def _representatives(sketched: DataFrame) -> DataFrame:
    """digest, rep, node, bands and sig, one row per text.

    ``rep`` is its smallest id, which is also its node; a text without an id, or whose id stands for another text, has a hash as its node.
    """
    reps = sketched.groupBy("digest").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))
    reps = stored(reps, "reps")
    twice = stored(reps.where("rep is not null").groupBy("rep").agg(F.min("digest").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("rep", "first"), "twice")
    hashed = F.shiftrightunsigned(F.xxhash64("digest"), 2) + F.lit(1 << 62)
    if twice.isEmpty():
        return reps.select("digest", "rep", F.coalesce("rep", hashed).alias("node"), "bands", "sig")
    named = left_join_small(reps, twice, ["rep"])
    own = F.col("rep").isNotNull() & F.coalesce(F.col("first") == F.col("digest"), F.lit(True))
    return stored(named.select("digest", "rep", F.when(own, F.col("rep")).otherwise(hashed).alias("node"), "bands", "sig"), "reps")


def _cuts(df: DataFrame) -> DataFrame:
    """One row for each cut of the row's bucket."""
    return df.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))


def _members(buckets: DataFrame) -> DataFrame:
    """(bucket, node, cut, cuts) of the buckets with several nodes."""
    met = buckets.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y").select("bucket", "n")
    met, per = stored(met, "met"), PER_CUT
    # so that the buckets to be cut are few enough to be broadcast
    while not _few(met.where(F.col("n") > per)):
        per *= 8
    large = F.broadcast(met.where(F.col("n") > per).select("bucket", F.ceil(F.col("n") / per).cast("int").alias("cuts")))
    of_bucket = lambda df: df.join(large, "bucket", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    members = of_bucket(buckets).withColumn("cut", F.pmod(F.hash("node"), F.col("cuts")).cast("int"))
    return stored(members.join(_cuts(of_bucket(met)).select("bucket", "cut"), ["bucket", "cut"]), "members")


def _mixed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The members (bucket, node, ...) of buckets with more than one component, with their component (comp)."""
    if labels is None:
        rows = members.withColumn("comp", F.col("node"))
    else:
        rows = members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = rows.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("cuts").alias("cuts")).where("x < y")
    return stored(rows.join(_cuts(several).select("bucket", "cut"), ["bucket", "cut"]), "members")


def _pivots(members: DataFrame, most: int) -> DataFrame:
    """The first members of each bucket by place; in buckets that are cut, first of each cut, then of ``FAN`` of those, up to the bucket."""

    def first(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("place", "node")
        return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")

    width = members.agg(F.max("cuts")).first()[0] or 1
    of_cuts = first(members.where("cuts > 1"), "bucket", "cut")
    while width > FAN:
        width = -(-width // FAN)
        of_cuts = first(of_cuts.withColumn("cut", F.expr(f"cut div {FAN}").cast("int")), "bucket", "cut")
    found = first(members.where("cuts = 1").unionByName(of_cuts), "bucket")
    return stored(found.select("bucket", "cuts", *[F.col(c).alias(f"p_{c}") for c in ("node", "comp", "place", "weight", "shared", "parts")]), "pivots")


def _classified(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """id, digest and comp (its class) of each row, and whether it is what the class keeps (or equal to that in id and text)."""
    sketched = stored(_sketched(docs, key, text), "sketches")
    reps = _representatives(sketched)
    members = _members(reps.select("node", F.explode("bands").alias("bucket")))
    nodes = stored(reps.select("node", "digest", "rep").join(members.select("node").distinct(), "node"), "nodes")
    texts = _texts(docs, nodes, key, text)
    weights = stored(_shared_weights(texts).where(F.col("shared") >= threshold * F.col("weight") - 1e-9), "weights")
    signed = stored(reps.select("node", "sig").join(weights.select("node"), "node"), "signed")
    place = F.round(1e6 * (1 - F.col("shared") / F.col("weight"))).cast("int")
    members = members.join(weights, "node").withColumn("place", place)
    labels: DataFrame | None = None
    compared: DataFrame | None = None
    step = 0
    while True:
        members = _mixed(members, labels)
        if members.isEmpty():
            break
        pivots = _pivots(members, PIVOTS[min(step, len(PIVOTS) - 1)])
        step += 1
        # a pivot meets those after it: the ones before it have been pivots with it or earlier
        after = (F.col("place") > F.col("p_place")) | (F.col("place") == F.col("p_place")) & (F.col("node") > F.col("p_node"))
        # no overlap exceeds what either has in common with others
        least = threshold / (1 + threshold) * (F.col("weight") + F.col("p_weight")) - 1e-9
        overlap = F.aggregate(F.zip_with("parts", "p_parts", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
        possible = (F.least("shared", "p_shared") >= least) & (overlap >= least)
        pairs = members.join(_cuts(pivots).drop("cuts"), ["bucket", "cut"]).where((F.col("comp") != F.col("p_comp")) & after & possible)
        pairs = pairs.select(F.greatest("node", "p_node").alias("a"), F.least("node", "p_node").alias("b")).distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if not pairs.isEmpty():
            agreed = stored(_agreeing(pairs, signed, LEAST_AGREEMENT), "agreed")
            links = _verified(agreed, texts, threshold)
            if not links.isEmpty():
                labels = _relabelled(labels, links)
            compared = pairs if compared is None else compared.unionByName(pairs)
        done = pivots.select("bucket", F.col("p_node").alias("node"))
        members = members.drop("comp").join(done, ["bucket", "node"], "left_anti")
    out = sketched.select("id", "digest").join(reps.select("digest", "rep", "node"), "digest")
    if labels is not None:
        out = out.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    else:
        out = out.withColumn("comp", F.col("node"))
    kept = (F.col("node") == F.col("comp")) & F.col("id").eqNullSafe(F.col("rep"))
    return out.select("id", "digest", "comp", kept.alias("kept"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of the input: its id (named as the key) and class_id."""
    kind = dict(docs.select(key).dtypes)[key]
    return _classified(docs, key, text, threshold).select(F.col("id").cast(kind).alias(key), F.col("comp").alias("class_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with one of each class kept. All columns stay as they were."""
    found = stored(_classified(docs, key, text, threshold).select("id", "digest", "kept"), "classes")
    mine = [fresh(f"_{c}", docs.columns) for c in ("id", "digest")]
    theirs = [fresh(f"_other_{c}", docs.columns) for c in ("id", "digest")]
    marked = docs.withColumn(mine[0], F.col(key).cast("long")).withColumn(mine[1], _digest(F.col(text)))

    def of(rows: DataFrame, left: DataFrame, how: str) -> DataFrame:
        rows = rows.select(F.col("id").alias(theirs[0]), F.col("digest").alias(theirs[1]))
        on = F.col(mine[0]).eqNullSafe(F.col(theirs[0])) & (F.col(mine[1]) == F.col(theirs[1]))
        return left.join(F.broadcast(rows) if _few(rows) else rows, on, how)

    kept = of(found.where("not kept").select("id", "digest").distinct(), marked, "left_anti")
    # of rows that are equal in id and text one is kept
    again = stored(found.where("kept").groupBy("id", "digest").count().where("count > 1").select("id", "digest"), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = of(again, kept, "left_semi").dropDuplicates(mine)
    return of(again, kept, "left_anti").unionByName(once).select(*docs.columns)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
