"""Exact top-k inner products by best-first search in a forest of M-trees.

Vectors are scaled to integers. They are dealt to trees of a bounded size: each goes
to the nearest of some pivots, whose number grows with the data, and pivots with many
vectors (a hot vector may be a third of all) are split into several trees by row. Each
tree is bulk-loaded into pages of at most ``PAGE`` entries; an entry has its routing
object, its covering radius and its distance to the parent's routing object, all
Euclidean. Over the trees' roots stands an upper M-tree, whose entries' radii cover the
trees; beyond ``PIVOTS`` trees the data are dealt to several such forests by row.

By Cauchy-Schwarz nothing below an entry with object c and radius r scores over
q.c + |q| r; and before q.c is computed, the stored parent distance d bounds it by
q.p + |q| (d + r), with q.p known from the parent: entries failing that bound cost
no computation. A query visits entries in order of their bound, in the upper tree and
then inside a tree:

1. it searches the tree with the highest bound in each forest, which gives a floor, its k-th score there;
2. it takes the other trees whose bound reaches the floor, and searches those.

A search ends when the best page left can't reach the floor, which rises with the k-th
score found; equal bounds are searched, so that ties go to smaller ids. Bounds carry a
slack for rounding; scores are exact integers. Where vectors point everywhere alike,
as random ones do, no bound excludes a tree: then all are searched, page by page.

Queries are a stated set (here ids divisible by 100). They meet trees in packed blocks
of at most about ``BLOCK`` queries, and a tree's pages are sent once per block, so a
hot tree is spread over as many tasks as it has blocks. The driver sees counts and the
pivots, of which there are at most ``PIVOTS``, or ``PIVOT_BYTES`` in all.

Defined results: vectors that are null, empty or hold null or non-finite components
(before or after scaling) take no part; queries meet only vectors of their own length;
rows with the query's id are no candidates, however many; repeated rows are candidates
one by one, equal query rows are asked once; a null id takes no part; vectors longer
than 2**26 after scaling are kept in trees of their own and scored one by one in
unbounded integers, as are such queries; scores beyond 64 bits are set to the nearest
64-bit number; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import io
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantide.llm.common import left_join_small, stored, table

PAGE = 512
#: vectors, and bytes of vectors, to a tree
TREE_ROWS, TREE_BYTES = 16_384, 32 << 20
#: trees' pivots in a forest, and bytes of them
PIVOTS, PIVOT_BYTES = 4_096, 32 << 20
BLOCK = 4_096
SCALE = 1024.0
#: up to this length, partial sums of inner products stay below 2**53 and are exact in double precision
EXACT = float(1 << 26)
_SLACK = 1e-9
_I64 = (-(1 << 63), (1 << 63) - 1)


def _lengths(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((m * m).sum(axis=-1))


def _dot(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of integral rows with a vector, set to the nearest 64-bit number."""
    if not len(m) or max(_lengths(m).max(), _lengths(q)) <= EXACT:
        return (m @ q).astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([min(max(sum(int(x) * y for x, y in zip(row, whole, strict=True)), _I64[0]), _I64[1]) for row in m], np.int64)


def _packed(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def _stack(vecs) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<f8") for v in vecs])


class MTree:
    """Pages over objects: arrays of entries, the ranges of their children, and the objects in page order.

    Entry e has object ``centre[e]``, ``radius[e]``, ``parent[e]`` (distance to the parent's object) and children:
    entries first[e]:last[e], or objects first[e]:last[e] if ``leaf[e]``. An object has a key (an id, or a tree's name), its vector,
    its own covering radius ``cover`` (0 for a vector, a tree's radius for its root) and ``reach``, its distance to its page's object.
    ``wide`` trees hold vectors too long for distances in double precision; they are read as a whole.
    """

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, cover: np.ndarray | None = None, wide: bool = False):
        self.wide = wide
        self.keys, self.vectors, self.cover = keys, vectors, np.zeros(len(keys)) if cover is None else cover
        self.reach = np.zeros(len(keys))
        if wide:
            self.entries = {k: np.zeros(1, t) for k, t in (("centre", int), ("radius", float), ("parent", float), ("leaf", bool), ("first", int), ("last", int))}
        else:
            self._load()
        self.prepare()

    def _load(self) -> None:
        real = self.vectors
        order: list[np.ndarray] = []
        rows: list[dict] = [{}]
        done = 0
        queue = [(0, np.arange(len(self.keys)), None)]
        while queue:
            at, members, parent = queue.pop(0)
            centre = members[int(_lengths(real[members] - real[members].mean(axis=0)).argmin())]
            reach = _lengths(real[members] - real[centre])
            row = {"centre": centre, "radius": (reach + self.cover[members]).max(), "parent": 0.0 if parent is None else float(_lengths(real[centre] - real[parent])), "leaf": len(members) <= PAGE}
            if row["leaf"]:
                row["first"], row["last"] = done, done + len(members)
                done += len(members)
                order.append(members)
                self.reach[members] = reach
            else:
                parts = self._split(members)
                row["first"], row["last"] = len(rows), len(rows) + len(parts)
                queue += [(len(rows) + n, p, centre) for n, p in enumerate(parts)]
                rows += [{} for _ in parts]
            rows[at] = row
        self.entries = {k: np.array([r[k] for r in rows]) for k in ("centre", "radius", "parent", "leaf", "first", "last")}
        placed = np.concatenate(order)
        place = np.empty(len(placed), np.int64)
        place[placed] = np.arange(len(placed))
        self.entries["centre"] = place[self.entries["centre"]]
        self.keys, self.vectors, self.cover, self.reach = (x[placed] for x in (self.keys, self.vectors, self.cover, self.reach))

    def _split(self, members: np.ndarray) -> list[np.ndarray]:
        """Members by the nearest of some routing objects, each the farthest from those chosen before it."""
        real, k = self.vectors, min(PAGE, math.ceil(2 * len(members) / PAGE))
        far, nearest = _lengths(real[members] - real[members[0]]), np.zeros(len(members), np.int64)
        for n in range(1, k):
            d = _lengths(real[members] - real[members[int(far.argmax())]])
            nearest[d < far] = n
            far = np.minimum(far, d)
        parts = [p for n in range(k) if len(p := members[nearest == n])]
        # equal vectors can't be told apart: pages of them are cut by number
        return parts if len(parts) > 1 else np.array_split(members, k)

    def pages(self) -> bytes:
        return _packed(keys=self.keys, vectors=self.vectors, cover=self.cover, reach=self.reach, wide=np.array(self.wide), **self.entries)

    @classmethod
    def of_pages(cls, data: bytes) -> MTree:
        z = _unpacked(data)
        tree = cls.__new__(cls)
        tree.keys, tree.vectors, tree.cover, tree.reach, tree.wide = z["keys"], z["vectors"], z["cover"], z["reach"], bool(z["wide"])
        tree.entries = {k: z[k] for k in ("centre", "radius", "parent", "leaf", "first", "last")}
        tree.prepare()
        return tree

    def prepare(self) -> None:
        """The scale of rounding errors, and how far from a parent's object what children cover may be."""
        e = self.entries
        self.computed = 0  # inner products that searches computed
        self.scale = 0.0 if self.wide else _SLACK * (1 + float(e["radius"].max()) + float(_lengths(self.vectors[e["centre"][0]])))
        self.far = e["parent"] + e["radius"]

    def _root(self, q: np.ndarray) -> tuple[float, float, list[tuple[float, int, float]]]:
        norm = float(_lengths(q))
        slack = self.scale * (1 + norm)
        e = self.entries
        root = float(self.vectors[e["centre"][0]] @ q)
        return norm, slack, [(-(root + norm * e["radius"][0] + slack), 0, root)]

    def _children(self, at: int, product: float, q: np.ndarray, norm: float, slack: float, floor: float) -> Iterator[tuple[float, int, float]]:
        """Heap items of an inner entry's children that may reach the floor."""
        e = self.entries
        a, b = e["first"][at], e["last"][at]
        pick = a + np.flatnonzero(product + norm * self.far[a:b] + slack >= floor)
        products = self.vectors[e["centre"][pick]] @ q
        self.computed += len(pick)
        bounds = products + norm * e["radius"][pick] + slack
        for n in np.flatnonzero(bounds >= floor).tolist():
            yield -float(bounds[n]), int(pick[n]), float(products[n])

    def nearest(self, q: np.ndarray, floor: float = -math.inf) -> Iterator[tuple[float, int]]:
        """(bound, number) of the objects whose cover may hold a score of the floor or more, best bound first."""
        norm, slack, heap = self._root(q)
        found: list[tuple[float, int]] = []
        while heap or found:
            while heap and (not found or heap[0][0] <= found[0][0]):
                top, at, product = heapq.heappop(heap)
                if -top < floor:
                    heap = []
                    break
                if self.entries["leaf"][at]:
                    a, b = self.entries["first"][at], self.entries["last"][at]
                    bounds = self.vectors[a:b] @ q + norm * self.cover[a:b] + slack
                    for n in np.flatnonzero(bounds >= floor).tolist():
                        heapq.heappush(found, (-float(bounds[n]), int(a) + n))
                else:
                    for item in self._children(at, product, q, norm, slack, floor):
                        heapq.heappush(heap, item)
            if found:
                bound, n = heapq.heappop(found)
                yield -bound, n

    def search(self, qid: int, q: np.ndarray, k: int, floor: float = -math.inf) -> list[tuple[int, int]]:
        """The k best (score, id), fewer if there are fewer; those below the floor may be missing."""
        best: list[tuple[int, int]] = []  # of (score, -id), the smallest on top

        def take(scores: np.ndarray, ids: np.ndarray) -> float:
            # the query's own rows, of which there may be many, go first
            good = np.flatnonzero((scores >= floor) & (ids != qid))
            if len(good) > 2 * k:
                # the k best, ties included
                good = good[scores[good] >= np.partition(scores[good], -k)[-k]]
            for score, i in zip(scores[good].tolist(), ids[good].tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
            return max(floor, float(best[0][0])) if len(best) == k else floor

        if self.wide or _lengths(q) > EXACT:
            floor = -math.inf
            take(_dot(self.vectors, q), self.keys)
        else:
            norm, slack, heap = self._root(q)
            while heap and -heap[0][0] >= floor:
                _, at, product = heapq.heappop(heap)
                if self.entries["leaf"][at]:
                    a, b = self.entries["first"][at], self.entries["last"][at]
                    pick = a + np.flatnonzero(product + norm * self.reach[a:b] + slack >= floor)
                    self.computed += len(pick)
                    floor = take((self.vectors[pick] @ q).astype(np.int64), self.keys[pick])
                else:
                    for item in self._children(at, product, q, norm, slack, floor):
                        heapq.heappush(heap, item)
        return [(s, -i) for s, i in sorted(best, key=lambda x: (-x[0], -x[1]))]


def scaled(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """id, dim, wide (too long for exact products in doubles) and vec (little-endian doubles holding integers) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, wide, vecs = [], [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * np.array(v, np.float64))
                if not np.isfinite(x).all():
                    continue
                ids.append(i)
                dims.append(len(x))
                wide.append(bool(_lengths(x) > EXACT))
                vecs.append(x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(wide, pa.bool_()), pa.array(vecs, pa.binary())], names=["id", "dim", "wide", "vec"])

    return vectors.select(F.col(key).cast("long"), F.col(vector)).mapInArrow(run, "id long, dim int, wide boolean, vec binary")


def build(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
    """Trees (tree, pages), the forests' upper trees (dim, forest, upper), and the number of forests, over n scaled rows."""
    longest = rows.agg(F.max("dim").alias("dim")).first()["dim"]
    size = min(TREE_ROWS, max(PAGE, TREE_BYTES // (8 * longest)))
    most = max(1, min(PIVOTS, PIVOT_BYTES // (8 * longest)))
    forests = math.ceil(n / (most * size))
    sample = rows.where("not wide").orderBy(F.xxhash64("id", "row"), "row").limit(min(most, math.ceil(n / size))).select("vec").collect()
    pivots: dict[int, np.ndarray] = {}
    for dim in {len(r.vec) // 8 for r in sample}:
        pivots[dim] = _stack(r.vec for r in sample if len(r.vec) == 8 * dim)

    def near(dims: pd.Series, wide: pd.Series, vecs: pd.Series) -> pd.Series:
        out = np.where(wide, -1, 0)
        for dim in set(dims[~wide]) & set(pivots):
            p = pivots[dim]
            at = np.flatnonzero(((dims == dim) & ~wide).to_numpy())
            for some in np.array_split(at, math.ceil(len(at) / 1024)):
                out[some] = ((p * p).sum(axis=1) - 2 * (_stack(vecs.iloc[some]) @ p.T)).argmin(axis=1)
        return pd.Series(out)

    celled = rows.withColumn("forest", F.pmod(F.xxhash64("row"), F.lit(forests)).cast("int")).withColumn("cell", F.pandas_udf(near, "int")("dim", "wide", "vec"))
    celled = stored(celled, "celled")
    sizes = celled.groupBy("dim", "forest", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    dealt = left_join_small(celled, sizes, ["dim", "forest", "cell"]).withColumn("part", F.pmod(F.hash("row"), F.col("parts")))
    name = F.concat_ws("-", "dim", "forest", "cell", "part").alias("tree")

    def load(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        tree = MTree(group["id"].to_numpy(), _stack(group["vec"]), wide=bool(first["wide"]))
        e = tree.entries
        cover = np.inf if tree.wide else float(e["radius"][0])
        return pd.DataFrame({"tree": [first["tree"]], "dim": [first["dim"]], "forest": [first["forest"]], "pages": [tree.pages()], "centre": [tree.vectors[e["centre"][0]].tobytes()], "cover": [cover]})

    trees = dealt.select(name, "dim", "forest", "wide", "id", "vec").groupBy("tree").applyInPandas(load, "tree string, dim int, forest int, pages binary, centre binary, cover double")
    trees = stored(trees, "trees")

    def over(group: pd.DataFrame) -> pd.DataFrame:
        keys, cover, wide = group["tree"].to_numpy(dtype=str), group["cover"].to_numpy(), np.isinf(group["cover"].to_numpy())
        upper = MTree(keys[~wide], _stack(group["centre"])[~wide], cover[~wide]).pages() if (~wide).any() else b""
        return pd.DataFrame({"dim": [group["dim"].iloc[0]], "forest": [group["forest"].iloc[0]], "upper": [upper], "always": [list(keys[wide])]})

    upper = trees.select("dim", "forest", "tree", "centre", "cover").groupBy("dim", "forest").applyInPandas(over, "dim int, forest int, upper binary, always array<string>")
    return trees.select("tree", "pages"), stored(upper, "upper"), forests


def _blocks(queries: DataFrame, by: list[str]) -> DataFrame:
    """The key columns and queries, a packed block, of each group; groups are of bounded size."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[[0]][by].reset_index(drop=True)
        arrays = {"query": group["query"].to_numpy(), "id": group["id"].to_numpy(), "vec": _stack(group["vec"]), "floor": group["floor"].to_numpy(float), "seen": group["seen"].to_numpy(dtype=str)}
        return first.assign(queries=[_packed(**arrays)])

    kinds = dict(queries.dtypes)
    return queries.select(*by, "query", "id", "vec", "floor", "seen").groupBy(*by).applyInPandas(pack, ", ".join(f"{c} {kinds[c]}" for c in by) + ", queries binary")


def _route(asked: DataFrame, n: int, upper: DataFrame, forests: int, first: bool) -> DataFrame:
    """(tree, query, id, vec, floor, seen): each query's best tree in each forest, or all others that may reach its floor."""
    salts = 32
    blocks = _blocks(asked.withColumn("block", F.pmod("query", F.lit(math.ceil(n / BLOCK)))), ["dim", "block"])
    blocks = blocks.withColumn("forest", F.explode(F.sequence(F.lit(0), F.lit(forests - 1)))).withColumn("salt", F.pmod("block", F.lit(salts)).cast("int"))
    met = blocks.join(upper.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["dim", "forest", "salt"])
    names = ["tree", "query", "id", "vec", "floor", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pages, always, queries in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                tree, z = MTree.of_pages(pages) if pages else None, _unpacked(queries)
                for a in range(0, len(z["query"]), 64):
                    out: list[tuple] = []
                    for query, i, q, floor, seen in zip(*(z[c][a : a + 64] for c in ("query", "id", "vec", "floor", "seen")), strict=True):
                        wide = _lengths(q) > EXACT
                        if first:
                            found = [] if wide or tree is None else [str(tree.keys[m]) for _, m in itertools.islice(tree.nearest(q), 1)]
                        else:
                            inside = [] if tree is None else tree.keys.tolist() if wide else [str(tree.keys[m]) for _, m in tree.nearest(q, floor)]
                            found = [t for t in [*inside, *always] if t not in str(seen).split("|")]
                        out += [(t, int(query), int(i), q.tobytes(), float(floor), str(seen)) for t in found]
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=names)

    return met.select("upper", "always", "queries").mapInArrow(run, "tree string, query long, id long, vec binary, floor double, seen string")


def _search(routed: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """(tree, query, query_id, id, score): the k best of each routed query in its tree."""
    parts = stored(routed.groupBy("tree").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "parts")
    queries = left_join_small(routed, parts, ["tree"]).withColumn("part", F.pmod("query", F.col("parts")).cast("int"))
    pages = trees.join(parts, "tree").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = _blocks(queries, ["tree", "part"]).join(pages, ["tree", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, data, queries = (c[row].as_py() for c in batch.columns)
                tree, z = MTree.of_pages(data), _unpacked(queries)
                out = [(name, int(query), int(i), found, score) for query, i, q, floor in zip(z["query"], z["id"], z["vec"], z["floor"], strict=True) for score, found in tree.search(int(i), q, k, float(floor))]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["tree", "query", "query_id", "id", "score"])

    return met.select("tree", "pages", "queries").mapInArrow(run, "tree string, query long, query_id long, id long, score long")


def top_k(vectors: DataFrame, is_query: str, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, <key> and score of the k best candidates of every row for which the SQL condition ``is_query`` on ``id`` holds."""
    spark = vectors.sparkSession
    rows = stored(scaled(vectors, key, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = stored(rows.where(F.expr(is_query)).select("id", "dim", "vec").distinct().withColumn("query", F.xxhash64("id", "vec")), "asked")
    n = asked.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long").withColumnRenamed("id", key)
    trees, upper, forests = build(rows, rows.count())
    fresh = asked.withColumn("floor", F.lit(float("-inf"))).withColumn("seen", F.lit(""))
    near = stored(_search(stored(_route(fresh, n, upper, forests, True), "routes"), trees, k), "found")
    # a query's floor is its best k-th score of a tree; a tree without candidates for a query can't be told from one not searched, and is searched again
    kth = near.groupBy("query", "tree").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    floors = kth.groupBy("query").agg(F.max(F.when(F.col("n") == k, F.col("kth"))).cast("double").alias("floor"), F.concat_ws("|", F.collect_list("tree")).alias("seen"))
    again = asked.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))).withColumn("seen", F.coalesce("seen", F.lit("")))
    rest = _search(stored(_route(again, n, upper, forests, False), "routes"), trees, k)
    w = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    found = near.unionByName(rest).withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias(key), "score")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "id % 100 = 0")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
