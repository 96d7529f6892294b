"""Exact quantiles and ranks by value blocks, and snapshots, beyond what the queries check."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantide.operators import order_stats
from quantide.params import CacheError
from quantide.sources import sinks
from quantide.sources.snapshots import SnapshotStore


def rows(seed):
    r = random.Random(seed)
    draw = {"hot": lambda: 7.0, "few": lambda: float(r.randint(1, 3)), "wide": lambda: r.gauss(0, 1e6), "one": lambda: 2.5, None: lambda: r.random()}
    out = [(g, None if r.random() < 0.1 else draw[g]()) for g, n in (("hot", 2000), ("few", 700), ("wide", 900), ("one", 1), (None, 50)) for _ in range(n)]
    return [*out, ("empty", None), ("wide", -0.0), ("wide", 0.0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_equal_numpy(spark, seed):
    data, qs = rows(seed), [0.0, 0.01, 0.25, 0.5, 0.987, 1.0]
    got = {r.g: r.q for r in order_stats.quantiles(spark.createDataFrame(data, "g string, value double"), ["g"], qs).collect()}
    for g in {g for g, _ in data}:
        values = [v for x, v in data if x == g and v is not None]
        if values:
            assert np.allclose(got[g], np.quantile(values, qs), rtol=1e-12, atol=1e-9)
        else:
            assert g not in got
    assert order_stats.quantiles(spark.createDataFrame([], "g string, value double"), ["g"], qs).count() == 0


def test_average_ranks_equal_pandas(spark):
    data = rows(3)
    got = order_stats.average_ranks(spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(data)], "i int, g string, value double"), ["g"], "value").toPandas().set_index("i")
    frame = pd.DataFrame(data, columns=["g", "value"])
    want = frame.groupby("g", dropna=False)["value"].rank(method="average", na_option="top")
    assert len(got) == len(data) and np.allclose(got["_rank"].sort_index(), want)
    assert (got["_total"].sort_index() == frame.groupby("g", dropna=False)["value"].transform("size")).all()


def test_no_partition_holds_a_group(spark):
    """A group with nearly all rows lies in several blocks; a value that a third of them share is one row of one."""
    data = spark.range(60_000).selectExpr("if(id % 50 = 0, 'b', 'a') AS g", "if(id % 3 = 0, 5.0D, hash(id) / 7.0D) AS value")
    blocks = order_stats.value_blocks(data, ["g"])
    sizes = Counter({r["_block"]: r["count"] for r in blocks.groupBy("_block").count().collect()})
    assert len(sizes) == 4 and max(sizes.values()) < 0.4 * sum(sizes.values())
    assert blocks.where("value = 5.0 and g = 'a'").count() == 1
    plan = order_stats.quantiles(data, ["g"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan


def bars(spark, n, close=1.0):
    return spark.range(n).selectExpr("if(id % 2 = 0, 'A', 'B') AS ticker", "timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id div 2 as int)) AS ts", f"{close}D AS close")


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    assert store.versions() == [] and store.bars("1d").count() == 0 and store.manifests().count() == 0
    sinks.save_bars(store, bars(spark, 10), "1d", "x", validate=False)
    before = store.as_of(1)
    sinks.save_bars(store, bars(spark, 4, 2.0).where("ticker = 'A'"), "1d", "x", validate=False)
    assert before.bars("1d").count() == 10 and store.bars("1d").count() == 7
    assert {(r.ticker, r.rows) for r in store.manifests().collect()} == {("A", 2), ("B", 5)}
    with pytest.raises(CacheError):
        store.as_of(9)
    with pytest.raises(CacheError):
        sinks.save_bars(before, bars(spark, 4), "1d", "x", validate=False)
    assert store.forget() == 0  # B's bars still lie in the first save
    assert store.versions() == [2] and store.bars("1d").count() == 7
    sinks.save_bars(store, bars(spark, 2), "1d", "x", validate=False)
    assert store.forget() == 2 and store.bars("1d").count() == 2


def test_two_savers(spark, tmp_path):
    """Another save comes between a save's look at the state and its commit: neither is lost."""

    class Overtaken(SnapshotStore):
        def _commit(self, version, state):
            if version == 2 and not self.others:
                self.others.append(1)
                sinks.save_bars(SnapshotStore(self.spark, self.root), bars(self.spark, 6, 3.0).where("ticker = 'B'"), "1d", "other", validate=False)
            return super()._commit(version, state)

    store = Overtaken(spark, str(tmp_path))
    store.others = []
    sinks.save_bars(store, bars(spark, 4), "1d", "x", validate=False)
    sinks.save_bars(store, bars(spark, 8, 2.0).where("ticker = 'A'"), "1d", "mine", validate=False)
    assert store.versions() == [1, 2, 3]
    assert {(r.ticker, r.source, r.rows) for r in store.manifests().collect()} == {("A", "mine", 4), ("B", "other", 3)}
    assert store.bars("1d").agg(F.sum("close")).first()[0] == 4 * 2.0 + 3 * 3.0


def test_supervision_gives_up_and_stops(spark, tmp_path):
    import threading

    from quantide.streaming import bars as S

    src = str(tmp_path / "in")
    spark.range(5).write.parquet(src)

    def start(sink, name):
        return lambda: spark.readStream.schema("id long").parquet(src).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / name)).start()

    def broken(batch, number):
        raise ConnectionError("gone")

    waits = []
    with pytest.raises(Exception, match="gone"):
        S.supervised(start(broken, "a"), attempts=3, wait=1, sleep=waits.append)
    assert waits == [1, 2]
    # an endless query ends cleanly when it is told to
    stop = threading.Event()
    assert S.supervised(start(lambda batch, number: stop.set(), "b"), stop=stop) == []
    assert not [q for q in spark.streams.active if q.name == "b"]


def test_quantiles_of_clipped_values_in_the_same_pass(spark):
    data = [*rows(5), *[("pair", v) for v in (1.0, 4.0)], *[("three", v) for v in (-2.0, 0.5, 9.0)]]
    inner = [0.25, 0.5, 0.75]
    got = {r.g: r.q for r in order_stats.quantiles(spark.createDataFrame(data, "g string, value double"), ["g"], [0.01, 0.99], clipped=inner).collect()}
    for g in {g for g, v in data if v is not None}:
        values = [v for x, v in data if x == g and v is not None]
        lo, hi = np.quantile(values, [0.01, 0.99])
        assert np.allclose(got[g], [lo, hi, *np.quantile(np.clip(values, lo, hi), inner)], rtol=1e-12, atol=1e-9)


def test_average_ranks_of_counted_values(spark):
    data = rows(6)
    frame = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(data)], "i int, g string, value double")
    # counted in two halves, which are put together
    counted = frame.groupBy("g", "value", (F.col("i") % 2).alias("half")).agg(F.count(F.lit(1)).alias("n")).drop("half")
    read = lambda df: sorted((r.i, r["_rank"], r["_total"]) for r in df.collect())
    assert read(order_stats.average_ranks(frame, ["g"], "value", counted)) == read(order_stats.average_ranks(frame, ["g"], "value"))
