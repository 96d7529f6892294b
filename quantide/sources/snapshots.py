"""A bar store with versions: bars and manifest change together, or not at all.

A save writes the bars of the instruments it touches to a folder of its own and a full manifest beside them, in which each
instrument's entry names the save that holds its bars. Neither is read until the commit: a small file that names the manifest
is renamed to the version's number, which is refused if that version exists. So a reader sees the state before a save or the state after it; what
a save that stopped in between has left is never read, and of two savers at once the later one starts over on the new state. Old
versions stay readable until ``forget`` removes them.

The file system must rename atomically and refuse to rename over a file, as HDFS does; on others only one process may save at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantide.params import CacheError
from quantide.schema import BARS, MANIFEST
from quantide.sources.readers import BarStore

_ENTRIES = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in MANIFEST) + ", save string"
_ROWS = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in BARS if f.name != "ticker") + ", save string, interval string, ticker string"


class SnapshotStore(BarStore):
    """``BarStore`` over snapshots; with ``version`` a view of that state, else of the last one at each read."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        super().__init__(spark, root)
        self.version = version

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        """Committed versions; a list of names, one for each save that wasn't forgotten."""
        path, fs = self._path("commits")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []

    def as_of(self, version: int) -> SnapshotStore:
        if version not in self.versions():
            raise CacheError("no such version", version=version)
        return SnapshotStore(self.spark, self.root, version)

    def _entries(self) -> DataFrame:
        last = self.version if self.version is not None else max(self.versions(), default=None)
        if last is None:
            return self.spark.createDataFrame([], _ENTRIES)
        return self.spark.read.schema(_ENTRIES).parquet(f"{self.root}/manifests/{self._state(last)}")

    def _state(self, version: int) -> str:
        """The folder of the version's manifest, which its commit holds."""
        path, fs = self._path(f"commits/{version:020d}")
        stream = fs.open(path)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def manifests(self) -> DataFrame:
        return self._entries().drop("save")

    def _read(self, name: str, schema: str) -> DataFrame:
        if name != "bars":
            return super()._read(name, schema)
        rows = super()._read("data", _ROWS)
        # one row for each instrument: only the folders of its last save are read
        return rows.join(self._entries().select("save", "interval", "ticker"), ["save", "interval", "ticker"], "left_semi").drop("save")

    def write(self, rows: DataFrame, entries: DataFrame, attempts: int = 5) -> int:
        """Commits the instruments of ``rows`` (with interval) and their entries; returns the version. Other savers in between cost an attempt."""
        if self.version is not None:
            raise CacheError("a view of an old version can't be saved to", version=self.version)
        save = uuid.uuid4().hex
        # an instrument with a large share of the rows is split by month
        rows.withColumn("save", F.lit(save)).repartition("ticker", F.date_trunc("month", "ts")).sortWithinPartitions("ticker", "ts").write.mode("append").partitionBy("save", "interval", "ticker").parquet(f"{self.root}/data")
        for _ in range(attempts):
            base = max(self.versions(), default=0)
            held = SnapshotStore(self.spark, self.root, base)._entries() if base else self._entries()
            mine = entries.withColumn("save", F.lit(save)).select(held.columns)
            state = uuid.uuid4().hex
            held.join(mine, ["ticker", "interval"], "left_anti").select(mine.columns).unionByName(mine).write.parquet(f"{self.root}/manifests/{state}")
            if self._commit(base + 1, state):
                return base + 1
        raise CacheError("others kept saving in between", attempts=attempts)

    def _commit(self, version: int, state: str) -> bool:
        """Whether this was the first commit of the version."""
        ready, fs = self._path(f"ready/{state}")
        out = fs.create(ready, False)
        out.writeUTF(state)
        out.close()
        # a rename to a name that exists is refused: the whole file appears at once, or not at all
        target, _ = self._path(f"commits/{version:020d}")
        fs.mkdirs(target.getParent())
        if fs.exists(target):
            return False
        return fs.rename(ready, target)

    def forget(self, keep: int = 1) -> int:
        """Removes all but the last ``keep`` versions and the saves that none of these names; for times without savers. Returns the saves removed."""
        kept = self.versions()[-max(1, keep) :]
        named = {r.save for v in kept for r in SnapshotStore(self.spark, self.root, v)._entries().select("save").distinct().collect()}
        for v in self.versions():
            if v not in kept:
                state, (commit, fs) = self._state(v), self._path(f"commits/{v:020d}")
                fs.delete(commit, False)
                fs.delete(self._path(f"manifests/{state}")[0], True)
        path, fs = self._path("data")
        gone = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("save=") and f.getPath().getName()[5:] not in named]
        for g in gone:
            fs.delete(g, True)
        return len(gone)


def served(store: SnapshotStore, fetch: Callable[[list[str]], DataFrame], tickers: list[str], interval: str) -> DataFrame:
    """Fresh bars where the source has them, else those of the last snapshot, flagged: BARS and stale.

    A source that raises counts as having none. The snapshot's version is fixed for the whole answer.
    """
    versions = store.versions()
    held = (store.as_of(versions[-1]) if versions else store).bars(interval, tickers)
    try:
        fresh = fetch(tickers)
    except Exception:  # noqa: BLE001
        return held.withColumn("stale", F.lit(True))
    got = fresh.select("ticker").distinct()
    return fresh.select(*[c if c in fresh.columns else F.lit(None).alias(c) for c in held.columns]).withColumn("stale", F.lit(False)).unionByName(held.join(got, "ticker", "left_anti").withColumn("stale", F.lit(True)))
