"""Queries over snapshots, restarts, corrections and isolated failures."""

from __future__ import annotations

import time
import uuid
import zlib
from datetime import date, datetime

from pyspark.sql import functions as F

from quantide.functions.shared import written
from quantide.operators import kpi, sanitize
from quantide.plans import inputs as I
from quantide.plans.data_queries import SQL as SQL_OF, _sides
from quantide.plans.metric_queries import _BAR_COLUMNS, rounded
from quantide.sources import quotes, sinks
from quantide.sources.snapshots import SnapshotStore, served
from quantide.streaming import bars as S, replay

QUERIES: dict = {}
SQL: dict[str, str] = {}
_COLS = ("ticker", "ts", "open", "high", "low", "close", "volume")
_ALL = f"WITH {I.DENSE} SELECT {_BAR_COLUMNS} FROM bars"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _folder(s, name):
    return S.state_folder(s, f"{name}-{uuid.uuid4().hex}")


def _checkpoints(s):
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(s.sparkContext.getConf().get("spark.checkpoint.dir") or _folder(s, "checkpoints"))


class Stopped(Exception):
    """What the queries below raise in the middle of a save."""


class _Halting(SnapshotStore):
    """Stops between the bars and the commit."""

    def _commit(self, version, state):
        raise Stopped


# -- snapshots ------------------------------------------------------------------------------


@query("snapshot_as_of", f"WITH {I.DENSE} SELECT v.version, ticker, count(*) AS n, round(sum(\"close\"), 6) AS total FROM bars JOIN (VALUES (1, TIMESTAMP '2024-01-12'), (2, TIMESTAMP '2024-01-20'), (3, TIMESTAMP '2099-01-01')) v(version, upto) ON ts < upto GROUP BY ALL")
def _as_of(s, d):
    """Three saves, each read as of its version."""
    store, rows = SnapshotStore(s, _folder(s, "snapshots")), written(I.dense(s, d), "bars")
    for upto in ("2024-01-12", "2024-01-20", "2099-01-01"):
        sinks.save_bars(store, rows.where(F.col("ts") < F.to_timestamp(F.lit(upto))), "1d", "test")
    views = [store.as_of(v).bars("1d").withColumn("version", F.lit(v)) for v in store.versions()]
    return views[0].union(views[1]).union(views[2]).groupBy("version", "ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("total"))


@query("snapshot_interrupted", f"{_ALL} WHERE ts < TIMESTAMP '2024-01-12'")
def _interrupted(s, d):
    """A save that stops between bars and manifest leaves the old state, for both; what it left is cleared away."""
    path, rows = _folder(s, "snapshots"), written(I.dense(s, d), "bars")
    sinks.save_bars(SnapshotStore(s, path), rows.where("ts < timestamp'2024-01-12'"), "1d", "test")
    try:
        sinks.save_bars(_Halting(s, path), rows, "1d", "test")
        raise AssertionError("the save wasn't stopped")
    except Stopped:
        pass
    store = SnapshotStore(s, path)
    assert store.versions() == [1] and store.manifests().agg(F.max("end")).first()[0].day == 11
    assert store.forget() == 1
    return store.bars("1d").select(*_COLS)


@query("snapshot_touched", f"{_ALL} WHERE ticker <> 'click' OR ts >= TIMESTAMP '2024-01-15'")
def _touched(s, d):
    """A save replaces the instruments it holds and leaves the others."""
    store, rows = SnapshotStore(s, _folder(s, "snapshots")), written(I.dense(s, d), "bars")
    sinks.save_bars(store, rows, "1d", "test")
    sinks.save_bars(store, rows.where("ticker = 'click' and ts >= timestamp'2024-01-15'"), "1d", "test")
    return store.bars("1d").select(*_COLS)


@query("snapshot_stale", f"WITH {I.DENSE} SELECT ticker, count(*) AS n, ticker NOT IN ('click', 'view') AS stale FROM bars WHERE ticker IN ('click', 'view') OR ts < TIMESTAMP '2024-01-12' GROUP BY ticker")
def _stale(s, d):
    """A source that has two instruments left: the others come from the last snapshot, flagged; one that is gone leaves the snapshot alone."""
    store, rows = SnapshotStore(s, _folder(s, "snapshots")), written(I.dense(s, d), "bars")
    names = ["click", "view", "purchase", "error", "signup"]
    sinks.save_bars(store, rows.where("ts < timestamp'2024-01-12'"), "1d", "test")

    def gone(_):
        raise ConnectionError

    whole = served(store, gone, names, "1d")
    assert whole.where("not stale").isEmpty() and whole.count() == store.bars("1d").count()
    return served(store, lambda some: rows.where(F.col("ticker").isin("click", "view")), names, "1d").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.first("stale").alias("stale"))


# -- streams --------------------------------------------------------------------------------


def _tick_files(s, d, files=4):
    """The events by time in some files: (folder of all, folders of each)."""
    path, ticks = _folder(s, "ticks"), I.read(s, d, "events").withColumnRenamed("event_type", "ticker")
    schema = ", ".join(f"{c} {t}" for c, t in ticks.dtypes)
    day = F.dayofmonth("ts")
    for k in range(files):
        ticks.where((day > 31 * k / files) & (day <= 31 * (k + 1) / files)).coalesce(1).write.mode("append").parquet(f"{path}/part={k}")
    return path, schema


def _stream_of(s, path, schema):
    return S.tick_stream(s, path, f"{schema}, part int").drop("part")


@query("stream_bars_restarted", f"{_ALL} WHERE ts + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def _restarted(s, d):
    """Closed bars in files: stopped after half of the ticks, then started again on the checkpoint; bars that the watermark hasn't passed are still open."""
    path, schema = _tick_files(s, d)
    out, state = _folder(s, "bars"), _folder(s, "state")
    S.to_files(S.streaming_bars(_stream_of(s, f"{path}/part={{0,1}}", schema.replace(", part int", ""))), out, state).awaitTermination()
    S.to_files(S.streaming_bars(_stream_of(s, f"{path}/part=*", schema)), out, state).awaitTermination()
    return s.read.parquet(out).select(*_COLS)


_FIXED = "CASE WHEN day(ts) BETWEEN 5 AND 14 THEN -\"close\" ELSE \"close\" END"


@query("stream_corrections", f"WITH {I.DENSE} SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round({_FIXED}, 6) AS \"close\" FROM bars WHERE ts <= (SELECT max(ts) FROM bars) - INTERVAL 12 DAY")
def _corrections(s, d):
    """A later file corrects bars of an earlier one; the newest version of each bar comes out once the watermark has passed it."""
    path = _folder(s, "versions")
    rows = written(I.dense(s, d).select("ticker", F.col("ts").cast("timestamp").alias("ts"), "close"), "bars")
    first, again = rows.where("day(ts) < 15").withColumn("arrival", F.lit(1)), rows.where("day(ts) between 5 and 14").select("ticker", "ts", (-F.col("close")).alias("close")).withColumn("arrival", F.lit(2))
    first.coalesce(1).write.mode("append").parquet(path)
    schema, out, state = "ticker string, ts timestamp, close double, arrival int", _folder(s, "newest"), _folder(s, "state")
    run = lambda: S.to_files(S.newest_versions(s.readStream.schema(schema).parquet(path), "12 days", "arrival"), out, state).awaitTermination()
    run()
    again.unionByName(rows.where("day(ts) >= 15").withColumn("arrival", F.lit(1))).coalesce(1).write.mode("append").parquet(path)
    run()
    return s.read.parquet(out).select("ticker", "ts", "close")


@query("stream_supervised", _ALL)
def _supervised(s, d):
    """A sink that fails twice, before and after it has written: started again from the checkpoint, no row is lost or repeated."""
    _checkpoints(s)
    path, schema = _tick_files(s, d, 3)
    out, state, failed = _folder(s, "rows"), _folder(s, "state"), []

    def sink(batch, number):
        if number == 1 and len(failed) == 0:
            failed.append("before")
            raise ConnectionError("before")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == 1 and len(failed) == 1:
            failed.append("after")
            raise ConnectionError("after")

    def start():
        ticks = s.readStream.schema(f"{schema}, part int").option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
        return ticks.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()

    waits: list[float] = []
    survived = S.supervised(start, attempts=4, wait=0.01, sleep=lambda x: (waits.append(x), time.sleep(x)))
    assert len(survived) == 2 and waits[1] > 0
    from quantide.operators import bars as B

    return B.from_ticks(s.read.parquet(out).drop("batch"), B.day(), "ticker").select(*_COLS)


@query("stream_isolated", f"{_ALL.replace('SELECT', 'SELECT', 1)} WHERE ticker <> 'view' OR ts < TIMESTAMP '2024-01-12'")
def _isolated(s, d):
    """One instrument's new bars break a rule: the others are saved, and it keeps what it had; its rows wait with the rules broken."""
    store, retries = _isolation(s, d)
    return store.bars("1d").select(*_COLS)


@query("stream_isolated_retried", _ALL)
def _retried(s, d):
    """The same, then mended: nothing is missing."""
    store, retries = _isolation(s, d)
    left = S.retried(store, "1d", retries, lambda rows: rows.withColumn("close", F.abs(F.nullif(F.col("close"), F.lit(float("nan"))))).where("close is not null"))
    assert left.isEmpty()
    return store.bars("1d").select(*_COLS)


def _isolation(s, d):
    _checkpoints(s)
    store, src, retries = SnapshotStore(s, _folder(s, "snapshots")), _folder(s, "bars"), _folder(s, "retries")
    rows = written(I.dense(s, d).withColumn("ts", F.col("ts").cast("timestamp")).select(*_COLS), "bars")
    sinks.save_bars(store, rows.where("ts < timestamp'2024-01-12'"), "1d", "test")
    new = rows.where("ts >= timestamp'2024-01-12'")
    # a second bar of each stamp, without a price
    broken = new.where("ticker = 'view'").withColumn("close", F.lit(None).cast("double"))
    new.unionByName(broken).coalesce(1).write.parquet(src)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    S.isolated_upsert(s.readStream.schema(schema).parquet(src), store, "1d", _folder(s, "state"), retries).awaitTermination()
    found = s.read.parquet(retries).select("ticker", F.explode("rules").alias("rule")).distinct().collect()
    assert {tuple(r) for r in found} == {("view", "duplicate_timestamps"), ("view", "null_values")}
    return store, retries


@query("stream_durations", "SELECT kind, sum(n)::BIGINT AS n FROM (SELECT 'finished' AS kind, 2 AS n UNION ALL SELECT 'failed', 1 UNION ALL SELECT 'rows', 2 * count(*) FROM events) GROUP BY kind")
def _durations(s, d):
    """Two runs that end and one that fails, told by outcome, with the rows read."""
    path, schema = _tick_files(s, d, 1)
    seen = S.RefreshDurations()
    s.streams.addListener(seen)
    try:
        for fails in (False, False, True):
            ticks = s.readStream.schema(schema).parquet(f"{path}/part=0")

            def sink(batch, _, fails=fails):
                if fails:
                    raise ConnectionError
                batch.write.format("noop").mode("overwrite").save()

            try:
                ticks.writeStream.foreachBatch(sink).option("checkpointLocation", _folder(s, "state")).trigger(availableNow=True).start().awaitTermination()
            except Exception:  # noqa: BLE001
                assert fails
        for _ in range(100):
            if sum(seen.outcomes.values()) == 3:
                break
            time.sleep(0.1)
    finally:
        s.streams.removeListener(seen)
    runs = seen.table(s).where("kind = 'run'").select(F.col("name").alias("kind"), "n")
    assert seen.table(s).where("kind = 'batch'").agg(F.sum("n")).first()[0] == seen.counts["batches"] >= 2
    return runs.union(s.createDataFrame([("rows", seen.counts["rows"])], "kind string, n long"))


@query("stream_replayed", SQL_OF["annotations_conflicts"])
def _replayed(s, d):
    """Offline changes in the client's order, cut into three batches with a restart: the outcomes are those of one replay."""
    server, pending = _sides(s, d)
    path, out, state = _folder(s, "changes"), _folder(s, "outcomes"), _folder(s, "state")
    rows = written(pending.select("ticker", "note", F.col("client_timestamp").cast("timestamp").alias("client_timestamp")), "pending")
    first, last = rows.agg(F.unix_timestamp(F.min("client_timestamp")), F.unix_timestamp(F.max("client_timestamp"))).first()
    third = (F.unix_timestamp("client_timestamp") - first) * 3 / max(1, last - first + 1)
    for k in range(3):
        rows.where(F.floor(third) == k).coalesce(1).write.mode("append").parquet(path)
        if k:
            changes = s.readStream.schema("ticker string, note string, client_timestamp timestamp").option("maxFilesPerTrigger", 1).parquet(path)
            S.to_files(replay.replayed(changes, server), out, state).awaitTermination()
    return s.read.parquet(out).select("ticker", "note", "client_timestamp", "outcome")


# -- fetching -------------------------------------------------------------------------------


#: instruments of a file of quotes, on average
_IN_FILE = 160


def _file_of(ticker, files):
    return zlib.crc32((ticker or "").encode()) % files


class QuoteFiles:
    """A source over JSON files of quotes, dealt by the instrument's hash, that notes each time it is asked; ``broken`` names fail."""

    def __init__(self, path, files, notes, broken=()):
        self.path, self.files, self.notes, self.broken = path, files, notes, broken

    def quotes(self, tickers, start, end, interval):
        import json

        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(self.path)
        notes, folder = fs.FileSystem.from_uri(self.notes)
        with notes.open_output_stream(f"{folder}/{uuid.uuid4().hex}.json") as out:
            out.write("\n".join(json.dumps({"ticker": t, "asked": len(tickers)}) for t in tickers).encode())
        if set(tickers) & set(self.broken):
            raise ConnectionError("unreachable")
        asked = set(tickers)
        for k in sorted({_file_of(t, self.files) for t in asked}):
            for found in where.get_file_info(fs.FileSelector(f"{root}/file={k}", allow_not_found=True)):
                if found.base_name.endswith(".json"):
                    with where.open_input_stream(found.path) as lines:
                        for line in lines.readall().splitlines():
                            q = json.loads(line)
                            if q.get("ticker") in asked:
                                at = datetime.fromisoformat(q["ts"])
                                if start <= at.date() < end:
                                    yield q.get("ticker"), at, q.get("open"), q.get("high"), q.get("low"), q.get("close"), None, q["volume"]


def _quotes(s, d, rows, names, broken=(), batch=40):
    path, notes = _folder(s, "quotes"), _folder(s, "asked")
    files = max(1, -(-len(names) // _IN_FILE))
    rows = rows.select("ticker", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "open", "high", "low", "close", "volume", F.pmod(F.crc32(F.coalesce("ticker", F.lit(""))), F.lit(files)).alias("file"))
    # a given number of partitions, which is not lowered by their bytes: opening files takes the time
    rows.repartition(min(files, int(s.conf.get("spark.sql.shuffle.partitions"))), "file").write.partitionBy("file").json(path)
    uri = lambda x: x if ":" in x else f"file://{x}"
    s.createDataFrame([("x",)], "ticker string").write.json(notes)
    asking = quotes.Asking(QuoteFiles(uri(path), files, uri(notes), broken), date(2024, 1, 1), date(2024, 2, 1), "1d", attempts=2, wait=0.01)
    # a batch's instruments lie in one or two files
    names = sorted(names, key=lambda t: _file_of(t, files))
    return quotes.fetch_quotes(s, asking, names, batch), s.read.schema("ticker string, asked int").json(notes).where("asked is not null")


@query("quotes_scanned", f"WITH {I.SPARSE}, b AS (SELECT {_BAR_COLUMNS} FROM bars) SELECT b.*, 1::BIGINT AS asked FROM b")
def _scanned(s, d):
    """All instruments by one scan, a partition for each batch; the source sees each of them once."""
    rows = written(I.sparse(s, d), "bars")
    names = [r.ticker for r in rows.select("ticker").distinct().collect()]
    got, asked = _quotes(s, d, rows, names)
    return got.bars.select(*_COLS).join(asked.groupBy("ticker").agg(F.count(F.lit(1)).alias("asked")), "ticker")


@query("quotes_failures", f"WITH {I.DENSE} SELECT ticker, count(*) AS n, '' AS reason FROM bars WHERE ticker <> 'view' GROUP BY ticker UNION ALL SELECT * FROM (VALUES ('view', 0, 'ConnectionError: unreachable'), ('nothing', 0, 'no data'))")
def _quote_failures(s, d):
    """A batch with a broken instrument is asked for one by one; what fails comes out as a row."""
    got, _ = _quotes(s, d, I.dense(s, d), ["click", "view", "purchase", "error", "signup", "nothing"], ["view"], 4)
    failed = s.createDataFrame([(t, 0, r) for t, r in got.failures], "ticker string, n long, reason string")
    return got.bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("")).unionByName(failed)


# -- small items ----------------------------------------------------------------------------

query("sanitize_repeated", f"WITH {I.HOLED} SELECT ticker, CASE WHEN count(*) < 30 THEN 'short' ELSE 'kept' END AS status FROM bars GROUP BY ticker")(
    lambda s, d: sanitize.sanitise(I.holed(s, d).withColumn("a", F.lit(1)).unionByName(I.holed(s, d).withColumn("close", -F.col("close")).withColumn("a", F.lit(2))), 30, arrival="a")
)
_JSON = "'{\"l_linenumber\":' || l_linenumber || ',\"l_orderkey\":' || l_orderkey || ',\"l_returnflag\":\"' || l_returnflag || '\"}'"
query("content_digest_lines", f"""WITH h AS (SELECT sha256({_JSON}) AS h FROM lineitem),
x AS (SELECT count(*) AS rows, sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT) AS a, sum(('0x' || substr(h, 17, 15))::BIGINT::HUGEINT) AS b FROM h)
SELECT rows, sha256(rows || ':' || a || ':' || b) AS digest FROM x""")(lambda s, d: sinks.content_digest(I.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")))
_TIED = "round(100.0 * (rank() OVER (PARTITION BY sector ORDER BY n_orders) + (count(*) OVER (PARTITION BY sector, n_orders) - 1) / 2.0) / count(*) OVER (PARTITION BY sector), 6)"
query("kpi_tied_ranks", f"WITH {I.PANEL} SELECT company, strftime(date, '%Y-%m-%d') AS date, sector, {_TIED} AS score FROM panel")(
    lambda s, d: kpi.percent_ranked(I.panel(s, d), "n_orders", "score").select("company", "date", "sector", "score")
)
