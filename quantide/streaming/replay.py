"""Offline changes replayed as a stream, with a state for each instrument."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "ticker string, note string, client_timestamp timestamp, outcome string"


def _judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames), ignore_index=True)
    rows = rows.iloc[rows.assign(_n=rows["note"].map(lambda x: (x or "").encode())).sort_values(["client_timestamp", "_n"], kind="stable").index]
    server = rows["updated_at"].max()
    known = [t for t in ((pd.Timestamp(state.get[0], unit="us") if state.exists else None), server) if t is not None and not pd.isna(t)]
    times = rows["client_timestamp"]
    before = times.cummax().shift()
    if known:
        before = before.fillna(max(known)).clip(lower=max(known))
    rows["outcome"] = (before.isna() | (times > before)).map({True: "applied", False: "conflict"})
    last = max([*known, times.max()])
    state.update((last.value // 1000,))
    yield rows[["ticker", "note", "client_timestamp", "outcome"]]


def replayed(pending: DataFrame, server: DataFrame) -> DataFrame:
    """``annotations.synced`` of a stream of changes (ticker, note, client_timestamp): applied if strictly newer than all before them and than the server's, else conflict.

    The state is the newest time seen of each instrument, so the outcomes are those of one replay however the client's order is cut into batches; a change that comes after newer ones
    is a conflict. ``server`` has one row per instrument (ticker, updated_at). For append mode.
    """
    known = pending.select("ticker", "note", "client_timestamp").join(server.select("ticker", F.col("updated_at").cast("timestamp").alias("updated_at")), "ticker", "left")
    return known.groupBy("ticker").applyInPandasWithState(_judge, _OUT, "last long", "append", GroupStateTimeout.NoTimeout)
