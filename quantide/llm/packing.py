"""Best-fit packing of documents into sequences, by a configuration linear program.

A document is its token ids and an end-of-document id. One longer than a sequence is cut into whole sequences; its
first piece takes what is left over. Pieces are packed by their lengths alone, so packing is a problem over a histogram with one bin a
length, whatever the number of documents:

* A configuration is a multiset of lengths that fit a sequence. The linear program covers the count of each
  length with as few configurations as possible.
* It is solved by multiplicative weights: a length's weight falls exponentially with the share of its count that is already
  covered. A knapsack dynamic program prices configurations: its table gives the heaviest one, and for each
  length the heaviest one that holds it. All within ``SLACK`` of the heaviest are used at once, by amounts at which
  no length gains more than ``STEP`` of its count. Covered lengths drop out. The weights of any round also prove a lower bound.
* Fractional counts are rounded along the configurations in order, carrying the remainder, as far as pieces are left, to lots
  that make some ``RUNS`` runs. Configurations
  that leave much more room than the bound demands are not used at first: their pieces stay for the next program, over what is
  left, which allows more. The last ``REMAINDER`` pieces, whatever the input's size, are packed best-fit, the longest first.

A program leaves a small share of the pieces to the next, so the plan, some ten thousand runs of equal sequences a program, grows with
the logarithm of the documents only. Pieces are numbered within their
task and length as they are made and written; sums of the tasks' counts turn that into a number among all pieces of the
length, and the plan maps it to a sequence and a place. Nothing is sorted or gathered by length, so equal lengths are no hot key.

Defined results: a null text is empty, so its document is the end id alone; rows are packed one by one, so repeated
rows and ids are documents of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantide.llm.bpe import default_vocabulary, encoder
from quantide.llm.common import stored, table

CAPACITY = 1024
END = 2
#: how fast weights fall as a length gets covered
ETA = 10.0
#: share of a length's count that a round covers at most
STEP = 0.05
#: configurations this much lighter than the heaviest one are used with it
SLACK = 0.03
#: share of the tokens that is covered before counts are rounded
COVERED = 0.95
#: runs of sequences that a program is rounded to, about
RUNS = 20_000
#: pieces that are packed without a further program
REMAINDER = 500

Run = tuple[tuple[int, ...], int]


# -- the plan --------------------------------------------------------------------------


def knapsack(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest value within each capacity, and the length to take first there (0: no other helps); -inf is no piece."""
    capacity = len(value) - 1
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    down = value[::-1].copy()
    for c in range(1, capacity + 1):
        found = down[capacity - c : capacity] + best[:c]
        rest = int(found.argmax())
        best[c] = best[c - 1]
        if found[rest] > best[c]:
            best[c], take[c] = found[rest], c - rest
    return best, take


def _with_each(lengths: np.ndarray, take: np.ndarray) -> np.ndarray:
    """For each length a row with the lengths of the heaviest configuration that holds it, zeros at the end."""
    capacity = len(take) - 1
    used = np.maximum.accumulate(np.where(take > 0, np.arange(capacity + 1), 0))
    rest, columns = used[capacity - lengths], [lengths]
    while take[rest].any():
        columns.append(take[rest])
        rest = used[rest - take[rest]]
    return -np.sort(-np.stack(columns, 1), 1)


def cover(histogram: np.ndarray) -> tuple[dict[tuple[int, ...], float], float]:
    """A fractional cover of the counts by configurations, and a lower bound of any cover's size."""
    capacity = len(histogram) - 1
    count, sizes = histogram.astype(float), np.arange(capacity + 1)
    live = np.flatnonzero(histogram)
    covered, bound = np.zeros(capacity + 1), 0.0
    used: dict[tuple[int, ...], float] = {}
    wanted = COVERED * (count * sizes).sum()
    while live.size and (count * sizes * np.minimum(covered, 1)).sum() < wanted:
        weight = np.full(capacity + 1, -np.inf)
        weight[live] = live * np.exp(-ETA * (covered[live] - covered[live].min()))
        best, take = knapsack(weight)
        bound = max(bound, float((count[live] * weight[live]).sum() / best[capacity]))
        near = live[weight[live] + best[capacity - live] >= (1 - SLACK) * best[capacity]]
        chosen = _with_each(near, take)
        amount = count[near] * (1 - covered[near])
        gain = np.zeros(capacity + 1)
        np.add.at(gain, chosen.ravel(), np.repeat(amount, chosen.shape[1]))
        gain[0] = 0
        has = np.flatnonzero(gain)
        gain[has] /= count[has]
        # each configuration as far as the length in it that has the least to gain; the last thousandth may be exceeded, so that rounds get on
        most = np.full(capacity + 1, np.inf)
        most[has] = np.maximum(np.minimum(STEP, 1 - covered[has]), 1e-3) / gain[has]
        amount = amount * most[chosen].min(1)
        added = np.zeros(capacity + 1)
        np.add.at(added, chosen.ravel(), np.repeat(amount, chosen.shape[1]))
        covered[has] += added[has] / count[has]
        for row, x in zip(chosen.tolist(), amount.tolist()):
            configuration = tuple(v for v in row if v)
            used[configuration] = used.get(configuration, 0.0) + x
        live = live[covered[live] < 1 - 1e-9]
    return used, bound


def best_fit(left: np.ndarray) -> list[Run]:
    """Packs the counts, the longest first, each sequence filled with the longest piece that fits; alike sequences make a run."""
    left, runs = left.copy(), []
    capacity = len(left) - 1
    for length in range(capacity, 0, -1):
        while left[length]:
            chosen, room, have = [], capacity, left.copy()
            at = length
            while at:
                chosen.append(at)
                have[at] -= 1
                room -= at
                fits = np.flatnonzero(have[: room + 1][1:])
                at = int(fits[-1]) + 1 if fits.size else 0
            # as often as the same choice comes up again
            each = np.bincount(chosen, minlength=capacity + 1)
            times = int((left[each > 0] // each[each > 0]).min())
            left -= times * each
            runs.append((tuple(chosen), times))
    return runs


def plan(histogram: np.ndarray) -> tuple[list[Run], float]:
    """Runs of equal sequences that hold all pieces of the histogram (index: length), and a lower bound of their number."""
    left = histogram.astype(np.int64).copy()
    capacity, sizes = len(left) - 1, np.arange(len(left))
    full, left[-1] = int(left[-1]), 0
    runs: list[Run] = [((capacity,), full)] if full else []

    def place(configuration: tuple[int, ...], times: int) -> int:
        each: dict[int, int] = {}
        for v in configuration:
            each[v] = each.get(v, 0) + 1
        times = min(times, *(int(left[v]) // n for v, n in each.items()))
        if times > 0:
            for v, n in each.items():
                left[v] -= times * n
            runs.append((configuration, times))
        return max(times, 0)

    bound, turn = 0.0, 0
    while left.sum() > REMAINDER:
        tokens, before = int((left * sizes).sum()), int(left.sum())
        used, least = cover(left)
        bound = bound or least
        # room that even the best cover leaves in a sequence; each turn allows more
        room = (2 * max(0.0, capacity - tokens / least) + 1) * 2**turn - 1
        carried, lot = 0.0, max(1, int(sum(used.values()) / RUNS))
        for configuration in sorted(used, reverse=True):
            if capacity - sum(configuration) <= room:
                carried += used[configuration]
                if carried >= lot:
                    carried -= place(configuration, int(carried) // lot * lot)
                carried = min(carried, lot)
        turn += 1
        if room >= capacity and left.sum() > before / 2:
            break
    return runs + best_fit(left), full + max(bound, float((histogram[:-1] * sizes[:-1]).sum()) / capacity)


def slots(runs: list[Run], capacity: int) -> np.ndarray:
    """Where pieces go: rows of key (length and number of the first piece), sequence, pieces a sequence, offset; sorted by key."""
    rows, numbers, sequence = [], [0] * (capacity + 1), 0
    for configuration, times in runs:
        offset, ordered = 0, sorted(configuration, reverse=True)
        for length in sorted(set(ordered), reverse=True):
            n = ordered.count(length)
            rows.append((_key(length, numbers[length]), numbers[length], sequence, n, offset))
            numbers[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _key(length, number):
    return (length << 48) + number


# -- the documents ---------------------------------------------------------------------


def _pieces(kind: pa.DataType, key: str, capacity: int, end: int, path: str | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = encoder(path or default_vocabulary()), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            keys, from_row, ids = [], [], []
            for i, text in enumerate(batch.column(1)):
                tokens = np.array([*bpe.encode(text.as_py()), end], "<u4")
                start, piece = 0, 0
                stop = (len(tokens) - 1) % capacity + 1
                while start < len(tokens):
                    length = stop - start
                    rows.append((piece, start, length, zlib.crc32(tokens[start:stop].tobytes()), part, seen[length]))
                    if with_ids:
                        ids.append(tokens[start:stop].astype(np.int32))
                    seen[length] += 1
                    from_row.append(i)
                    start, stop, piece = stop, stop + capacity, piece + 1
            columns = list(zip(*rows)) if rows else [()] * 6
            keys = batch.column(0).take(pa.array(from_row, pa.int64()))
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = [key, "piece", "start", "length", "ids_crc32", "_part", "_number"]
            arrays = [keys, *(pa.array(c, t) for c, t in zip(columns, types))]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _put(where: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("_number").to_numpy()
            at = np.searchsorted(where[:, 0], _key(length, number), "right") - 1
            _, first, sequence, each, offset = where[at].T
            done, among = np.divmod(number - first, each)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence + done), pa.array(offset + among * length)], names=[*names, "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id and offset of each piece, and its ids if wanted."""
    from pyspark.sql.pandas.types import to_arrow_type

    read = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = read.schema["id"].dataType
    names = [key, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    shape = f"`{key}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    more = ", ids array<int>" if with_ids else ""
    pieces = stored(read.mapInArrow(_pieces(to_arrow_type(kind), key, capacity, end, path, with_ids), f"{shape}, _part int, _number long{more}"), "pieces")
    counts = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = stored(counts.select("_part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")), "piece-counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in first.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length up to the capacity
        histogram[row["length"]] = row["n"]
    where = slots(plan(histogram)[0], capacity)
    numbered = pieces.join(first.drop("n"), ["_part", "length"]).withColumn("_number", F.col("_number") + F.col("_first"))
    return numbered.select(*(F.col(f"`{n}`") for n in names), "_number").mapInArrow(_put(where, names), f"{shape}{more}, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and token_ids of each sequence, from ``packed(..., with_ids=True)``."""
    whole = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(whole, lambda x: x["ids"])).alias("token_ids"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
