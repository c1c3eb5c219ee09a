"""Velocity features over a stream, equal to the batch form for rows within the delay.

State is keyed by account: the per-second counts and exact sums of its last week. A
micro-batch reads and writes the state of the accounts it holds and of no other. An entry
is bounded by the seconds of a week, however busy the account; it goes when the account has
been silent for as long. Restarts, replays and the output are Spark's: state store, log and
file sink commit together.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from decimal import Context, Decimal
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from paywatch.functions import timeline
from paywatch.functions.timeline import MONEY
from paywatch.runtime import scratch_path
from paywatch.schemas import DAY, HOUR

WEEK = 7 * DAY
STATE = "seconds array<long>, counts array<long>, totals array<decimal(38,10)>"
COUNTS = {"txn_count_1h": HOUR, "txn_count_24h": DAY, "txn_count_7d": WEEK}
SUMS = {"amount_sum_1h": HOUR, "amount_sum_24h": DAY}
EXACT = Context(prec=60)


def merged_seconds(state: tuple, seconds: np.ndarray, amounts: list[Decimal | None]) -> tuple[list, list, list]:
    """The state's seconds with the rows of a micro-batch added."""
    known = {s: [n, t] for s, n, t in zip(*state)}
    for second, amount in zip(seconds.tolist(), amounts):
        entry = known.setdefault(second, [0, Decimal(0)])
        entry[0] += 1
        if amount is not None:
            entry[1] = EXACT.add(entry[1], amount)
    order = sorted(known)
    return order, [known[s][0] for s in order], [known[s][1] for s in order]


def trailing(order: list[int], values: list, seconds: np.ndarray, width: int) -> list:
    """Sum of the values in [t - width, t] for each t."""
    upto = list(accumulate(values, EXACT.add if values and isinstance(values[0], Decimal) else None, initial=values[0] * 0 if values else 0))
    last, first = np.searchsorted(order, seconds, "right"), np.searchsorted(order, seconds - width, "left")
    minus = EXACT.subtract if values and isinstance(values[0], Decimal) else int.__sub__
    return [minus(upto[b], upto[a]) for a, b in zip(first, last)]


class VelocityJob:
    """Sliding counts and sums per account over micro-batches.

    ``delay`` is how many seconds behind the newest event of earlier micro-batches a row may
    be. Later rows are dropped, as the watermark says. A row counts the events that arrived up
    to its own micro-batch. A row without account or time counts itself alone.
    """

    def __init__(self, folder: str, delay: int = HOUR):
        self.folder = folder.rstrip("/")
        self.delay = delay

    def features(self, stream: DataFrame) -> DataFrame:
        """The stream's rows with their velocity columns; it needs account_id, amount and timestamp."""
        delay, columns = self.delay, stream.columns
        # Whole values pass through Python as text: a null would turn numbers into floats.
        rows = timeline.with_epoch(stream.withWatermark("timestamp", f"{delay} seconds")).select(
            F.col("account_id").alias("_key"), "timestamp", F.coalesce("ts_epoch", F.lit(-1)).alias("_second"),
            F.col("amount").try_cast(MONEY).cast("string").alias("_amount"), *[F.col(c).cast("string").alias(f"_of_{c}") for c in columns],
        )

        def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            if state.hasTimedOut:
                state.remove()
                return
            batch = pd.concat(list(parts), ignore_index=True)
            out = batch[[f"_of_{c}" for c in columns]].copy()
            seconds = batch["_second"].to_numpy(np.int64)
            amounts = [None if a is None else Decimal(a) for a in batch["_amount"]]
            if key[0] is None or pd.isna(key[0]):
                for name in COUNTS:
                    out[name] = 1
                for name in SUMS:
                    out[name] = [float(a or 0) for a in amounts]
                yield out
                return
            order, counts, totals = merged_seconds(state.get if state.exists else ([], [], []), seconds, amounts)
            # No row that is still to come reaches back further.
            old = bisect_left(order, max(order[-1], state.getCurrentWatermarkMs() // 1000 + delay) - WEEK - delay)
            if old < len(order):
                state.update((order[old:], counts[old:], totals[old:]))
                gone = (order[-1] + WEEK + delay + 1) * 1000
                state.setTimeoutTimestamp(max(gone, state.getCurrentWatermarkMs() + 1))
            for name, width in COUNTS.items():
                out[name] = trailing(order, counts, seconds, width)
            for name, width in SUMS.items():
                out[name] = [float(t) for t in trailing(order, totals, seconds, width)]
            yield out

        carried = ", ".join(f"`_of_{c}` string" for c in columns)
        added = ", ".join([f"{n} long" for n in COUNTS] + [f"{n} double" for n in SUMS])
        found = rows.groupBy("_key").applyInPandasWithState(
            step, f"{carried}, {added}", STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
        return found.select(*[F.col(f"_of_{c}").cast(stream.schema[c].dataType).alias(c) for c in columns], *COUNTS, *SUMS)

    def run(self, stream: DataFrame, available_now: bool = True) -> StreamingQuery:
        """Start the job on a stream with account_id, amount and timestamp."""
        found = self.features(stream)
        self.schema: StructType = found.schema
        writer = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{self.folder}/log")
        return (writer.trigger(availableNow=True) if available_now else writer).start(f"{self.folder}/out")

    def result(self, spark) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.folder}/out")


def drained_velocity(stream: DataFrame, delay: int = HOUR) -> DataFrame:
    """Run over all available input and return the rows with their velocity columns."""
    job = VelocityJob(scratch_path(stream.sparkSession, "velocity"), delay)
    job.run(stream).awaitTermination()
    return job.result(stream.sparkSession)
