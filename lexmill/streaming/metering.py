"""The metering operators over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_usage(events: DataFrame, ts: str = "ts", who: str = "user_id", tokens: str = "value", late: str = "1 day") -> DataFrame:
    """(start, who, used): tokens of each user and UTC + 5:30 day, with a watermark that drops rows later than ``late``."""
    rows = events.withColumn("at", F.col(ts).cast("timestamp")).where(f"{tokens} > 0").withWatermark("at", late)
    day = F.window("at", "1 day", startTime="18 hours 30 minutes")
    return rows.groupBy(day, who).agg(F.sum(tokens).alias("used")).select(F.col("window.start").alias("start"), who, "used")


def rate_limited(events: DataFrame, per_minute: int, ts: str = "ts", who: str = "user_id", key: str = "event_id", late: str = "2 minutes") -> DataFrame:
    """(who, key, minute) of admitted calls: the first ``per_minute`` of each user's minute in the order they arrive.

    Every minute of a user has its own count in state, so late calls of an earlier minute neither reset nor evade it. A minute leaves the state once
    the watermark has passed it; calls later than that are dropped by the watermark.
    """
    at = F.col(ts).cast("timestamp")
    rows = events.select(F.col(who).cast("long").alias("who"), F.col(key).cast("long").alias("key"), at.alias("at")).withWatermark("at", late)
    rows = rows.withColumn("minute", F.floor(F.unix_micros("at") / 60_000_000))

    def admit(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        got = []
        for part in parts:
            part = part.sort_values(["at", "key"])
            part = part.iloc[: max(per_minute - used, 0)]
            used += len(part)
            got.append(part)
        state.update((used,))
        end = (int(group[1]) + 1) * 60_000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        made = pd.concat(got)
        yield pd.DataFrame({"who": group[0], "key": made["key"], "minute": int(group[1])})

    return rows.groupBy("who", "minute").applyInPandasWithState(admit, "who long, key long, minute long", "used long", "append", GroupStateTimeout.EventTimeTimeout)
