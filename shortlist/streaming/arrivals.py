"""Structured Streaming over arriving postings."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shortlist.operators.embed import Vectoriser, embed
from shortlist.operators.groups import first_per_group
from shortlist.operators.ranking import cosine_scores
from shortlist.plans.score import posting_text


def stream_score(stream: DataFrame, vector: list[float], kernel: str = "expression") -> DataFrame:
    """Score arriving postings against a fixed profile vector; stateless, equal to the batch result."""
    return cosine_scores(stream, vector, kernel=kernel)


def stream_score_text(stream: DataFrame, vector: list[float], vectoriser: Vectoriser,
                      text: Column | None = None, kernel: str = "expression") -> DataFrame:
    """Vectorise and score arriving postings by their text, or pages by `text` (for instance page_text("html")).

    Text, vector and score are made row by row, so the result equals the batch one.
    """
    rows = stream.withColumn("clean_text", posting_text(stream) if text is None else text)
    return stream_score(embed(rows, "clean_text", vectoriser), vector, kernel)


def stream_dedup_url(stream: DataFrame, ts: str, delay: str, url: str = "url") -> DataFrame:
    """First arrival per url inside the watermark; the state holds one entry per live url."""
    return (stream.withColumn(ts, stream[ts].cast("timestamp")).withWatermark(ts, delay)
            .dropDuplicatesWithinWatermark([url]))


def stream_first_by_event(stream: DataFrame, ts: str, delay: str, order: list[str], url: str = "url") -> DataFrame:
    """The row of each url that is first by event time and then by the columns `order`, however late its file came.

    Every url has a state: the order of its best row so far. A row that beats it is sent on at once, as the next `version` of
    the url, and first_arrivals keeps the last one; a repeat sends nothing. The state goes when the watermark is `delay` past
    the best row; what comes after begins a new `period`, as dropDuplicatesWithinWatermark does it. Rows without an event
    time, and those the watermark calls late, are dropped. Nulls in `order` come last; blank urls count as one.
    """
    rows = stream.withColumn(ts, stream[ts].cast("timestamp")).filter(F.col(ts).isNotNull()).withWatermark(ts, delay)
    plain = [(c, t) for c, t in rows.dtypes if c in order]
    state = ", ".join(["ts timestamp", "period timestamp", "version int", *[f"o_{c} {t}" for c, t in plain]])
    out = ", ".join([*[f"`{c}` {t}" for c, t in rows.dtypes], "version int", "period timestamp"])
    wait = pd.Timedelta(delay)
    spot = [[c for c, _ in plain].index(c) for c in order]

    def rank(values: tuple, at: Any) -> tuple:
        return (at, *[(pd.isna(values[i]), None if pd.isna(values[i]) else values[i]) for i in spot])

    def keep(key: tuple, frames: Iterator[pd.DataFrame], seen: GroupState) -> Iterator[pd.DataFrame]:
        if seen.hasTimedOut:
            seen.remove()
            return
        best = seen.get if seen.exists else None
        row = None
        for frame in frames:
            first = frame.sort_values([ts, *order], kind="stable", na_position="last").iloc[:1]
            values = tuple(v.item() if hasattr(v, "item") else v for v in (first[c].iloc[0] for c, _ in plain))
            at = first[ts].iloc[0].to_pydatetime()
            if best is None or rank(values, at) < rank(tuple(best[3:]), best[0]):
                period, version = (at, 0) if not seen.exists else (best[1], best[2])
                best, row = (at, period, version, *values), first
        if row is not None:
            best = (best[0], best[1], best[2] + 1, *best[3:])
            seen.update(best)
            yield row.drop(columns="_url_key").assign(version=best[2], period=best[1])
        ends = int((pd.Timestamp(best[0]) + wait).timestamp() * 1000)
        seen.setTimeoutTimestamp(max(ends, seen.getCurrentWatermarkMs() + 1))

    keyed = rows.withColumn("_url_key", F.coalesce(F.trim(url), F.lit("")))
    return keyed.groupBy("_url_key").applyInPandasWithState(keep, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def first_arrivals(sent: DataFrame, url: str = "url") -> DataFrame:
    """What stream_first_by_event holds to be first now: the last version of every url and period."""
    return first_per_group(sent, [F.coalesce(F.trim(url), F.lit("")), "period"], [F.desc("version")]).drop("version", "period")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, append it to Parquet and stop; a restart continues after it."""
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", path).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query
