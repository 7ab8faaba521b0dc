"""Continuous forms of the batch operators."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dictionary import NameDictionary
from ..operators.resolve import Thresholds, resolve_labels


def resolve_stream(labels: DataFrame, d: NameDictionary, out: str, checkpoint: str, t: Thresholds = Thresholds(), one_source: bool = False, once: bool = True) -> StreamingQuery:
    """New label rows -> items, one micro-batch at a time.

    A batch writes to its own ``batch=<id>`` folders with overwrite - items to ``out``, removed fragments to ``out`` + "_removed" - so a
    batch that is run again after a failure replaces its own output and nothing is written twice.  The dictionary is built once,
    before the stream.
    """
    d = d.materialised()

    def one(batch: DataFrame, batch_id: int) -> None:
        r = resolve_labels(batch, d, t, one_source=one_source)
        r.items.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        r.removed.write.mode("overwrite").parquet(f"{out}_removed/batch={batch_id}")
    w = labels.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def dedup_labels(labels: DataFrame, key: str, ts: str = "ts", horizon: str = "1 hour") -> DataFrame:
    """Drop repeats of a key within the horizon; state is evicted by the watermark."""
    return labels.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def needs_review_rate(items: DataFrame, ts: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", flag: str = "needs_review") -> DataFrame:
    """Items and unresolved items per (sliding) window; rows later than the watermark are dropped."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (items.withWatermark(ts, late).groupBy(win.alias("w")).agg(F.count("*").alias("n"), F.count_if(flag).alias("n_review"))
            .select(F.col("w.start").alias("window_start"), "n", "n_review"))


def review_sessions(events: DataFrame, gap: str = "30 minutes", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Review activity of a user, split where it pauses longer than the gap."""
    return (events.withWatermark(ts, late).groupBy("user_id", F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
            .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"))


def reaction_alerts(pairs: DataFrame) -> DataFrame:
    """pairs(user_id, product_id, key) of reacted products -> (user_id, key, first_product, second_product) once two products share a key.

    Two products differ exactly when the smallest and the largest product id differ, so the state of a key is two values,
    however many rows it receives.  Run in update mode; the sink upserts by (user_id, key).
    """
    g = pairs.groupBy("user_id", "key").agg(F.min("product_id").alias("first_product"), F.max("product_id").alias("second_product"))
    return g.where("first_product <> second_product")


def reaction_alerts_once(pairs: DataFrame, horizon: str = "90 days", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """pairs(user_id, product_id, key, ts) of reacted products -> one row per (user_id, key) and spell, in append mode.

    A spell is a run of reactions with no pause longer than ``horizon``; its alert comes with the first reaction to a second product
    and tells both.  State is four values per (user, key); an event-time timer drops it once the watermark passes the last reaction
    by the horizon, when no later row could belong to the spell, so eviction never changes a result.  Rows of one batch are
    taken in the order of time and product; rows later than the watermark may still join the spell that is open.
    """
    span = int(pd.Timedelta(horizon) / pd.Timedelta("1ms"))
    rows = pairs.where("product_id IS NOT NULL").withWatermark(ts, late).select("user_id", "key", "product_id", ts, F.unix_millis(ts).alias("at"))

    def step(who: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last, told, out = state.get + ([],) if state.exists else (None, None, False, [])
        seen = sorted((int(a), int(p)) for b in batches for a, p in zip(b["at"], b["product_id"]))
        for at, product in seen:
            if last is None or at - last > span:
                first, told = product, False
            elif product != first and not told:
                out.append((*who, first, product, at))
                told = True
            last = at if last is None else max(last, at)
        state.update((first, last, told))
        state.setTimeoutTimestamp(max(last + span, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=["user_id", "key", "first_product", "second_product", "at"])
    types = dict(rows.dtypes)
    found = rows.groupBy("user_id", "key").applyInPandasWithState(
        step, f"user_id {types['user_id']}, key {types['key']}, first_product long, second_product long, at long", "first long, last long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("user_id", "key", "first_product", "second_product", F.timestamp_millis("at").alias("alerted"))


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """Drive a stream over the available input into a Parquet table, one folder per micro-batch, and read it back.

    Overwriting a batch's own folder makes a repeated batch harmless.
    """
    schema = stream.schema
    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    stream.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)
