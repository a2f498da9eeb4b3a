"""The event clock on streams: bins and chains with event-time watermarks, thresholds from bounded state.

Append mode: a row comes out once, when the watermark has passed its window; what is still open at the end of
the input stays in state. Rows later than ``delay`` are dropped, as watermarks do."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..params import DAY, MINUTE, Study
from ..storage import shared_dir


def right_bins(fills: DataFrame, p: Study, delay: str = "10 minutes") -> DataFrame:
    """(symbol, e, notional, n) of the sell bins that have rows, labelled by their end."""
    sells = fills.where("side = 'sell'").withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", delay)
    sums = sells.groupBy("symbol", F.window("ts", f"{p.clock.width_min} minutes").alias("w")).agg(F.sum("notional").alias("notional"), F.count("*").alias("n"))
    return sums.select("symbol", F.unix_micros("w.end").alias("e"), "notional", "n")


def onset_sessions(triggers: DataFrame, p: Study, delay: str = "10 minutes") -> DataFrame:
    """(symbol, e0, chain_end, n_triggers_chain) of chains that the watermark has closed."""
    timed = triggers.withColumn("ts", F.timestamp_micros("e")).withWatermark("ts", delay)
    chains = timed.groupBy("symbol", F.session_window("ts", f"{p.clock.quiet_min} minutes").alias("w")).agg(F.min("e").alias("e0"), F.max("e").alias("chain_end"), F.count("*").alias("n_triggers_chain"))
    return chains.drop("w")


def trailing_triggers(rolled: DataFrame, p: Study, delay: str | None = None) -> DataFrame:
    """(symbol, e, r, thr, trigger) of bins. Without ``delay`` they must arrive in order of time, batch by batch. With it
    they may come in any order within the delay: bins wait in state until the watermark has passed them, later ones are
    dropped, and what the watermark has not passed at the end of the input is not given.

    State holds one trail of rolling sums a symbol, whatever the stream's length, and the bins that wait. The threshold is
    the exact quantile of the sums in [e - trail, e); warm-up counts from the first full rolling sum."""
    trail, warm = p.clock.trail_days * DAY, p.clock.warmup_days * DAY
    schema = "symbol string, e bigint, r double, thr double, trigger boolean"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, old_e, old_r, wait_e, wait_r = state.get if state.exists else (None, [], [], [], [])
        come = [] if state.hasTimedOut else [b for b in (b[["e", "r"]].dropna(subset=["r"]) for b in batches) if len(b)]
        come += [pd.DataFrame({"e": np.array(wait_e, dtype=np.int64), "r": np.array(wait_r, dtype=float)})] if len(wait_e) else []
        if not come:
            return
        g = pd.concat(come).drop_duplicates("e").sort_values("e")
        if delay is None:
            now, rest = g, g[:0]
        else:
            passed = state.getCurrentWatermarkMs() * 1000
            now, rest = g[(g["e"] <= passed) & (g["e"] > (old_e[-1] if len(old_e) else -1))], g[g["e"] > passed]
        start = start if start is not None or not len(now) else int(now["e"].iloc[0])
        e = np.concatenate((np.array(old_e, dtype=np.int64), now["e"].to_numpy(np.int64)))
        r = np.concatenate((np.array(old_r, dtype=float), now["r"].to_numpy(float)))
        kept = e >= (e[-1] if len(e) else 0) - trail
        state.update((start, e[kept].tolist(), r[kept].tolist(), rest["e"].astype("int64").tolist(), rest["r"].tolist()))
        if len(rest):
            state.setTimeoutTimestamp(int(rest["e"].iloc[0]) // 1000 + 1)
        if len(now):
            thr = pd.Series(r, index=pd.to_datetime(e, unit="us")).rolling(f"{p.clock.trail_days}D", closed="left", min_periods=1).quantile(p.clock.quantile).to_numpy()[len(old_e) :]
            at, value = e[len(old_e) :], r[len(old_e) :]
            fired = (at >= start + warm) & (value > 0) & (value >= thr)
            yield pd.DataFrame({"symbol": key[0], "e": at, "r": value, "thr": thr, "trigger": fired})

    timed = rolled if delay is None else rolled.withColumn("ts", F.timestamp_micros("e")).withWatermark("ts", delay)
    held = "start bigint, e array<bigint>, r array<double>, wait_e array<bigint>, wait_r array<double>"
    out = timed.groupBy("symbol").applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.NoTimeout if delay is None else GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("thr", F.nanvl("thr", F.lit(None).cast("double")))


def drained(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is there now and read what it wrote; both folders are shared ones."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def as_stream(rows: DataFrame, files: int | None = None) -> DataFrame:
    """A table as a stream of its files, written first in the shared folder."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    reader = spark.readStream.schema(rows.schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)
