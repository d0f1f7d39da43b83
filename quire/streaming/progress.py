"""Incremental forms of the progressive operators, over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import shared_folder


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The events of a folder of Parquet files as a stream with a proper timestamp, so many new files to a micro-batch."""
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def running_counts(events: DataFrame, *keys: str, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per window and keys; late rows within the delay still count."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, *keys: str, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Spans of activity that end after ``gap`` without an event."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, *keys: str, delay: str = "1 hour") -> DataFrame:
    """The first event of each key within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def run_once(stream: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Everything that is there by now, as a batch table, through the incremental plan.

    Each micro-batch is written to a table in the shared folder, under its number, so one that runs twice leaves the same;
    the state lies beside them.  In complete mode the last batch is the result, else all of them are.
    """
    spark = stream.sparkSession
    root = checkpoint or shared_folder(spark, "stream")
    seen: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batches/{batch_id}")
        seen.append(batch_id)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    wanted = sorted(set(seen))[-1:] if mode == "complete" else sorted(set(seen))
    if not wanted:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*[f"{root}/batches/{k}" for k in wanted])


def running_means(events: DataFrame, key: str, value: str = "value", keep: float = 0.7, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(key, n, mean): an exponential mean per key, kept as state over micro-batches; rows of a batch in the order given."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, frames, state: GroupState):
        n, mean = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(frames))  # of one key in one micro-batch, which maxFilesPerTrigger bounds
        for v in rows.sort_values(list(order))[value]:
            mean = v if n == 0 else mean * keep + v * (1 - keep)
            n += 1
        state.update((n, mean))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [mean]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, n bigint, mean double", "n bigint, mean double", "update", GroupStateTimeout.NoTimeout)


#: Groups that the keys of a stream are dealt into, as a call of Python per key costs many times its work; a checkpoint relies on it.
BUCKETS = 1_024


def silences(events: DataFrame, key: str, gap_ms: int, ts: str = "ts", delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(key, first_us, last_us, n): spells of activity, each told once nothing has followed for ``gap_ms``.

    A spell ends by a timer on event time, so the last one of a key is told without a next event, as soon as the
    watermark has passed its end by the gap; rows behind the watermark are dropped.  Keys live in buckets: the state
    of one is a table of the open spells of its keys, its timer the earliest of theirs, and a bucket's rows of one
    micro-batch, which maxFilesPerTrigger bounds, are sorted together.  Rows without key or time are passed over.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    gap = gap_ms * 1_000

    def packed(spells: pd.DataFrame) -> bytes:
        table = pa.Table.from_pandas(spells, preserve_index=False)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        return out.getvalue().to_pybytes()

    def step(_, frames, state: GroupState):
        held = pa.ipc.open_stream(state.get[0]).read_all().to_pandas() if state.exists else None
        news = [] if state.hasTimedOut else [pd.DataFrame({"key": f[key], "first_us": f["_us"], "last_us": f["_us"], "n": np.int64(1)}) for f in frames]
        rows = pd.concat([*([] if held is None else [held]), *news], ignore_index=True)
        code, _ = pd.factorize(rows["key"])
        begin, end, n = (rows[c].to_numpy(np.int64) for c in ("first_us", "last_us", "n"))
        size = 0 if held is None else len(held)
        keys = int(code.max()) + 1
        # an event within the open spell of its key counts there; the others are single events
        place = np.full(keys, -1)
        place[code[:size]] = np.arange(size)
        own = place[code]
        inside = (np.arange(len(rows)) >= size) & (own >= 0) & (begin >= begin[own]) & (end <= end[own])
        n = n + np.bincount(own[inside], minlength=len(rows))
        fresh = np.bincount(code[size:], minlength=keys) > 0
        left = np.flatnonzero(~inside)
        left = left[np.lexsort((begin[left], code[left]))]
        code, begin, end, n = code[left], begin[left], end[left], n[left]
        # what is open is one stretch among the single events
        cuts = np.concatenate([[0], np.flatnonzero((code[1:] != code[:-1]) | (begin[1:] - end[:-1] > gap)) + 1])
        spells = rows.iloc[left[cuts]][["key"]].assign(first_us=begin[cuts], last_us=end[np.append(cuts[1:], len(end)) - 1], n=np.add.reduceat(n, cuts))
        code, mark = code[cuts], state.getCurrentWatermarkMs()
        until = spells["last_us"].to_numpy() // 1_000 + gap_ms
        followed = np.append(code[1:] == code[:-1], False)
        over = followed | ~fresh[code] & (until < mark)
        if over.any():
            yield spells[over].rename(columns={"key": key})
        if over.all():
            state.remove()
        else:
            state.update((packed(spells[~over]),))
            state.setTimeoutTimestamp(max(int(until[~over].min()), mark + 1))

    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, ts, F.unix_micros(ts).alias("_us")).withWatermark(ts, delay)
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    return dealt.groupBy("_bucket").applyInPandasWithState(step, f"`{key}` {kind}, first_us bigint, last_us bigint, n bigint", "spells binary", "append", GroupStateTimeout.EventTimeTimeout)


#: Characters that a page must have, growth that counts, how long it must rest, and how long it is waited for (fixed values).
READY_CHARS, GROWTH, REST_MS, WAIT_MS = 750, 32, 500, 8_000


def ready_at(sizes: DataFrame, *keys: str, ms: str = "ms", size: str = "size") -> DataFrame:
    """(keys, ready_ms, settled): when a page may be read, from observations of its text's length since it was opened (ms 0).

    It is settled once it has READY_CHARS and has not grown by more than GROWTH for REST_MS; else it is read as it is
    after WAIT_MS.
    """
    w = Window.partitionBy(*keys).orderBy(ms)
    grown = sizes.withColumn("_was", F.lag(size).over(w)).where(F.col("_was").isNull() | (F.abs(F.col(size) - F.col("_was")) > GROWTH))
    rest = grown.withColumn("_next", F.lead(ms).over(w)).where((F.col(size) >= READY_CHARS) & (F.coalesce("_next", F.lit(1 << 60)) - F.col(ms) >= REST_MS))
    first = rest.groupBy(*keys).agg(F.min(F.col(ms) + REST_MS).alias("_at"))
    settled = F.coalesce(F.col("_at") <= WAIT_MS, F.lit(False))
    return sizes.select(*keys).distinct().join(first, list(keys), "left").select(*keys, F.when(settled, F.col("_at")).otherwise(WAIT_MS).cast("bigint").alias("ready_ms"), settled.alias("settled"))
