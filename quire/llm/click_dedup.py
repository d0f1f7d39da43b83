"""Repeats of clicks within expiring windows, as a stateful stream.

A click_id's first row opens a window; rows whose hour is up to WINDOW later repeat it, a later one closes it and
opens another, and a window that the watermark has passed closes by a timeout.  Windows of click_ids live in buckets
of a bounded number of rows, as a call of Python per click_id would cost some hundred times its work: a bucket's
state is a tuple of packed columns, a row per open window, and its timeout is the earliest deadline among them.
Within a bucket the rows of a micro-batch are gathered chunk by chunk into plain arrays, sorted by click_id, hour
and hash, and folded for all click_ids at once, a round per window.

``cut`` deals a table of clicks into batches (files in the shared folder), rows that are alike in one batch summed up
before they meet; ``deduplicate`` feeds them to a query that is started anew for each batch on one checkpoint.  The
watermark that the checkpoint keeps decides what is late, and a sentinel row beyond all hours flushes what is open.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quire.llm.common import scratch_path

BATCHES = 8
#: Hours that a window is open for, and that a row may be behind the largest hour of earlier batches.
WINDOW, DELAY = 24, 96
#: Copies of all batches that a bucket of click_ids takes, about.
BUCKET_ROWS = 50_000

FEED = "bucket bigint, click_id bigint, hour bigint, hash binary, crc bigint, n bigint"
STATE = "click_id binary, start_hour binary, hash binary, n_repeats binary, n_conflicts binary, conflict_crc binary"
WINDOWS = "click_id bigint, start_hour bigint, closed_batch bigint, n_repeats bigint, n_conflicts bigint, conflict_crc bigint, hash string"
_HOUR_MS = 3_600_000


def micros(column: str, df: DataFrame):
    """Microseconds since 1970 of a timestamp; one without a zone is read as UTC, whatever the session's zone."""
    c = F.col(f"`{column}`")
    if df.schema[column].dataType.typeName() == "timestamp":
        return F.unix_micros(c)
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = days * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def copies(clicks: DataFrame) -> DataFrame:
    """(click_id, hour, place, hash: binary) of the copies of each row; hour and place order them, ``cut`` takes these columns.

    A row without click_id or arrived_at has no copies, as neither their number nor their hour is known; nor has a
    negative click_id that 3 does not divide, whose remainder is negative.  Other nulls are empty in the hash.
    """
    told = clicks.select(
        "click_id", F.floor(micros("arrived_at", clicks) / 3_600_000_000).alias("first"), F.explode(F.expr("sequence(0, greatest(click_id % 3, 0))")).alias("j"),
        F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in (F.col("client_id"), F.col("kind"), F.floor(100 * F.col("value") + 0.5), micros("ts", clicks), F.col("props"))]).alias("content"),
    ).where("click_id % 3 >= 0 and first is not null")
    told = told.withColumn("c", F.crc32(F.concat_ws(":", "click_id", "j").cast("binary"))).withColumn("hour", F.col("first") + 6 * F.col("j") * (F.col("c") % 10))
    return told.select("click_id", "hour", (F.col("hour") + F.floor(F.col("c") / 10) % 200).alias("place"), F.unhex(F.sha2(F.concat_ws("|", "content", F.col("c") % 3), 256)).alias("hash"))


def cut(spark: SparkSession, rows: DataFrame, folder: str, batches: int = BATCHES) -> tuple[DataFrame, int | None]:
    """Rows (click_id, hour, place, hash) dealt by place into ``batches`` equal stretches, written to ``folder``; and their largest hour."""
    low, high, hour, n = rows.agg(F.min("place"), F.max("place"), F.max("hour"), F.count("*")).first()
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_ROWS))
    if n:
        batch = F.floor((F.col("place") - low) * batches / (high - low + 1)).cast("int")
        # rows that are alike are one row with a count: a click_id of very many rows is summed up by the tasks that read it
        alike = rows.groupBy(batch.alias("batch"), "click_id", "hour", "hash").agg(F.count("*").alias("n"))
    else:
        alike = rows.select(F.lit(0).alias("batch"), "click_id", "hour", "hash", F.lit(1).cast("bigint").alias("n"))
    bucket, crc = F.pmod(F.xxhash64("click_id"), F.lit(buckets)).alias("bucket"), F.crc32(F.lower(F.hex("hash")).cast("binary")).alias("crc")
    alike.select("batch", bucket, "click_id", "hour", "hash", crc, "n").write.partitionBy("batch").option("compression", "zstd").parquet(folder)
    return spark.read.schema(f"{FEED}, batch int").parquet(folder), hour


def _fold(rows: dict[str, np.ndarray], opened: dict[str, np.ndarray], window: int) -> tuple[dict[str, np.ndarray], list[dict[str, np.ndarray]]]:
    """The windows open after the rows of a batch, and those closed by them; ``opened`` is ordered by click_id."""
    order = np.lexsort((*rows["hash"].T[::-1], rows["hour"], rows["click_id"]))
    rows = {k: v[order] for k, v in rows.items()}
    ids, at = np.unique(rows["click_id"], return_index=True)
    end = np.append(at[1:], len(order))
    base = rows["hour"].min()
    span = int(rows["hour"].max() - base) + 2
    place = np.repeat(np.arange(len(ids)), end - at) * span + rows["hour"] - base + 1  # ascends with the rows
    # the state of each click_id of the batch: what is open, or nothing yet
    now = {k: np.zeros((len(ids), *v.shape[1:]), v.dtype) for k, v in opened.items()}
    now["click_id"] = ids
    found = np.searchsorted(opened["click_id"], ids)
    has = np.zeros(len(ids), bool)
    inside = found < len(opened["click_id"])
    has[inside] = opened["click_id"][found[inside]] == ids[inside]
    for k, v in now.items():
        v[has] = opened[k][found[has]]
    closed, left, fresh = [], np.arange(len(ids)), ~has
    while len(left):
        begins = left[fresh[left]]
        first = at[begins]
        now["start_hour"][begins], now["hash"][begins] = rows["hour"][first], rows["hash"][first]
        now["n_repeats"][begins] = rows["n"][first] - 1  # those that are alike
        now["n_conflicts"][begins] = now["conflict_crc"][begins] = 0
        at[begins] += 1
        until = np.searchsorted(place, left * span + np.clip(now["start_hour"][left] + window - base + 1, 0, span - 1), "right")
        until = np.clip(until, at[left], end[left])
        size = until - at[left]
        owner = np.repeat(left, size)
        row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[left], size)
        unlike = (rows["hash"][row] != now["hash"][owner]).any(axis=1) * rows["n"][row]
        np.add.at(now["n_repeats"], owner, rows["n"][row])
        np.add.at(now["n_conflicts"], owner, unlike)
        np.add.at(now["conflict_crc"], owner, unlike * rows["crc"][row])
        at[left] = until
        left = left[until < end[left]]
        fresh[left] = True
        if len(left):
            closed.append({k: v[left] for k, v in now.items()})
    rest = ~np.isin(opened["click_id"], ids)
    both = {k: np.concatenate([v[rest], now[k]]) for k, v in opened.items()}
    order = np.argsort(both["click_id"])
    return {k: v[order] for k, v in both.items()}, closed


def _unpacked(state) -> dict[str, np.ndarray]:
    names = [x.split()[0] for x in STATE.split(", ")]
    columns = state.get if state.exists else [b""] * len(names)
    return {k: _digests(v) if k == "hash" else np.frombuffer(v, np.int64) for k, v in zip(names, columns, strict=True)}


def _digests(raw: bytes) -> np.ndarray:
    """Digests of 32 bytes as four numbers each, which have the digests' order."""
    return np.frombuffer(raw, ">u8").reshape(-1, 4).astype(np.uint64)


def _raw(digests: np.ndarray) -> bytes:
    return digests.astype(">u8").tobytes()


def _told(windows: list[dict[str, np.ndarray]], batch: int) -> pd.DataFrame:
    x = {k: np.concatenate([w[k] for w in windows]) for k in windows[0]}
    raw = _raw(x.pop("hash")).hex()
    return pd.DataFrame(x | {"closed_batch": batch, "hash": [raw[i : i + 64] for i in range(0, len(raw), 64)]})[[x.split()[0] for x in WINDOWS.split(", ")]]


def folding(batch: int, window: int = WINDOW) -> Callable:
    """The stateful function of a start: windows that it closes carry the number of its batch."""

    def run(key, chunks, state):
        if key[0] < 0:  # the sentinel: only its hour counts
            for _ in chunks:
                pass
            return
        opened = _unpacked(state)
        if state.hasTimedOut:
            over = (opened["start_hour"] + window) * _HOUR_MS < state.getCurrentWatermarkMs()
            closed = [{k: v[over] for k, v in opened.items()}]
            opened = {k: v[~over] for k, v in opened.items()}
        else:
            parts: dict[str, list[np.ndarray]] = {"click_id": [], "hour": [], "crc": [], "n": [], "hash": []}
            for chunk in chunks:
                for k, to in parts.items():
                    to.append(_digests(b"".join(chunk["hash"])) if k == "hash" else chunk[k].to_numpy(np.int64))
            rows = {k: np.concatenate(v) for k, v in parts.items()}
            opened, closed = _fold(rows, opened, window) if len(rows["hour"]) else (opened, [])
        if len(opened["click_id"]):
            state.update(tuple(_raw(v) if k == "hash" else v.tobytes() for k, v in opened.items()))
            state.setTimeoutTimestamp((int(opened["start_hour"].min()) + window) * _HOUR_MS)
        else:
            state.remove()
        if any(len(x["click_id"]) for x in closed):
            yield _told(closed, batch)

    return run


def deduplicate(dealt: DataFrame, last_hour: int | None, batches: int = BATCHES, window: int = WINDOW, delay: int = DELAY) -> DataFrame:
    """(click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash), one row per window, of what ``cut`` has dealt.

    Rows more than ``delay`` hours behind the largest hour of earlier batches are late and dropped; windows whose
    last hour is behind that too close.  Every call uses a new folder.  An empty table gives an empty one; hours lie
    between the years 1678 and 2261, the range of the times that pandas holds.
    """
    spark = dealt.sparkSession
    folder = scratch_path(spark, "clicks")
    names = [x.split()[0] for x in FEED.split(", ")]

    def start(batch: int, rows: DataFrame) -> None:
        rows.write.mode("append").option("compression", "zstd").parquet(f"{folder}/feed")
        fed = spark.readStream.schema(FEED).parquet(f"{folder}/feed").withColumn("at", F.timestamp_seconds(F.col("hour") * 3_600))
        # a row is late at or below the watermark: a millisecond more keeps those that are as old as allowed
        held = fed.withWatermark("at", f"{delay} hours 1 millisecond").groupBy("bucket")
        closed = held.applyInPandasWithState(folding(batch, window), WINDOWS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
        query = closed.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/windows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    for batch in range(batches):
        start(batch, dealt.where(F.col("batch") == batch).select(names))
    beyond = (last_hour or 0) + window + delay + 1
    start(batches - 1, spark.sql(f"select -1L as bucket, 0L as click_id, {beyond}L as hour, cast('' as binary) as hash, 0L as crc, 0L as n"))
    return spark.read.schema(WINDOWS).parquet(f"{folder}/windows")
