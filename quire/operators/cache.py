"""Keyed stores: upsert, eviction, hits and misses, time limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPS = {"sentiment": 80, "redline": 80, "analysis": 160, "summary": 600}


def upsert(store: DataFrame, new: DataFrame, *keys: str, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The latest record of each key of both tables."""
    order = [F.col(ts).desc(), *([F.col(tie).desc()] if tie else [])]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return store.unionByName(new).withColumn("_n", n).where("_n = 1").drop("_n")


def evictions(store: DataFrame, cap: int, *keys: str, ts: str = "ts") -> DataFrame:
    """Keys of the oldest records beyond ``cap``.

    The ``cap`` latest are a top-k, so the store is never sorted in one task.
    """
    kept = store.orderBy(F.col(ts).desc(), *[F.col(k).desc() for k in keys]).limit(cap).select(*keys)
    return store.select(*keys, ts).join(F.broadcast(kept) if cap <= 100_000 else kept, list(keys), "left_anti")


def delete(store: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return store.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def lookup(wanted: DataFrame, store: DataFrame, *keys: str, model: str | None = None) -> DataFrame:
    """wanted with ``hit`` and the store's columns; a record of another model is a miss."""
    own = store if model is None else store.where(F.col("model") == model)
    return wanted.join(own.withColumn("hit", F.lit(True)), list(keys), "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def prefer_register(store: DataFrame, *keys: str, registers: tuple[str, ...] = ("builtin", "extractive"), register: str = "register") -> DataFrame:
    """Of each key the record of the first register that has one."""
    rank = F.array_position(F.array(*[F.lit(r) for r in registers]), F.col(register))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(rank))
    return store.where(rank > 0).withColumn("_n", n).where("_n = 1").drop("_n")


def limited_starts(requests: DataFrame, *keys: str, arrival: str = "ms", order: str = "seq", gap: int = 125) -> DataFrame:
    """requests with ``start``: each at its arrival, but ``gap`` after the one before at least.

    start_i = max over j <= i of (arrival_j - j gap) + i gap, so no request waits for another's result.
    """
    w = Window.partitionBy(*keys).orderBy(arrival, order)
    numbered = requests.withColumn("_i", F.row_number().over(w) - 1)
    top = F.max(F.col(arrival) - F.col("_i") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("start", top + F.col("_i") * gap).drop("_i")


def backoff(attempt, jitter, retry_after=None, base: int = 600):
    """Milliseconds before retry ``attempt`` (from 0): doubling, with jitter; what the server asks for wins."""
    own = base * F.pow(F.lit(2.0), attempt) + jitter
    return own if retry_after is None else F.coalesce(retry_after, own)


def gaps(events: DataFrame, *keys: str, ts: str = "ts", value: str | None = None, seconds: int = 45, tie: str | None = None) -> DataFrame:
    """Events after which nothing new came for ``seconds``; with ``value`` a repeated value is nothing new."""
    w = Window.partitionBy(*keys).orderBy(ts, *([tie] if tie else []))
    rows = events if value is None else events.withColumn("_was", F.lag(value).over(w)).where(F.col("_was").isNull() | (F.col("_was") != F.col(value))).drop("_was")
    nxt = rows.withColumn("next_ts", F.lead(ts).over(w))
    wait = F.unix_timestamp(F.col("next_ts").cast("timestamp")) - F.unix_timestamp(F.col(ts).cast("timestamp"))
    return nxt.withColumn("wait", wait).where(F.col("wait") > seconds)


def ema(values, keep: float = 0.7):
    """Exponential mean of an array in order; the first value seeds it."""
    return F.aggregate(values, F.lit(0.0), lambda m, v: F.when(m == 0, v).otherwise(m * keep + v * (1 - keep)))


def ttl_hits(reads: DataFrame, *keys: str, ts: str = "ms", order: str = "seq", ttl: int = 30 * 60 * 1000) -> DataFrame:
    """(keys, hits, misses): reads of a cache whose entries live ``ttl`` from their writing, which reads don't renew."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(ts, order))), lambda x: x[ts])

    def step(acc, t):
        hit = acc["at"].isNotNull() & (t - acc["at"] < ttl)
        return F.struct(F.when(hit, acc["at"]).otherwise(t).alias("at"), (acc["hits"] + hit.cast("bigint")).alias("hits"), (acc["misses"] + (~hit).cast("bigint")).alias("misses"))

    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit(None).cast("bigint").alias("at"), zero.alias("hits"), zero.alias("misses"))
    return reads.groupBy(*keys).agg(F.aggregate(rows, start, lambda a, t: step(a, t)).alias("r")).select(*keys, "r.hits", "r.misses")


def load_progress(events: DataFrame, *keys: str, file: str = "file", loaded: str = "loaded", size: str = "size", order: str = "seq") -> DataFrame:
    """(keys, order, share): share of all bytes loaded after each event; a file's count is clamped and never falls."""
    w = Window.partitionBy(*keys, file).orderBy(order)
    best = F.max(F.least(F.col(loaded), F.col(size))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    grown = events.withColumn("_best", best)
    more = F.col("_best") - F.coalesce(F.lag("_best").over(w), F.lit(0))
    total = events.select(*keys, file, size).distinct().groupBy(*keys).agg(F.sum(size).alias("_total"))
    run = F.sum("_more").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return grown.withColumn("_more", more).withColumn("_run", run).join(total, list(keys)).select(*keys, order, (F.col("_run") / F.col("_total")).alias("share"))


def drop_all(*stores: DataFrame) -> list[DataFrame]:
    """The same stores without records: what is written over them to clear every cache at once."""
    return [s.limit(0) for s in stores]


def session_of(store: DataFrame, model: DataFrame, *keys: str) -> DataFrame:
    """The session store after a document was opened: its record alone, all others evicted."""
    return model.select(*store.columns).unionByName(store.join(model.select(*keys), list(keys), "left_semi").limit(0))


def read_session(store: DataFrame, flags: DataFrame, *keys: str) -> DataFrame:
    """The record of the session with its flags, an empty list where there are none."""
    own = flags.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[c for c in flags.columns if c not in keys]))).alias("flags"))  # of one document
    return store.join(own, list(keys), "left").withColumn("flags", F.coalesce("flags", F.array()))


def last_in_flight(requests: DataFrame, *keys: str, ts: str = "ts", tie: str = "seq") -> DataFrame:
    """requests with ``aborted``: only the newest of a key runs, each older one is aborted by the next, at ``aborted_at``."""
    following = F.lead(ts).over(Window.partitionBy(*keys).orderBy(ts, tie))
    return requests.withColumn("aborted_at", following).withColumn("aborted", F.col("aborted_at").isNotNull())


def replay(cached: DataFrame, live: DataFrame, *keys: str) -> DataFrame:
    """Events of a run: those that the cache holds first, marked ``replayed``, then the live ones of other keys."""
    old = cached.withColumn("replayed", F.lit(True))
    return old.unionByName(live.join(cached.select(*keys).distinct(), list(keys), "left_anti").withColumn("replayed", F.lit(False)))
