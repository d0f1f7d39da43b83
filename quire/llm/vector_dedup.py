"""Near duplicates among embeddings: p-stable Euclidean hashing, then exact cosines.

Vectors of length 1 with a cosine of c lie sqrt(2 - 2 c) apart.  Projections on Gaussian directions, shifted and cut
into cells of a width, agree the more often the nearer two vectors are; a table's key joins several of them, and as
many tables are taken as find a pair at the threshold with the wanted probability.  Vectors that share a key of a
table are compared exactly, in double precision, in the first table they share, so each pair once.

Equal vectors are one class with a count.  A bucket of more than BLOCK classes is dealt into blocks, and pairs of
blocks are compared by tasks of their own: no task holds a bucket, and no row is made per pair.  What leaves a task
is, per class, the number of vectors linked and the smallest class reached; components follow from the latter.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise, sparing
from quire.llm.components import connected_components

#: Width of a cell, in distances between vectors of length 1.
WIDTH = 2.0
#: Distance of vectors that have nothing in common.
FAR = math.sqrt(2)
#: Classes of a bucket, or of either side, that are compared in one go.
BLOCK = 512
#: Pairs looked at, and multiplied, at once.
PAIRS, PRODUCTS = 500_000, 20_000
SEED = 20_240_613


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one projection of two vectors at a distance falls into one cell."""
    r = width / distance
    return 1 - 2 * NormalDist().cdf(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """(projections of a key, tables): a vector meets about one unrelated one of ``rows`` a table, and a pair at the threshold is found with probability ``recall``."""
    near = collision(math.sqrt(2 - 2 * threshold))
    n = max(1, math.ceil(math.log(max(rows, 2)) / -math.log(collision(FAR))))
    return n, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(near**n))))


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows of length 1, in double precision; shorter vectors of a batch are filled up with zeros."""
    size = pc.list_value_length(vectors).to_numpy()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)  # so that no square is too large or too small
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _keys(projections: int, tables: int):
    """Adds a 32-bit key for each table to rows of (class, n, label, embedding)."""

    def run(batches):
        known = {}
        mix = np.random.default_rng(SEED).integers(1, 1 << 62, (tables, projections), np.uint64) | np.uint64(1)
        for b in batches:
            vectors = b.column("embedding")
            size = pc.list_value_length(vectors).to_numpy()
            keys = np.empty((len(size), tables), np.int32)
            for dim in np.unique(size).tolist():
                if dim not in known:
                    rng = np.random.default_rng((SEED, dim))
                    known[dim] = rng.standard_normal((dim, tables * projections)), rng.uniform(0, WIDTH, tables * projections)
                normal, shift = known[dim]
                at = np.flatnonzero(size == dim)
                cell = np.floor((_unit(vectors.take(pa.array(at))) @ normal + shift) / WIDTH).astype(np.int64).astype(np.uint64)
                mixed = (cell.reshape(len(at), tables, projections) * mix).sum(axis=2, dtype=np.uint64)  # wraps round
                keys[at] = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), keys.ravel())], [*b.schema.names, "keys"])

    return run


def _links(threshold: float):
    """(class, n_links, root) of the classes that link with others of their run; rows of a run follow one another."""

    def judge(rows: pa.Table, starts: np.ndarray):
        sizes = np.diff(starts, append=len(rows))
        pairs = np.cumsum(sizes * (sizes - 1) // 2)
        s = 0
        while s < len(starts):  # some runs at once
            e = max(s + 1, int(np.searchsorted(pairs, (pairs[s - 1] if s else 0) + PAIRS, "right")))
            end = starts[e] if e < len(starts) else len(rows)
            yield compare(rows.slice(starts[s], end - starts[s]), sizes[s:e])
            s = e

    def compare(rows: pa.Table, sizes: np.ndarray) -> pa.RecordBatch:
        cls, n, lo, hi, block, table = (rows.column(c).to_numpy() for c in ("class", "n", "lo", "hi", "block", "table"))
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
        after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(rows)) - 1  # rows of the run behind each
        left = np.repeat(np.arange(len(rows)), after)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
        new = (lo == hi)[left] | (block[left] != block[right])
        left, right = left[new], right[new]
        for t in range(int(table.max(initial=0))):  # pairs of an earlier table
            new = (table[left] <= t) | (keys[left, t] != keys[right, t])
            left, right = left[new], right[new]
        unit = _unit(rows.column("embedding").combine_chunks())
        near = [np.einsum("ij,ij->i", unit[left[i : i + PRODUCTS]], unit[right[i : i + PRODUCTS]]) >= threshold for i in range(0, len(left), PRODUCTS)]
        near = np.concatenate([np.zeros(0, bool), *near])
        left, right = left[near], right[near]
        links, root = np.zeros(len(rows), np.int64), cls.copy()
        np.add.at(links, left, n[right])
        np.add.at(links, right, n[left])
        while True:
            least = np.minimum(root[left], root[right])
            if (least == root[left]).all() and (least == root[right]).all():
                break
            np.minimum.at(root, left, least)
            np.minimum.at(root, right, least)
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(links[at]), pa.array(root[at])], ["class", "n_links", "root"])

    def run(batches):
        rest = None
        for b in batches:
            rows = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b]).combine_chunks()
            if not len(rows):
                continue
            change = np.zeros(len(rows), bool)
            change[0] = True
            for c in ("bucket", "label", "dim", "lo", "hi"):
                column = rows.column(c).combine_chunks()
                change[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(change)
            rest = rows.slice(starts[-1])
            if len(starts) > 1:
                yield from judge(rows.slice(0, starts[-1]), starts[:-1])
        if rest is not None:
            yield from judge(rest, np.zeros(1, np.int64))

    return sparing(run)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of rows (vec_id, embedding: array of numbers, label), one per input row.

    Rows of equal labels link at a cosine of ``threshold`` (above 0, below 1) or more; nothing below it links, and a
    pair at the threshold is found with probability ``recall``, a nearer one more surely.  A null label or vector, an
    empty or zero one, or one with a null or non-finite component links with nothing; so do vectors of different
    lengths.  Repeated rows are vectors of their own that link with each other.  component_id is the smallest vec_id
    reachable; a row without vec_id links like any other, is never kept, and is alone with a null component_id.
    Other columns are not read; an empty table gives an empty one.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (x > float("-inf")) & (x < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    classes = rows.where(usable).groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")  # an id is used as it was written
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    projections, tables = plan(most, threshold, recall)

    wide = classes.select("class", "n", "label", "embedding")
    keyed = materialise(wide.mapInArrow(_keys(projections, tables), f"{', '.join(f'{x.name} {x.dataType.simpleString()}' for x in wide.schema)}, keys array<int>"), "vector-keys")
    entries = keyed.select("class", "label", F.size("embedding").alias("dim"), F.posexplode("keys").alias("table", "key"))
    bucket = F.xxhash64("label", "dim", "table", "key").alias("bucket")  # rows of other labels that meet there are told apart later
    shared = entries.groupBy(bucket).agg(F.count("*").alias("size")).where("size > 1")
    placed = entries.select("class", "dim", "table", bucket).join(shared, "bucket")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.hash("class"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("class", "dim", "table", "bucket", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    met = placed.join(keyed, "class").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "label", "dim", "lo", "hi")
    found = materialise(met.mapInArrow(_links(threshold), "class bigint, n_links bigint, root bigint"), "vector-links")

    roots = connected_components(found.select(F.col("class").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("class"), "root")
    told = classes.select("class", "label", "embedding", "n", "least").join(found.groupBy("class").agg(F.sum("n_links").alias("more")), "class", "left").join(roots, "class", "left")
    told = told.withColumn("root", F.coalesce("root", "class"))
    least = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = told.join(least, "root").select("label", "embedding", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.where(usable).join(told, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
