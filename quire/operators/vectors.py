"""Vector operators: similarity, centrality, extractive selection."""

from __future__ import annotations

import zlib
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.numbers import cosine
from quire.session import written

#: Vectors of a group in one block, and rows of a block multiplied at once.
BLOCK, TILE = 2_048, 256
#: Vectors of a group that goes through as one row, at most; such groups are most, and a call of Python for each would cost more than its product.
SMALL = 64


def centrality(vectors: DataFrame, *keys: str, id_col: str = "vec_id", vector: str = "embedding", encoder=None) -> DataFrame:
    """(keys, id, score): mean of the positive similarities to the others of the group; 1 for a group of one.

    With an ``encoder`` the column ``vector`` holds texts (of a table, as they are read twice), which become vectors once, where they are compared.

    A group is dealt into blocks of BLOCK vectors, and each pair of blocks is one product in a task, of which only the
    sum of each vector leaves: a vector is sent once for each block of its group, and no row is made for a pair.
    Vectors of a group are of one length and unit norm; rows of one id are not compared with each other.  A group of SMALL vectors at most is a row.
    """
    import numpy as np
    import pyarrow as pa

    vectors = vectors.select(*keys, id_col, vector)
    if encoder is None:
        vectors = written(vectors, "vectors")  # a model runs once
    sizes = vectors.groupBy(*keys).agg(F.count("*").alias("_n"))
    few, many = sizes.where(F.col("_n") <= SMALL), sizes.where(F.col("_n") > SMALL)
    large = vectors.join(many, list(keys))
    if encoder is not None:
        large = encode(large, vector, encoder=encoder).drop(vector).withColumnRenamed("embedding", vector)
    dealt = large.withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(id_col), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = dealt.select(*keys, id_col, vector, "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))

    def run(table: pa.Table) -> pa.Table:
        own, first = table.column("_own").to_numpy(), table.column("_i")[0].as_py()
        flat = table.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x, ids, total = flat.reshape(len(own), -1), table.column(id_col).to_numpy(), np.zeros(len(own))
        rows, cols = np.flatnonzero(own == first), np.flatnonzero(own == table.column("_j")[0].as_py())
        for s in range(0, len(rows), TILE):
            at = rows[s : s + TILE]
            sim = np.clip(x[at] @ x[cols].T, 0, 1)
            sim[ids[at, None] == ids[None, cols]] = 0
            total[at] += sim.sum(axis=1)
            if first != table.column("_j")[0].as_py():
                total[cols] += sim.sum(axis=0)
        return table.select([*keys, id_col]).append_column("s", pa.array(total))

    fields = ", ".join(f"`{k}` {vectors.schema[k].dataType.simpleString()}" for k in (*keys, id_col))
    sums = met.groupBy(*keys, "_i", "_j").applyInArrow(run, f"{fields}, s double")

    def whole(batches):
        for b in batches:
            ids, flat = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            ends, x = ids.offsets.to_numpy() - ids.offsets[0].as_py(), flat.flatten()
            x = x.flatten().to_numpy(zero_copy_only=False) if encoder is None else np.asarray(encoder(x.to_pylist()), np.float32).reshape(-1)
            x = x.astype(np.float64)
            names, total = ids.flatten(), np.zeros(ends[-1])
            own, x = names.to_numpy(zero_copy_only=False), x.reshape(ends[-1], -1) if ends[-1] else x
            for s, e in zip(ends, ends[1:]):
                sim = np.clip(x[s:e] @ x[s:e].T, 0, 1)
                sim[own[s:e, None] == own[None, s:e]] = 0
                total[s:e] = sim.sum(axis=1)
            of = pa.array(np.repeat(np.arange(b.num_rows), np.diff(ends)))
            yield pa.RecordBatch.from_arrays([*[c.take(of) for c in b.columns[:-2]], names, pa.array(total)], [*keys, id_col, "s"])

    rows = vectors.join(few, list(keys)).groupBy(*keys).agg(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(vector).alias("v"))).alias("_r"))
    sums = sums.unionByName(rows.select(*keys, "_r.i", "_r.v").mapInArrow(whole, f"{fields}, s double"))
    total = sums.groupBy(*keys, id_col).agg(F.sum("s").alias("s")).join(sizes, list(keys))
    return total.select(*keys, id_col, F.when(F.col("_n") == 1, 1.0).otherwise(F.col("s") / (F.col("_n") - 1)).alias("score"))


def target_count(length: Column) -> Column:
    """How many sentences stand for a text of so many characters."""
    return F.when(length < 500, 2).when(length < 2000, 3).when(length < 8000, 5).when(length < 20000, 7).otherwise(9)


def select_top(scored: DataFrame, n: Column, *keys: str, order: str = "start") -> DataFrame:
    """The ``n`` best rows of each group (one at least), numbered in reading order."""
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), order)
    kept = scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= F.greatest(F.lit(1), n)).drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def similarity_to(vectors: DataFrame, query: list[float], vector: str = "embedding") -> DataFrame:
    """Vectors with ``similarity`` to one query vector."""
    return vectors.withColumn("similarity", cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])))


def hashed_vectors(texts, dim: int = 64):
    """The stand-in encoder: unit vectors of hashed words, one per text."""
    import numpy as np

    words = [(t or "").lower().split() for t in texts]
    codes = np.fromiter(map(zlib.crc32, map(str.encode, chain.from_iterable(words))), np.int64)
    at = np.repeat(np.arange(len(words)) * dim, [len(own) for own in words]) + codes % dim
    out = np.bincount(at, (codes >> 31) * 2 - 1, len(words) * dim).reshape(-1, dim).astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def encode(texts: DataFrame, text: str = "sentence", dim: int = 64, encoder=hashed_vectors) -> DataFrame:
    """texts with ``embedding``; ``encoder`` maps a list of texts to a matrix and may be any model."""
    import pandas as pd
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("array<float>")
    def run(column):
        return pd.Series(list(encoder(column.tolist())) if len(column) else [], dtype="object")

    return texts.withColumn("embedding", run(F.col(text)))
