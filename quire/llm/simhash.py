"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints (64 bits) are split into groups of *correlated* bits.  If the groups get
thresholds t_i >= -1 with sum(t_i + 1) = radius + 1, two fingerprints within the radius
agree to within t_i bits in one group at least.  The thresholds are chosen by dynamic
programming over estimated candidate counts (taken from all fingerprints), so a skewed
group may be skipped (t = -1) while a well spread one is probed with more errors.

Equal fingerprints are one class before anything is compared.  A probe bucket of up to
``bucket_limit`` classes is verified in its task and reported as a spanning forest.  A
larger bucket is never gathered: its classes are grouped by the points within radius/2 of
them, as two fingerprints within an even radius always share such a point, and two that
share one are within the radius.  That is exact and linear in the bucket.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER_ASCII, materialise, utf8
from quire.llm.components import connected_components

BITS = 64
#: Numbers of bit groups that are weighed against each other.
GROUPINGS = (2, 3, 4)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned SimHash of a text; 0 for a text without words."""
    words = utf8(text).translate(LOWER_ASCII).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long, one row per input row."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _bit_statistics(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of classes and the 64 x 64 matrix of joint ones, summed over all of them."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for i in range(0, len(x), 65536):
                total += x[i : i + 65536].T @ x[i : i + 65536]
            n += len(x)
        i, j = np.indices((BITS, BITS))
        ij = np.append((i * BITS + j).ravel(), -1)
        yield pa.RecordBatch.from_arrays([pa.array(ij, pa.int32()), pa.array(np.append(total.ravel(), n))], ["ij", "n"])

    out, n = np.zeros(BITS * BITS), 0
    for r in classes.select("fp").mapInArrow(run, "ij int, n double").groupBy("ij").agg(F.sum("n").alias("n")).collect():  # 4,097 rows always
        if r.ij < 0:
            n = int(r.n)
        else:
            out[r.ij] = r.n
    return n, out.reshape(BITS, BITS)


def group_bits(joint: np.ndarray, n: int, groups: int) -> list[list[int]]:
    """Split the bits into groups of near-equal size, correlated bits together (greedy, by absolute correlation)."""
    p = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(groups):
        size = len(left) // (groups - k)
        seed = max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())
        own = [seed]
        left.discard(seed)
        while len(own) < size:
            best = max(sorted(left), key=lambda b: corr[b, own].sum())
            own.append(best)
            left.discard(best)
        out.append(sorted(own))
    return out


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = radius + 1 of least total cost; costs[i][t + 1] is group i's cost at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, picked) in best.items():
            for step, more in enumerate(row):
                if used + step <= radius + 1 and (used + step not in nxt or cost + more < nxt[used + step][0]):
                    nxt[used + step] = (cost + more, [*picked, step - 1])
        best = nxt
    return best[radius + 1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def plan_probes(classes: DataFrame, radius: int, groupings: tuple[int, ...] = GROUPINGS) -> tuple[list[int], dict]:
    """The masks under which fingerprints are compared for equality, and what led to them."""
    n, joint = _bit_statistics(classes)
    p = np.diag(joint) / max(n, 1)
    splits = {m: group_bits(joint, n, m) for m in groupings}
    masks = [sum(1 << b for b in bits) for m in groupings for bits in splits[m]]
    rows = classes.select(F.posexplode(F.array(*[F.lit(_signed(x)) for x in masks])).alias("k", "mask"), "fp").select("k", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    pairs = {r.k: float(r.pairs) for r in rows.groupBy("k", "key").count().groupBy("k").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}  # a row per mask
    k, best = 0, (np.inf, [], [])
    for m in groupings:
        costs = []
        for bits in splits[m]:
            ratio = np.array([2 * p[b] * (1 - p[b]) / max(p[b] ** 2 + (1 - p[b]) ** 2, 1e-9) for b in bits])
            row, grow = [0.0], 1.0
            for t in range(radius + 1):
                probes = float(len(list(combinations(bits, t)))) * n if t <= len(bits) else np.inf
                grow = 1.0 if t == 0 else grow + ratio.sum() ** t / np.prod(range(1, t + 1))
                row.append(4 * probes + pairs.get(k, 0.0) * grow)
            costs.append(row)
            k += 1
        cost, picked = allocate(costs, radius)
        if cost < best[0]:
            best = (cost, picked, splits[m])
    cost, picked, groups = best
    out = []
    for t, bits in zip(picked, groups, strict=True):
        whole = sum(1 << b for b in bits)
        if t >= 0:
            out += [_signed(whole & ~sum(1 << b for b in wild)) for wild in combinations(bits, t)]
    return out, {"thresholds": picked, "groups": groups, "cost": cost, "classes": n}


def _forest(batches, radius: int):
    """Verified links of each gathered bucket, as a spanning forest."""
    for b in batches:
        us, vs = [], []
        for fps in b.column(0):
            x = np.unique(np.array(fps.as_py(), dtype=np.int64))
            near = np.bitwise_count((x[:, None] ^ x[None, :]).view(np.uint64)) <= radius
            todo = set(range(1, len(x)))
            stack = [0]
            while stack or todo:
                if not stack:
                    stack.append(todo.pop())
                i = stack.pop()
                for j in [j for j in todo if near[i, j]]:
                    us.append(int(x[i]))
                    vs.append(int(x[j]))
                    todo.discard(j)
                    stack.append(j)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def fingerprint_links(classes: DataFrame, radius: int = 2, bucket_limit: int = 64) -> DataFrame:
    """Links (u, v) between distinct fingerprints that connect exactly what lies within the radius (even)."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius: 0, 2 or 4")
    masks, _ = plan_probes(classes, radius)
    keyed = classes.select(F.posexplode(F.array(*[F.lit(x) for x in masks])).alias("k", "mask"), "fp").select("k", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    full = materialise(keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = keyed.join(full, ["k", "key"])
    small = members.where(F.col("n") <= bucket_limit).groupBy("k", "key").agg(F.collect_list("fp").alias("fps"))
    near = small.select("fps").mapInArrow(lambda b: _forest(b, radius), "u bigint, v bigint")
    hot = members.where(F.col("n") > bucket_limit).select("fp").distinct()
    around = [_signed(sum(1 << b for b in flips)) for k in range(radius // 2 + 1) for flips in combinations(range(BITS), k)]
    hubs = materialise(hot.select("fp", F.explode(F.array(*[F.lit(x) for x in around])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub")), "hubs")
    heads = hubs.groupBy("hub").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1").select("hub", "head")
    linked = hubs.join(heads, "hub").where("fp <> head").select(F.col("fp").alias("u"), F.col("head").alias("v"))
    return near.union(linked).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42, bucket_limit: int = 64) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits,
    the row's own included.  A null or wordless text has fingerprint 0 and links like any other;
    repeated rows are equal texts; a null doc_id keeps its row and never names a component (null if no
    other id is reachable); an empty table gives an empty one; other columns are not read.
    """
    fps = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(fingerprint_links(classes.select("fp"), radius, bucket_limit))
    rooted = materialise(classes.join(roots, classes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")

