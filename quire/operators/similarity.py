"""Joins of sets by similarity."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.sequences import alike_pairs, one_to_one
from quire.functions.text import jaccard


def candidates(left: DataFrame, right: DataFrame, *keys: str, a: str = "a", r: str = "r", tokens: str = "tokens", least: float = 0.5) -> DataFrame:
    """(keys, a, r) of the pairs that can reach ``least``: sets that share one of the first tokens of each, of sizes near enough.

    Tokens are ordered by how often they occur among the rows of the same keys, the rarest first: of sets that are
    alike enough the first len - least * len + 1 tokens have one in common, so rows that meet grow with rare tokens
    shared, not with common ones.  Two empty sets meet.
    """
    sets = left.select(*keys, F.lit(0).alias("_side"), F.col(a).alias("_id"), F.col(tokens).alias("_s")).unionByName(right.select(*keys, F.lit(1).alias("_side"), F.col(r).alias("_id"), F.col(tokens).alias("_s")))
    each = sets.select(*keys, "_side", "_id", F.size("_s").alias("_n"), F.explode("_s").alias("_t"))
    often = each.groupBy(*keys, "_t").agg(F.count("*").alias("_k"), F.count_distinct("_side").alias("_sides"))
    ranked = each.join(often, [*keys, "_t"]).groupBy(*keys, "_side", "_id", "_n").agg(F.array_sort(F.collect_list(F.struct("_k", "_t", "_sides"))).alias("_r"))
    first = F.slice("_r", F.lit(1), F.col("_n") - F.ceil(least * F.col("_n") - 1e-9).cast("int") + 1)
    probes = ranked.select(*keys, "_side", "_id", "_n", F.explode(F.filter(first, lambda x: x["_sides"] == 2)).alias("_p")).select(*keys, "_side", "_id", "_n", F.col("_p._t").alias("_t"))
    empty = sets.where(F.size("_s") == 0).select(*keys, "_side", "_id", F.lit(0).alias("_n"), F.lit("").alias("_t"))
    probes = probes.unionByName(empty)
    x = probes.where("_side = 0").select(*keys, "_t", F.col("_id").alias(a), F.col("_n").alias("_na"))
    y = probes.where("_side = 1").select(*keys, "_t", F.col("_id").alias(r), F.col("_n").alias("_nr"))
    near = (least * F.col("_na") <= F.col("_nr") + 1e-9) & (least * F.col("_nr") <= F.col("_na") + 1e-9)
    return x.join(y, [*keys, "_t"]).where(near).select(*keys, a, r).distinct()


def similar_sets(left: DataFrame, right: DataFrame, *keys: str, a: str = "a", r: str = "r", tokens: str = "tokens", least: float = 0.5) -> DataFrame:
    """(keys, a, r, score): pairs of rows of equal keys whose token sets have a Jaccard similarity of ``least`` or more.

    ``a`` and ``r`` name a row within its keys; ``tokens`` is an array without repeats and without ''.  Two empty sets are alike.  The
    sets themselves are joined to the candidates by id, so they don't travel with their tokens.
    """
    met = candidates(left, right, *keys, a=a, r=r, tokens=tokens, least=least)
    with_left = met.join(left.select(*keys, a, F.col(tokens).alias("_a")), [*keys, a])
    scored = with_left.join(right.select(*keys, r, F.col(tokens).alias("_r")), [*keys, r]).withColumn("score", jaccard(F.col("_a"), F.col("_r")))
    return scored.where(F.col("score") >= least).select(*keys, a, r, "score")


#: Documents and pairs that are Python objects at a time, at most.
DOCUMENTS, PAIRS = 32, 50_000


def similar_within(left: DataFrame, right: DataFrame, *keys: str, a: str = "a", r: str = "r", tokens: str = "tokens", least: float = 0.5, best: bool = False) -> DataFrame:
    """``similar_sets`` for keys that name a document: its sets meet by one grouping and are looked up by their rarest words there.

    Tokens hold no white space.  Every set travels once, where a join over words carries each word of each set several times.
    With ``best`` the pairs of a document are taken one to one, the best first; ties by ``a``, then ``r``.
    """
    own = {x: df.schema[x].dataType.simpleString() for x, df in ((a, left), (r, right))}
    sides = [df.groupBy(*keys).agg(F.collect_list(x).alias(f"_{x}"), F.collect_list(F.array_join(tokens, " ")).alias(f"_{x}_said")) for df, x in ((left, a), (right, r))]
    met = sides[0].join(sides[1], list(keys)).select(*keys, f"_{a}", f"_{a}_said", f"_{r}", f"_{r}_said")
    return _pairs_of_rows(met, keys, own, least, best)


def similar_of_two(documents: DataFrame, left: str, right: str, *keys: str, a: str = "a", r: str = "r", least: float = 0.5) -> DataFrame:
    """(keys, a, r, score): ``similar_within`` of rows that hold both sides as arrays of texts, their sets as words between blanks; ``a`` and ``r`` are places."""
    places = lambda c: F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))
    return _pairs_of_rows(documents.select(*keys, places(left).alias("_a"), left, places(right).alias("_r"), right), keys, {a: "int", r: "int"}, least, False)


def _pairs_of_rows(met: DataFrame, keys: tuple[str, ...], own: dict[str, str], least: float, best: bool) -> DataFrame:
    """The pairs of rows (keys, places, their sets, other places, their sets)."""
    import pyarrow as pa

    n, names = len(keys), [*keys, *own, "score"]

    def pairs(row):
        places, said, others, told = row[n:]
        found = alike_pairs([frozenset(x.split()) for x in said], [frozenset(x.split()) for x in told], least)
        found = ((s, places[x], others[y]) for s, x, y in found)
        return ((*row[:n], x, y, s) for s, x, y in (one_to_one(list(found)) if best else found))

    def run(batches):
        for b in batches:
            types = [*b.schema.types[:n], b.schema.types[n].value_type, b.schema.types[n + 2].value_type, pa.float64()]
            for at in range(0, b.num_rows, DOCUMENTS):
                rows = zip(*(c.to_pylist() for c in b.slice(at, DOCUMENTS).columns), strict=True)
                found = (p for row in rows for p in pairs(row))
                while some := list(islice(found, PAIRS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)

    fields = [f"`{k}` {met.schema[k].dataType.simpleString()}" for k in keys] + [f"`{x}` {t}" for x, t in own.items()]
    return met.mapInArrow(run, ", ".join([*fields, "score double"]))
