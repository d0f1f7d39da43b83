"""Benchmark decontamination in built-in expressions only.

1. *Anchors.*  A window whose weighted shingle similarity to an item is at least ``s`` leaves at most
   k = floor(n (1 - s) / (1 + s)) of the item's n shingles unmatched, so of any k + 1 of them one is in the
   window.  Only these anchors of an item are looked up in the texts.  (A text shorter than the item may leave
   floor(n (1 - s)), and is looked up with as many more.)
2. *Windows.*  Every item-sized window that holds a found anchor is compared with the anchor's item, at whatever
   place of the window it stands: no window within the similarity is lost up to here.
3. *SimHash.*  The windows around an anchor overlap, so running sums of the bits, three counters to a long, are
   taken along the text once and each window's 64-bit fingerprint is a difference of two of them.
4. *Multi-index Hamming blocks.*  Fingerprints are cut into eight blocks with thresholds ``ERRORS``; within the
   radius sum(t + 1) - 1 two of them agree to within t bits in one block at least.  Items are indexed under the
   variants of each block, windows probed with their own blocks, so every fingerprint within the radius is found.
5. *Verification.*  Exact weighted Jaccard similarity of the shingle multisets decides.

The benchmark's own tables are broadcast only if their row count says so, and joined by a shuffle beyond.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialise, wrapped

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of each block that may differ.
ERRORS = (2, 2, 2, 2, 1, 1, 1, 1)
BLOCK = 64 // len(ERRORS)
RADIUS = sum(t + 1 for t in ERRORS) - 1
#: Rows of anchors or of the index (some 40 bytes each) that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Words of an item that are searched at once; a longer one is searched part by part.
LONGEST = 500_000
#: Three counters of 21 bits to a long: the bits j, j + 21 and j + 42 of a hash.
LANE = 21
LANES = sum(1 << LANE * k for k in range(3))
#: What names a stretch of a text in which an item is looked for.
KEY = ("doc_id", "text_key", "item", "stretch")


def words_of(text: Column) -> Column:
    """Runs of letters, marks and digits, lower-cased; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of ``size`` words, repeats included; empty for shorter texts."""
    n = F.size(words) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(F.array().cast("array<bigint>"))


def simhash_of(hashes: Column) -> Column:
    """64-bit fingerprint as a long: a bit is set if it is in more than half of the hashes."""
    n = F.size(hashes)

    def bit(b):
        ones = F.aggregate(hashes, F.lit(0), lambda a, h: a + F.getbit(h, b))
        return F.when(ones * 2 > n, F.expr("1")).otherwise(F.expr("0"))

    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), bit)
    return F.aggregate(F.reverse(bits), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x.cast("bigint")))


def _variants(fp: Column) -> Column:
    """array<struct<block, value>>: the blocks of a fingerprint with as many bits flipped, in every way, as may differ."""
    out = []
    for i, t in enumerate(ERRORS):
        ways = [sum(1 << b for b in bits) for k in range(t + 1) for bits in combinations(range(BLOCK), k)]
        out += [F.struct(F.lit(i).alias("block"), _block(fp, i).bitwiseXOR(F.lit(w).cast("bigint")).alias("value")) for w in ways]
    return F.array(*out)


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, i * BLOCK).bitwiseAND(F.lit((1 << BLOCK) - 1).cast("bigint"))


def _side(df: DataFrame) -> DataFrame:
    """A side of a join, broadcast behind a count of its rows only."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def item_index(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item, item_id, n, hashes, fp): the parts of all items that have a shingle; ``item`` numbers them."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(0), F.floor((F.size("words") - 1) / LONGEST).cast("int"))
    parts = words.where(F.size("words") > 0).select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i * LONGEST + 1, LONGEST))).alias("words"))
    items = parts.select("item_id", shingles_of(F.col("words"), shingle).alias("hashes")).where(F.size("hashes") > 0).distinct()
    return items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.size("hashes").alias("n"), "hashes", simhash_of(F.col("hashes")).alias("fp"))


def anchors_of(items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(anchor, item, n, only_short): shingles to look up; only_short ones in texts shorter than the item.

    floor(n (1 - s) / (1 + s)) + 1 of an item's shingles, spread evenly over it, and floor(n (1 - s)) + 1 for short texts.
    """
    n = F.size("hashes")

    def spread(share: float, only_short: bool) -> DataFrame:
        many = F.least(n, F.floor(n * share + 1e-9).cast("int") + 1)
        places = F.transform(F.sequence(F.lit(0), many - 1), lambda j: F.floor((j + 0.5) * n / many).cast("int"))
        return items.select("item", "n", F.explode(F.array_distinct(F.transform(places, lambda i: F.get("hashes", i)))).alias("anchor"), F.lit(only_short).alias("only_short"))

    every = spread((1 - similarity) / (1 + similarity), False).union(spread(1 - similarity, True))
    return every.groupBy("anchor", "item", "n").agg(F.min("only_short").alias("only_short"))


def stretches(docs: DataFrame, anchors: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(*KEY, n, wide, first, lo, hi, hashes): parts of texts in which windows hold an anchor.

    Windows of ``wide`` shingles that begin at lo to hi are meant; hashes are the shingles from ``first`` on, three
    times an item's at most.
    """
    # words are a column of their own, as within a lambda an expression would be evaluated for every shingle, and no rows
    # are left out for having none, as that filter would be pushed down to the scan, expression and all
    read = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words")).select("doc_id", "text_key", shingles_of(F.col("words"), shingle).alias("all"))
    if anchors.count() <= BROADCAST_ROWS:
        found = read.select("*", F.posexplode_outer("all").alias("at", "anchor")).join(F.broadcast(anchors), "anchor")
    else:  # texts don't travel with their shingles
        light = read.select("doc_id", "text_key", F.posexplode_outer("all").alias("at", "anchor")).join(anchors.hint("merge"), "anchor").withColumnsRenamed({"doc_id": "d", "text_key": "t"})
        found = light.join(read.distinct(), F.col("d").eqNullSafe(F.col("doc_id")) & F.col("t").eqNullSafe(F.col("text_key"))).drop("d", "t")
    size = F.size("all")
    stretch = F.floor(F.col("at") / F.col("n")).cast("int")
    first = F.greatest((stretch - 1) * F.col("n") + 1, F.lit(0))
    shaped = found.where(~F.col("only_short") | (size < F.col("n"))).select(
        "doc_id", "text_key", "item", stretch.alias("stretch"), "n", F.least("n", size).alias("wide"), first.alias("first"),
        F.greatest(F.col("at") - F.col("n") + 1, F.lit(0)).alias("lo"), F.least("at", F.greatest(size - F.col("n"), F.lit(0))).alias("hi"), F.slice("all", first + 1, 3 * F.col("n")).alias("hashes"),
    )
    return shaped.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("n", "wide", "first")], F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("hashes").alias("hashes"))


def window_fingerprints(found: DataFrame) -> DataFrame:
    """(*KEY, wide, start, fp) of every window of the stretches."""
    constant = [*KEY, "wide", "first", "lo", "hi"]
    rows = found.select(*constant, F.posexplode("hashes").alias("pos", "h"))
    so_far = Window.partitionBy(*constant).orderBy("pos")
    counters = [F.shiftright("h", j).bitwiseAND(F.lit(LANES)) for j in range(LANE)] + [F.shiftrightunsigned("h", 63)]
    summed = rows.select(*constant, "pos", *[F.sum(c).over(so_far).alias(f"c{j}") for j, c in enumerate(counters)])
    held = summed.groupBy(*constant).agg(F.array_sort(F.collect_list(F.struct("pos", *[f"c{j}" for j in range(LANE + 1)]))).alias("sums"))  # three times an item at most
    begun = held.select(*KEY, "wide", "first", "sums", F.explode(F.sequence("lo", "hi")).alias("start"))
    ends = begun.select(*KEY, "wide", "start", F.get("sums", F.col("start") - F.col("first") - 1).alias("a"), F.get("sums", F.col("start") - F.col("first") + F.col("wide") - 1).alias("b"))
    # a counter reaches its top bit if it is over half of the window
    lift = (F.lit(1 << LANE - 1) - F.floor(F.col("wide") / 2) - 1) * F.lit(LANES)
    apart = [F.col(f"b.c{j}") - F.coalesce(F.col(f"a.c{j}"), F.lit(0).cast("bigint")) for j in range(LANE + 1)]
    bits = [F.shiftleft(F.shiftright(c + lift, LANE - 1).bitwiseAND(F.lit(LANES)), j) for j, c in enumerate(apart[:LANE])]
    top = F.when(apart[LANE] * 2 > F.col("wide"), F.lit(-(1 << 63))).otherwise(F.lit(0).cast("bigint"))
    return ends.select(*KEY, "wide", "start", reduce(Column.bitwiseOR, [*bits, top]).alias("fp"))


def near_windows(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(window, *KEY, wide, start) of the windows within the radius of the item they are compared with; a table, ``window`` numbers them."""
    index = materialise(items.select(F.col("item").alias("i"), F.col("fp").alias("item_fp"), F.explode(_variants(F.col("fp"))).alias("v")).select("i", "item_fp", "v.*"), "index")
    probe = windows.select("*", F.posexplode(F.array(*[_block(F.col("fp"), k) for k in range(len(ERRORS))])).alias("b", "part"))
    hit = probe.join(_side(index), (F.col("item") == F.col("i")) & (F.col("b") == F.col("block")) & (F.col("part") == F.col("value")))
    near = hit.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*KEY, "wide", "start").distinct()
    return materialise(near.withColumn("window", F.monotonically_increasing_id()), "near")


def window_similarity(near: DataFrame, found: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item, start, similarity): the exact weighted Jaccard similarity of windows and their items.

    The sum of the lesser over the sum of the greater multiplicities, counted hash by hash.
    """
    own = found.select(*[F.col(c).alias(f"_{c}") for c in KEY], "first", "hashes")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
    texts = near.join(own, reduce(Column.__and__, same)).select("window", "item", F.slice("hashes", F.col("start") - F.col("first") + 1, F.col("wide")).alias("own"))
    # dealt by window once, whole: what is counted of it below stays where it is
    rows = texts.repartition("window").select("window", "item", F.explode("own").alias("h"))
    counted = rows.groupBy("window", "item", "h").agg(F.count("*").alias("k"))
    wanted = materialise(items.select(F.col("item").alias("i"), "n", F.explode("hashes").alias("wanted")).groupBy("i", "n", "wanted").agg(F.count("*").alias("m")), "wanted")
    met = counted.join(_side(wanted), (F.col("item") == F.col("i")) & (F.col("h") == F.col("wanted")))
    both = met.groupBy("window", "n").agg(F.sum(F.least("k", "m")).alias("both"))
    named = both.join(near, "window")
    return named.select("doc_id", "item", "start", (F.col("both") / (F.col("wide") + F.col("n") - F.col("both"))).alias("similarity"))


def short_item_hits(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame | None:
    """(doc_id, item_id, start, similarity) of items with fewer words than a shingle: wherever a text has exactly their words."""
    words = words_of(F.col("text"))
    few = materialise(benchmark.select("item_id", F.size(words).alias("n"), F.xxhash64(words).alias("wanted")).where((F.col("n") > 0) & (F.col("n") < shingle)).distinct(), "short")
    out = None
    for r in few.select("n").distinct().collect():  # fewer rows than words of a shingle
        grams = docs.select("doc_id", words.alias("words")).select("doc_id", F.posexplode_outer(shingles_of(F.col("words"), r.n)).alias("start", "h"))
        found = grams.join(_side(few.where(F.col("n") == r.n)), F.col("h") == F.col("wanted")).groupBy("doc_id", "item_id").agg(F.min("start").alias("start")).withColumn("similarity", F.lit(1.0))
        out = found if out is None else out.union(found)
    return out


def window_hits(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, similarity): for each text and item the most similar item-sized window.

    start counts words; the smallest of equally similar ones is given.  A text shorter than an item is one window.
    Rows that repeat a doc_id are searched each and reported together; a null text matches nothing; an item that
    repeats another is reported too; an item shorter than a shingle is found where its exact words stand; one
    without words matches nothing; an empty table gives an empty one.
    """
    items = materialise(item_index(benchmark, shingle), "items")
    found = materialise(stretches(docs, materialise(anchors_of(items, similarity), "anchors"), shingle), "stretches")
    near = near_windows(window_fingerprints(found), items, radius)
    sure = window_similarity(near, found, items).where(F.col("similarity") >= similarity)
    named = sure.join(_side(items.select("item", "item_id")), "item")
    hits = named.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start")).alias("best"))
    hits = hits.select("doc_id", "item_id", F.col("best.start").alias("start"), (-F.col("best.s")).alias("similarity"))
    short = short_item_hits(docs, benchmark, shingle)
    if short is None:
        return hits
    # an id that names items of both kinds has one row
    both = hits.union(short).groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start")).alias("best"))
    return both.select("doc_id", "item_id", F.col("best.start").alias("start"), (-F.col("best.s")).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs whose text holds no item; a row goes if any row of its doc_id, null or not, does hold one."""
    gone = materialise(window_hits(docs, benchmark, shingle, similarity).select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return wrapped(docs, id=F.col("doc_id")).join(_side(gone), F.col("id").eqNullSafe(F.col("gone")), "left_anti").select("doc.*")
