"""Secret scans with corpus-wide ownership, in built-in expressions only.

All matches of a pattern and their offsets come from one pass of regexp_extract_all: the
expression takes the gap before a match, or before the text's end, lazily, so no part of the text is
scanned twice.  Every candidate value is then counted over the corpus by distinct repositories
and owners (grouped twice, so that a value in a third of all rows is summed up before it is
shuffled).  A value of many owners, or of two owners in many repositories, is a copied example; one that a
single owner holds, in whatever number of its repositories, and that looks random is live; one of two owners
in few repositories that looks random is shared.  Each gets a span of its own (``example``, ``live`` or
``shared``) over the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialise

#: Patterns of the base kinds (fixed values).
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "live", "shared", "example")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
#: A value that this many owners hold is an example, and so is one of two owners or more in this many repositories.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 5
#: Distinct characters that a value must have to look live.
LIVE_DISTINCT = 6
#: Entries of copied values (a hash of spans and hashes of values) that are broadcast at most; beyond, a join.
BROADCAST_ROWS = 100_000


def all_matches(text: Column, pattern: str, value_group: int) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points."""
    whole = f"(?s)(.*?)({pattern}|\\z)"
    gaps, hits, values = (F.regexp_extract_all(text, F.lit(whole), F.lit(k)) for k in (1, 2, 2 + value_group))
    if not value_group:
        values = hits
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["hit"]) > 0, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), step)["out"]


def _shaped(found: Column, kind: str, least: int) -> Column:
    long_enough = F.filter(found, lambda x: F.length(x["value"]) >= least)
    return F.transform(long_enough, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), (x["end"] - F.length(x["value"])).alias("from")))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value, from>> of the base kinds; ``from`` is the value's own start."""
    parts = []
    # what cannot hold a long enough match isn't searched any further
    for kind, pattern, value_group, may, least in (
        ("assign", ASSIGN, 2, ASSIGN, MIN_ASSIGN),
        ("access", ACCESS, 0, f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", MIN_ACCESS),
        ("hex", f"[0-9a-f]{{{MIN_HEX},}}", 0, f"[0-9a-f]{{{MIN_HEX}}}", MIN_HEX),
    ):
        shaped = _shaped(all_matches(text, pattern, value_group), kind, least)
        none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string,from:bigint>>")
        parts.append(F.when(text.rlike(may), shaped).otherwise(none))
    return F.concat(*parts)


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind as listed, then end; comma-joined."""
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("a"), _order(x["kind"]).alias("b"), x["end"].alias("c"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["a"].cast("string"), x["c"].cast("string"))), ",")


def scan(
    docs: DataFrame, owner: Column | None = None, repository: Column | None = None, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, live_distinct: int = LIVE_DISTINCT,
    names: tuple[str, str] = ("base", "added"),
) -> DataFrame:
    """docs with two arrays of spans, base and added, one row per input row; ``names`` calls them otherwise.

    A null text is the empty text; a null owner or repository is one owner or repository of its own.  Columns called
    like the two arrays are replaced.
    Spans depend on the text and on who holds its values, so repeated rows get equal spans and count once.
    By default the source owns, and its part in each language is a repository.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))) if repository is None else repository
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in names]).alias("doc"), text.alias("text"), base_spans(text).alias("base"), F.coalesce(owner, F.lit("\0")).alias("owner"), F.coalesce(repository, F.lit("\0")).alias("repository"))
    values = F.array_distinct(F.transform("base", lambda x: F.sha2(x["value"], 256)))
    held = materialise(rows.where(F.size("base") > 0).select("owner", "repository", values.alias("values"), F.sha2(F.to_json("base"), 256).alias("spans")), "candidates")
    per_repository = held.select("owner", "repository", F.explode("values").alias("hash")).groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    per_owner = per_repository.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    # values of a single owner need no entry: what isn't found below is owner-specific
    counted = per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")).where("owners > 1")
    is_example = (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)
    copied = counted.select("hash", F.when(is_example, "example").otherwise("shared").alias("verdict"))
    # rows with the same spans and values share an entry
    keys = held.select("spans", F.explode("values").alias("hash")).distinct()
    verdicts = materialise(keys.join(copied, "hash").groupBy("spans").agg(F.map_from_entries(F.collect_set(F.struct("hash", "verdict"))).alias("verdicts")), "verdicts")
    key = F.when(F.size("base") > 0, F.sha2(F.to_json("base"), 256))
    if verdicts.count() <= BROADCAST_ROWS:
        verdicts = F.broadcast(verdicts)
    else:  # most rows have no candidate; they match nothing, and need not meet in one task for it
        key = F.coalesce(key, F.concat(F.lit("-"), F.pmod(F.xxhash64("text"), F.lit(1 << 16)).cast("string")))
    out = rows.withColumn("spans", key).join(verdicts, "spans", "left")

    def told(x):
        verdict = F.try_element_at("verdicts", F.sha2(x["value"], 256))
        varied = F.size(F.array_distinct(F.split(x["value"], ""))) >= live_distinct
        random = varied & x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]")
        return F.struct(F.when(verdict == "example", verdict).when(random, F.coalesce(verdict, F.lit("live"))).alias("kind"), x["from"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["from"].alias("from"))

    added = F.array_distinct(F.filter(F.transform("base", told), lambda x: x["kind"].isNotNull()))
    return out.select("doc", "base", added.alias("added")).select("doc.*", F.col("base").alias(names[0]), F.col("added").alias(names[1]))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by a mark."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))

    def step(acc, x):
        apart = x["start"] >= acc["at"]
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(apart, F.concat(acc["out"], kept, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(order, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))).otherwise(text)
