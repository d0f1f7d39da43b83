"""Report rows and file names."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_name(company: Column, form: Column, period: Column, prefix: str = "report", ext: str = "json") -> Column:
    parts = F.concat_ws("-", F.lit(prefix), F.coalesce(F.nullif(company, F.lit("")), F.lit("filing")), F.nullif(form, F.lit("")), F.nullif(F.substring(period, 1, 10), F.lit("")))
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(parts, r"(?i)[^a-z0-9._-]+", "-"), "-+", "-"), "^-|-$", "")
    return F.concat(safe, F.lit(f".{ext}"))


def summary_items(register: Column, analyst: Column, anchors: Column, text: Column) -> Column:
    """array<struct<bullet, text>> of a cached summary: note lines without their marks, or slices of the section."""
    lines = F.filter(F.transform(F.split(analyst, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    note = F.transform(lines, lambda x: F.struct(x.rlike(r"^[*\-•]\s+").alias("bullet"), F.regexp_replace(F.regexp_replace(x, r"^[*\-•]\s+", ""), r"\*\*(.*?)\*\*", "$1").alias("text")))
    cut = F.transform(anchors, lambda a: F.struct(F.lit(True).alias("bullet"), F.substring(text, a["start"] + 1, a["end"] - a["start"]).alias("text")))
    plain = F.array(F.struct(F.lit(False).alias("bullet"), analyst.alias("text")))
    return F.when((register == "builtin") & (F.trim(analyst) != ""), note).when(F.size(anchors) > 0, cut).when(analyst != "", plain).otherwise(F.array().cast("array<struct<bullet:boolean,text:string>>"))


def has_content(*sizes: Column) -> Column:
    """Whether any part of a report holds something."""
    out = F.lit(False)
    for s in sizes:
        out = out | (F.coalesce(s, F.lit(0)) > 0)
    return out


def assemble(docs: DataFrame, parts: dict[str, tuple[DataFrame, str | None]], *keys: str) -> DataFrame:
    """(keys, report): a JSON object per document with its fields, then the rows of each part as a list, empty without rows.

    ``parts`` gives for each name its rows, which have the keys, and the number that orders them within a document; rows
    of equal ones are ordered by their JSON.  All parts are grouped at once: a report costs one shuffle, however many
    parts it has, and holds what belongs to one document.  Rows of parts whose document is not among ``docs`` are left out; repeated
    documents give one report.
    """
    def rows(df: DataFrame, part: int, order: str | None) -> DataFrame:
        own = [F.col(f"`{c}`") for c in df.columns if c not in keys]
        place = F.lit(0).cast("bigint") if order is None else F.coalesce(F.col(order).cast("bigint"), F.lit(0).cast("bigint"))
        return df.select(*keys, F.struct(F.lit(part).alias("part"), place.alias("place"), F.to_json(F.struct(*own) if own else F.struct(F.lit(None).alias("none"))).alias("row")).alias("_r"))

    every = rows(docs, -1, None)
    for i, (df, order) in enumerate(parts.values()):
        every = every.unionByName(rows(df, i, order))
    held = every.groupBy(*keys).agg(F.array_sort(F.collect_list("_r")).alias("_r")).where(F.get("_r", F.lit(0))["part"] == -1)

    def listed(i: int) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(F.filter("_r", lambda x: x["part"] == i), lambda x: x["row"]), ","), F.lit("]"))

    fields = F.regexp_replace(F.get("_r", F.lit(0))["row"], r"^\{|\}$", "")
    body = F.concat_ws(",", F.nullif(fields, F.lit("")), *[F.concat(F.lit(f"{json.dumps(name)}:"), listed(i)) for i, name in enumerate(parts)])
    return held.select(*keys, F.concat(F.lit("{"), body, F.lit("}")).alias("report"))


#: Passages of a comparison that are shown, their length, and how many go into a prompt, how long (fixed values).
SHOWN, SHOWN_CHARS, SNIPPETS, SNIPPET_CHARS = 6, 220, 4, 280


def shown_passages(passages: Column, most: int = SHOWN, chars: int = SHOWN_CHARS) -> Column:
    """The first passages of an array of texts, white space collapsed, long ones cut."""

    def cut(x: Column) -> Column:
        flat = F.trim(F.regexp_replace(x, r"\s+", " "))
        return F.when(F.length(flat) > chars, F.concat(F.substring(flat, 1, chars), F.lit("…"))).otherwise(flat)

    return F.transform(F.slice(passages, 1, most), cut)


def escaped(text: Column) -> Column:
    """Text that stands in HTML as it is."""
    out = text
    for mark, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "#39")):
        out = F.replace(out, F.lit(mark), F.lit(f"&{name};"))
    return out
