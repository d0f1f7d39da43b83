"""Tables of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


def outside_tables(start: Column, end: Column, tables: Column) -> Column:
    """Whether a range overlaps none of the ranges ``tables`` (array<struct<s, e>>, maybe null)."""
    return ~F.coalesce(F.exists(tables, lambda t: (start < t["e"]) & (end > t["s"])), F.lit(False))


def inside_table(start: Column, end: Column, tables: Column) -> Column:
    """Whether a range lies within one of the ranges."""
    return F.coalesce(F.exists(tables, lambda t: (start >= t["s"]) & (end <= t["e"])), F.lit(False))


def sentences(docs: DataFrame, *keys: str, text: str = "text", least: int = 20, loose: bool = False) -> DataFrame:
    """(keys, sent_idx, sentence, start, end): a row per sentence, numbered among those kept."""
    spans = T.loose_sentence_spans(F.col(text)) if loose else T.sentence_spans(F.col(text), least)
    return docs.select(*keys, F.posexplode(spans).alias("sent_idx", "s")).select(*keys, "sent_idx", F.col("s.text").alias("sentence"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def lines(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, ord, line, start, end): lines as sections, numbered from 1."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    none = F.array().cast("array<struct<line:string,start:int,end:int>>")

    def step(acc, x):
        end = acc["at"] + F.length(x)
        return F.struct((end + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(x.alias("line"), acc["at"].alias("start"), end.alias("end")))).alias("out"))

    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return docs.select(*keys, F.posexplode(spans).alias("n", "s")).select(*keys, (F.col("n") + 1).alias("ord"), F.col("s.line").alias("line"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
