"""Relevance-ranked sentences and excerpts within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.sentences import outside_tables
from quire.plans.registry import FORM_KEYWORDS, KEYWORDS, PRIORITY, bounded, keywords

# Fixed value: what counts as a figure.
NUMERIC = r"\$\s?[\d,.]+|\d+(?:\.\d+)?\s?%|(?<![A-Za-z0-9_])\d{2,}(?![A-Za-z0-9_])"
CANDIDATES = 200


def priority(section_id: Column) -> Column:
    """The place of the first prefix that the id starts with, else the number of prefixes."""
    return F.coalesce(*[F.when(section_id.startswith(p), F.lit(i)) for i, p in enumerate(PRIORITY)], F.lit(len(PRIORITY)))


def dimensions(text: Column, form: Column | None = None) -> Column:
    """Dimensions whose words the text holds, in their order; a form adds its own words."""

    def hit(d: str) -> Column:
        own = text.rlike(bounded(KEYWORDS[d]))
        if form is None:
            return own
        for f, more in FORM_KEYWORDS.items():
            if d in more:
                own = own | (F.coalesce(form == f, F.lit(False)) & text.rlike(bounded(more[d])))
        return own

    return F.filter(F.array(*[F.when(hit(d), F.lit(d)) for d in KEYWORDS]), lambda x: x.isNotNull())


def keyword_score(text: Column, section_id: Column, dims: list[str], form: str | None = None) -> Column:
    """2 for each dimension, 2 for a figure, 1 for a section of priority; 0 without any dimension."""
    words = keywords(form)
    of = sum((F.when(text.rlike(bounded(words[d])), 2).otherwise(0) for d in dims), F.lit(0))
    more = F.when(text.rlike(NUMERIC), 2).otherwise(0) + F.when(priority(section_id) < len(PRIORITY), 1).otherwise(0)
    return F.when(of == 0, 0).otherwise(of + more)


def hits(text: Column, section_id: Column, dims: list[str], form: str | None = None) -> tuple[Column, Column]:
    """(struct of a boolean for each dimension, points for a figure and a section of priority): what ``score_of`` takes."""
    words = keywords(form)
    found = F.struct(*[F.coalesce(text.rlike(bounded(words[d])), F.lit(False)).alias(d) for d in dims])
    return found, F.when(text.rlike(NUMERIC), 2).otherwise(0) + F.when(priority(section_id) < len(PRIORITY), 1).otherwise(0)


def score_of(found: str, more: str, dims) -> Column:
    """``keyword_score`` from columns of ``hits``."""
    of = sum((F.when(F.col(f"{found}.{d}"), 2).otherwise(0) for d in dims), F.lit(0))
    return F.when(of == 0, 0).otherwise(of + F.col(more))


def scored(sentences: DataFrame, dims: list[str], *keys: str, form: str | None = None, tables: str | None = None) -> DataFrame:
    """Sentences (keys, section_id, section_order, sent_idx, sentence, start, end) with score and reading order.

    Those in tables are left out before they are numbered; those without a word of the dimensions after.
    """
    rows = sentences if tables is None else sentences.where(outside_tables(F.col("start"), F.col("end"), F.col(tables)))
    order = Window.partitionBy(*keys).orderBy(priority(F.col("section_id")), "section_order", "sent_idx")
    return rows.withColumn("reading", F.row_number().over(order)).withColumn("score", keyword_score(F.col("sentence"), F.col("section_id"), dims, form)).where("score > 0")


def top(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    """The ``k`` best sentences of each document; the earlier of equal ones first."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "reading"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def pack(rows: DataFrame, budget: int, *keys: str) -> DataFrame:
    """(keys, excerpt, used): sentences by score as far as they fit the budget, in reading order.

    A sentence that doesn't fit is passed over; packing stops at 95 % of the budget.
    """
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("a"), F.col("reading").alias("b"), F.col("sentence").alias("t"))))
    none = F.array().cast("array<struct<b:int,t:string>>")

    def step(acc, x):
        size = F.length(x["t"]) + 1
        fits = ~acc["full"] & (acc["used"] + size <= budget)
        used = acc["used"] + F.when(fits, size).otherwise(0)
        out = F.when(fits, F.concat(acc["out"], F.array(F.struct(x["b"].alias("b"), x["t"].alias("t"))))).otherwise(acc["out"])
        return F.struct(used.alias("used"), (acc["full"] | (fits & (used >= budget * 0.95))).alias("full"), out.alias("out"))

    packed = F.aggregate(F.col("ranked"), F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), none.alias("out")), step)
    out = rows.groupBy(*keys).agg(ranked.alias("ranked")).withColumn("p", packed)  # the sentences of one document
    return out.select(*keys, F.array_join(F.transform(F.array_sort("p.out"), lambda x: x["t"]), " ").alias("excerpt"), F.col("p.used").alias("used"))


def overview(sections: DataFrame, budget: int, *keys: str) -> DataFrame:
    """(keys, n_parts, used): sections by priority, then length, each cut to a third of the budget at most."""
    ranked = F.array_sort(F.collect_list(F.struct(priority(F.col("section_id")).alias("a"), (-F.length("text")).alias("b"), F.col("section_id").alias("c"), F.length("text").alias("size"), F.length("label").alias("label"))))

    def step(acc, x):
        room = F.least(F.lit(budget // 3), F.lit(budget) - acc["used"])
        stop = acc["stop"] | (room < 200)
        take = F.when(x["size"] > room, room + 1).otherwise(x["size"])
        used = F.when(stop, acc["used"]).otherwise(acc["used"] + take + x["label"] + 4)
        return F.struct(used.alias("used"), (stop | (used >= budget)).alias("stop"), (acc["n"] + F.when(stop, 0).otherwise(1)).alias("n"))

    done = F.aggregate(F.col("ranked"), F.struct(F.lit(0).alias("used"), F.lit(False).alias("stop"), F.lit(0).alias("n")), step)
    return sections.where(F.length("text") > 0).groupBy(*keys).agg(ranked.alias("ranked")).withColumn("d", done).select(*keys, F.col("d.n").alias("n_parts"), F.col("d.used").alias("used"))


def blended(keyword: Column, similarity: Column) -> Column:
    """Half the keyword score, held to 1, and half the similarity moved to 0..1."""
    return 0.5 * F.least(F.lit(1.0), keyword / 5.0) + 0.5 * (similarity + 1) / 2
