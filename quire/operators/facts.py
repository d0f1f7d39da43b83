"""Financial facts: current and prior periods, growth, margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.numbers import year_on_year
from quire.plans.registry import CONCEPTS


def concept_table(spark) -> DataFrame:
    """(label, unit, line, concept, rank): which facts may stand for which line; a small table."""
    rows = [(label, unit, i, c, k) for i, (label, unit, cs) in enumerate(CONCEPTS) for k, c in enumerate(cs.split())]
    return spark.createDataFrame(rows, "label string, unit string, line int, concept string, rank int")


def best_per_period(facts: DataFrame, *keys: str) -> DataFrame:
    """Of each period end the fact of the longest duration; of equal ones the first seen (column ``seq``)."""
    order = Window.partitionBy(*keys, "period_end").orderBy(F.col("duration").desc(), "seq")
    return facts.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def current_and_prior(facts: DataFrame, *keys: str, period: str | None = None) -> DataFrame:
    """(keys, current_end, current_value, prior_end, prior_value, yoy) of each entity and concept.

    Facts: keys, period_end, duration, seq, value, currency, dimensional.  Dimensional facts don't count.  The
    current period is the latest, or ``period`` (a column) where a fact has it; the prior one is the latest
    before it in the same currency.
    """
    best = best_per_period(facts.where("not dimensional and period_end is not null and value is not null"), *keys)
    wanted = F.lit(None).cast("string") if period is None else F.col(period)
    last = Window.partitionBy(*keys)
    marked = best.withColumn("_end", F.coalesce(F.max(F.when(F.col("period_end") == wanted, F.col("period_end"))).over(last), F.max("period_end").over(last)))
    marked = marked.withColumn("_currency", F.max(F.when(F.col("period_end") == F.col("_end"), F.coalesce("currency", F.lit("")))).over(last))
    before = (F.col("period_end") < F.col("_end")) & (F.coalesce("currency", F.lit("")) == F.col("_currency"))
    at = F.col("period_end") == F.col("_end")
    out = marked.groupBy(*keys).agg(
        F.max("_end").alias("current_end"), F.max(F.when(at, F.col("value"))).alias("current_value"), F.max(F.when(before, F.col("period_end"))).alias("prior_end"),
        F.max_by("value", F.when(before, F.col("period_end"))).alias("prior_value"), F.max("_currency").alias("currency"),
    )
    return out.withColumn("prior_value", F.when(F.col("prior_end").isNotNull(), F.col("prior_value"))).withColumn("yoy", year_on_year(F.col("current_value"), F.col("prior_value")))


def line_items(picked: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, unit, concept, ...): of each line the first concept in order of preference that has facts."""
    named = picked.join(F.broadcast(concept_table(picked.sparkSession)), "concept")
    order = Window.partitionBy(*keys, "label").orderBy("rank")
    out = named.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "rank")
    monetary = F.col("unit").isin("USD", "USD/shares")
    return out.withColumn("currency_code", F.when(monetary & ~F.col("currency").isin("", "USD"), F.col("currency")))


def margins(lines: DataFrame, *keys: str, label: str = "label", base: str = "Revenue", parts: dict[str, str] | None = None) -> DataFrame:
    """(keys, metric, current, prior): line items as shares of revenue; no row without revenue."""
    parts = parts or {"Gross profit": "Gross margin", "Operating income": "Operating margin", "Net income": "Net margin"}
    revenue = lines.where(F.col(label) == base).select(*keys, F.col("current_value").alias("_c"), F.col("prior_value").alias("_p")).where("_c <> 0")
    names = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
    rows = lines.where(F.col(label).isin(*parts)).join(revenue, list(keys))
    prior = F.when(F.col("prior_value").isNotNull() & (F.col("_p") != 0), F.col("prior_value") / F.col("_p"))
    return rows.select(*keys, names[F.col(label)].alias("metric"), (F.col("current_value") / F.col("_c")).alias("current"), prior.alias("prior"))


def dominant_year(mentions: DataFrame, *keys: str, year: str = "year") -> DataFrame:
    """(keys, year, n): the most mentioned year if there are 3 mentions and twice those of the next; ties have none."""
    counts = mentions.groupBy(*keys, year).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), year)
    ranked = counts.withColumn("_next", F.lead("n", 1, 0).over(order)).withColumn("_k", F.row_number().over(order))
    return ranked.where("_k = 1 and n >= 3 and n >= 2 * _next").drop("_next", "_k")


def year_mentions(text):
    """Fiscal years named in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(?<![A-Za-z0-9_])fiscal\s+(?:years?\s+)?((?:19|20)\d{2})(?![A-Za-z0-9_])"), F.lit(1)), lambda y: y.cast("int"))


def calendar_offset(fiscal_year, period_end):
    """The fiscal year where it differs from the period's calendar year by exactly one, else null."""
    return F.when(F.abs(fiscal_year - F.substring(period_end, 1, 4).try_cast("int")) == 1, fiscal_year)
