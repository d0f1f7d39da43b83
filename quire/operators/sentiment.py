"""Calibrated sentiment and its roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR, RISK_BASELINE = 0.6, -0.35
# Words of positive tone.
POSITIVE = r"(?i)(?<![A-Za-z0-9_])(grew|grow(?:th|ing)?|increas\w+|improv\w+|record|strong\w*|robust|exceed\w+|outperform\w+|expansion|expand\w+|gain(?:s|ed)?|higher|rose|surg\w+|accelerat\w+|favorab\w+|profitab\w+|momentum|resilien\w+|solid|upside|tailwind|raised|strengthen\w+)(?![A-Za-z0-9_])"


def calibrate(label: Column, score: Column) -> Column:
    """The label where it is positive or negative with enough certainty, else neutral."""
    return F.when(label.isin("positive", "negative") & (score >= FLOOR), label).otherwise("neutral")


def tally(sentiments: DataFrame, *keys: str) -> DataFrame:
    """(keys, positive, negative, neutral, total)."""
    pos, neg = F.count_if(F.col("label") == "positive"), F.count_if(F.col("label") == "negative")
    return sentiments.groupBy(*keys).agg(pos.alias("positive"), neg.alias("negative"), (F.count("*") - pos - neg).alias("neutral"), F.count("*").alias("total"))


def damp(sentiments: DataFrame, flags: DataFrame, *keys: str) -> DataFrame:
    """Sentiments that overlap a boilerplate flag of their document turned neutral."""
    ranges = flags.where("boilerplate").groupBy(*keys).agg(F.collect_set(F.struct("start", "end")).alias("_safe"))  # of one document
    touched = F.coalesce(F.exists("_safe", lambda r: (F.col("start") < r["end"]) & (F.col("end") > r["start"])), F.lit(False))
    return sentiments.join(ranges, list(keys), "left").withColumn("label", F.when(touched, "neutral").otherwise(F.col("label"))).drop("_safe")


def adjusted_net(positive: Column, negative: Column, total: Column, section_id: Column) -> Column:
    """Net share of positive over negative, a risk section measured against its usual tone; 0 of nothing."""
    net = (positive - negative) / total
    return F.when(total == 0, F.lit(0.0)).when(F.contains(section_id, F.lit("risk")), net - RISK_BASELINE).otherwise(net)


def overall_read(positive: Column, negative: Column, total: Column, fallback: Column) -> Column:
    p, q = positive / total, negative / total
    return (
        F.when(total < 10, fallback).when((p > q * 1.5) & (p > 0.1), "Bullish").when((q > p * 1.5) & (q > 0.1), "Bearish")
        .when((p > 0.08) & (q > 0.08), "Mixed").otherwise("Neutral")
    )


def section_skew(positive: Column, negative: Column, total: Column, fallback: Column) -> Column:
    p, q = positive / total, negative / total
    return F.when(total < 3, fallback).when(p - q > 0.15, "Bullish").when(p - q < -0.15, "Bearish").when((p > 0.1) & (q > 0.1), "Mixed").otherwise("Neutral")


def positive_hits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(POSITIVE))


def tone_of_document(pos: Column, neg: Column) -> Column:
    n = pos + neg
    p, q = pos / n, neg / n
    return F.when(n < 4, "Neutral").when((p > q * 1.5) & (p > 0.1), "Bullish").when((q > p * 1.5) & (q > 0.1), "Bearish").when((p > 0.2) & (q > 0.2), "Mixed").otherwise("Neutral")


def tone_of_section(pos: Column, neg: Column) -> Column:
    n = pos + neg
    net = (pos - neg) / n
    return F.when(n < 3, "Neutral").when(net > 0.2, "Bullish").when(net < -0.2, "Bearish").when((pos > 0) & (neg > 0), "Mixed").otherwise("Neutral")


def lexicon_tone(sections: DataFrame, flags: DataFrame, *keys: str, section: str = "section_id", text: str = "text") -> DataFrame:
    """(keys, section, pos, neg, tone): words of positive tone against negative and litigious flags, by section."""
    neg = flags.where(F.col("type").isin("negative", "litigious")).groupBy(*keys, section).agg(F.count("*").alias("neg"))
    out = sections.select(*keys, section, positive_hits(F.col(text)).cast("bigint").alias("pos")).join(neg, [*keys, section], "left").withColumn("neg", F.coalesce("neg", F.lit(0).cast("bigint")))
    return out.withColumn("tone", tone_of_section(F.col("pos"), F.col("neg")))


def consensus(positive: Column, negative: Column, neutral: Column, total: Column) -> Column:
    """One plain sentence on the make-up and one on the lean of a document's tone; empty of nothing."""
    from quire.functions.numbers import percent

    pos, neg, neu = percent(positive, total), percent(negative, total), percent(neutral, total)
    makeup = F.when(neu >= 60, "mostly neutral").when(neu >= 40, "largely neutral, with some directional tone").otherwise("unusually opinionated")
    lean = F.when(pos - neg >= 8, "positive statements prevail").when(pos - neg <= -8, "negative statements prevail").otherwise("positive and negative statements balance")
    return F.when(total == 0, "").otherwise(F.format_string("The tone is %s: %s (%d%% against %d%%).", makeup, lean, pos, neg))
