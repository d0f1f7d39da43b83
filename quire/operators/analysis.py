"""The deterministic analysis of documents: everything without a model, in one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.numbers import money, percent
from quire.operators import insights, relevance, sentiment

# Categories of the dimensions.
CATEGORY = {"revenue": "Revenue", "margins": "Margins", "cashflow": "Cash Flow", "balancesheet": "Balance Sheet", "shares": "Shares", "risk": "Risk", "management": "Management Commentary"}


def headline(facts: DataFrame, *keys: str) -> DataFrame:
    """(keys, headline): revenue, net income and diluted earnings with their growth, in this order."""
    order = F.create_map(*[F.lit(x) for p in (("Revenue", 0), ("Net income", 1), ("Diluted EPS", 2)) for x in p])
    yoy = F.when(F.col("yoy").isNotNull(), F.concat(F.lit(" ("), F.when(F.col("yoy") >= 0, "+").otherwise(""), F.format_string("%.1f", F.col("yoy") * 100), F.lit("% YoY)"))).otherwise("")
    value = F.when(F.col("unit") == "USD/shares", F.concat(F.lit("$"), F.format_string("%.2f", F.col("current_value")))).otherwise(money(F.col("current_value")))
    rows = facts.where(F.col("label").isin("Revenue", "Net income", "Diluted EPS")).select(*keys, F.struct(order[F.col("label")].alias("i"), F.concat(F.col("label"), F.lit(" "), value, yoy).alias("t")).alias("p"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), ", ").alias("headline"))


def one_liner(company: Column, kind: Column, read: Column, head: Column, total: Column, positive: Column, negative: Column, n_flags: Column, n_changes: Column) -> Column:
    """A sentence on what the signals say."""

    def count(n: Column, one: str, many: str) -> Column:
        return F.when(n == 1, f"1 {one}").when(n > 1, F.concat(n.cast("string"), F.lit(f" {many}")))

    tone = F.when(total >= 10, F.format_string("sentiment %d%% positive / %d%% negative", percent(positive, total), percent(negative, total)))
    bits = F.concat_ws(", ", F.nullif(head, F.lit("")), tone, count(n_flags, "cautionary-language flag", "cautionary-language flags"), count(n_changes, "section changed", "sections changed"))
    tail = F.when(bits == "", ".").otherwise(F.concat(F.lit(" — "), bits, F.lit(".")))
    return F.concat(F.lit("Signals read "), F.lower(read), F.lit(" for "), F.coalesce(company, F.lit("the company")), F.lit("'s "), kind, tail)


def hints(head: Column, total: Column, positive: Column, negative: Column, types: Column, changes: Column) -> Column:
    """What is known without a model, a line each, as a prompt's hints: facts, tone, flags by type, changed sections.

    types: array<struct<type, n>>; changes: array<string>; parts without anything are left out.
    """
    tone = F.when(total > 0, F.concat(F.lit("Tone: "), percent(positive, total).cast("string"), F.lit(" % positive, "), percent(negative, total).cast("string"), F.lit(" % negative of "), total.cast("string"), F.lit(" sentences")))
    ranked = F.array_sort(F.transform(types, lambda x: F.struct((-x["n"]).alias("n"), x["type"].alias("type"))))
    flagged = F.when(F.size(types) > 0, F.concat(F.lit("Flags: "), F.array_join(F.transform(ranked, lambda x: F.concat(F.replace(x["type"], F.lit("_"), F.lit(" ")), F.lit(" "), (-x["n"]).cast("string"))), ", ")))
    changed = F.when(F.size(changes) > 0, F.concat(F.lit("Changed: "), F.array_join(changes, "; ")))
    return F.concat_ws("\n", F.when(head != "", F.concat(F.lit("Facts: "), head)), tone, flagged, changed)


def dimension_cards(sentences: DataFrame, limit: int, *keys: str, form: str | None = None) -> DataFrame:
    """(keys, dim, pos, category, title, summary, severity): the best sentences of each dimension as cards.

    All dimensions are scored in one pass and ranked by one window.
    """
    reading = Window.partitionBy(*keys).orderBy(relevance.priority(F.col("section_id")), "section_order", "sent_idx")
    scores = F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(c).alias("category"), relevance.keyword_score(F.col("sentence"), F.col("section_id"), [d], form).alias("score")) for d, c in CATEGORY.items()])
    rows = sentences.withColumn("reading", F.row_number().over(reading)).select(*keys, "sentence", "reading", F.explode(F.filter(scores, lambda s: s["score"] > 0)).alias("s"))
    rank = F.row_number().over(Window.partitionBy(*keys, "s.dim").orderBy(F.col("s.score").desc(), "reading"))
    best = rows.withColumn("pos", rank).where(F.col("pos") <= limit).select(*keys, "s.dim", "s.category", "pos", F.col("sentence").alias("summary"))
    cards = best.withColumn("title", insights.topic_title(F.col("summary"), F.col("category"))).withColumn("severity", F.when(F.col("summary").rlike(relevance.NUMERIC), "Medium").otherwise("Low"))
    return insights.unique_titles(cards, *keys, "dim")


def analyse(docs: DataFrame, sentences: DataFrame, sentiments: DataFrame, flags: DataFrame, redlines: DataFrame, facts: DataFrame, *keys: str) -> DataFrame:
    """(keys, read, summary, stages, n_cards) for each document; every input but docs may lack a document.

    docs: keys, company, form.  The read falls back to the tone of the flags where there are few sentiments.
    """
    tally = sentiment.tally(sentiments, *keys)
    n_flags = flags.groupBy(*keys).agg(F.count("*").alias("n_flags"), F.count_if(F.col("type").isin("negative", "litigious")).alias("neg"))
    changes = insights.change_cards(redlines, *keys).groupBy(*keys).agg(F.count("*").alias("n_changes"))
    pos = sentences.groupBy(*keys).agg(F.sum(sentiment.positive_hits(F.col("sentence"))).alias("pos"))
    made = dimension_cards(sentences, 2, *keys).groupBy(*keys).agg(F.count("*").alias("n_cards"), F.collect_set("dim").alias("dims"))
    out = docs
    for part in (tally, n_flags, changes, pos, made, headline(facts, *keys)):
        out = out.join(part, list(keys), "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("positive", "negative", "total", "n_flags", "neg", "pos", "n_changes", "n_cards")}
    tone = sentiment.tone_of_document(zero["pos"], zero["neg"])
    read = sentiment.overall_read(zero["positive"], zero["negative"], zero["total"], tone)
    kind = F.when(F.col("form") == "UNKNOWN", "financial document").otherwise(F.col("form"))
    line = one_liner(F.col("company"), kind, F.col("read"), F.coalesce("headline", F.lit("")), zero["total"], zero["positive"], zero["negative"], zero["n_flags"], zero["n_changes"])
    has = lambda d: F.coalesce(F.array_contains("dims", d), F.lit(False))
    stages = insights.stages_done({"takeaways": zero["n_cards"] > 0, "whatChanged": zero["n_changes"] > 0, "revenue": has("revenue"), "margins": has("margins"), "cashflow": has("cashflow") | has("balancesheet"), "shares": has("shares"), "risks": has("risk") | (zero["n_flags"] >= 8)})
    return out.withColumn("read", read).select(*keys, "read", line.alias("summary"), F.array_join(stages, ",").alias("stages"), zero["n_cards"].alias("n_cards"))
