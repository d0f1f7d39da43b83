"""Guards on statements: quotes, figures and advice."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import figure_cores, fiscal_labels, split_for_scrubbing

SHORTEST, LONGEST = 12, 240
# What counts as advice.
ADVICE = [
    r"\b(?:you|investors?|readers?)\s+should\s+(?:buy|sell|short|avoid|dump|hold)\b",
    r"\b(?:we|i)\s+(?:recommend|advise|suggest)\s+(?:buying|selling|shorting|holding|that you)",
    r"\bstrong\s+(?:buy|sell)\b",
    r"\b(?:buy|sell|short)\s+(?:the|this)\s+(?:stock|shares?)\b",
    r"\b(?:the\s+)?(?:stock|shares?|price)\s+will\s+(?:go\s+up|go\s+down|rise|fall|drop|soar|crash)\b",
]


def is_advice(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(ADVICE))


def scrub_advice(text: Column) -> Column:
    """The text without sentences that advise; as it is where none does."""
    kept = F.filter(split_for_scrubbing(text), lambda s: ~is_advice(s))
    return F.when(is_advice(text), F.trim(F.array_join(kept, " "))).otherwise(text)


def quote_pattern(quote: Column) -> Column:
    """An expression that finds a quote whatever its white space, quotes and dashes; null if too short."""
    q = F.substring(F.trim(quote), 1, LONGEST)
    plain = F.trim(F.translate(q, "“”‘’—–", "\"\"''--"))
    safe = F.regexp_replace(plain, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    safe = F.replace(F.replace(F.replace(safe, F.lit('"'), F.lit("[\"“”]")), F.lit("'"), F.lit("['‘’]")), F.lit("-"), F.lit("[—–-]"))
    return F.when(F.length(q) >= SHORTEST, F.concat(F.lit("(?i)"), F.regexp_replace(safe, r"\s+", r"\\s+")))


#: Quotes that one automaton holds; a larger set is looked for in blocks, a pass over the texts for each.
BLOCK_QUOTES = 100_000


def _holding(texts: Column, quotes: list[str]) -> Column:
    """Numbers of the quotes that stand in a text, both in matching form: one pass a text, however many quotes there are."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        held: dict[str, list[int]] = {}
        for k, x in enumerate(quotes):
            held.setdefault(x, []).append(k)
        automaton = ahocorasick.Automaton()
        for x in held:
            automaton.add_word(x, x)
        if held:
            automaton.make_automaton()
        for part in batches:
            found = [{x for _, x in automaton.iter(t)} if t and held else () for t in part.to_pylist()]
            yield pa.array([sorted(k for x in said for k in held[x]) for said in found], pa.list_(pa.int32()))

    return run(texts)


def find_quotes(quotes: DataFrame, sections: DataFrame, quote_id: str, *keys: str, quote: str = "quote", text: str = "text", order: str = "ord", offset: str | None = None, within: bool = False) -> DataFrame:
    """(quote_id, keys, section order, start, end): where each quote stands first in each document.

    ``within``: quotes have the keys as well, and are looked for in their own document only, by a join on the keys.
    Else every quote is looked for in every text.  Where a quote stands, its matching form stands in that of the text,
    so one automaton of all quotes finds the texts that can hold each, and only these are searched for its place; texts
    are not shuffled.  A quote without any letter or digit has no matching form and is not found, nor is a null one.
    """
    from quire.functions.text import norm_for_match

    q = quotes.select(quote_id, *(keys if within else ()), quote_pattern(F.col(quote)).alias("_p"), norm_for_match(F.substring(F.trim(quote), 1, LONGEST)).alias("_w")).where(F.col("_p").isNotNull() & (F.col("_w") != ""))
    lift = F.lit(0) if offset is None else F.col(offset)
    own = sections.select(*keys, F.col(order).alias("_ord"), lift.alias("_off"), F.col(text).alias("_t"))
    if within:
        met = own.join(q.drop("_w"), list(keys))
    else:
        met = None
        blocks = max(1, -(-q.count() // BLOCK_QUOTES))
        for b in range(blocks):
            block = q.where(F.pmod(F.xxhash64("_w"), F.lit(blocks)) == b) if blocks > 1 else q
            rows = block.select(quote_id, "_p", "_w").collect()  # of a bounded number
            named = sections.sparkSession.createDataFrame([(r[0], r[1], k) for k, r in enumerate(rows)], f"`{quote_id}` {quotes.schema[quote_id].dataType.simpleString()}, _p string, _k int")
            some = own.withColumn("_q", _holding(norm_for_match(F.col("_t")), [r[2] for r in rows])).where(F.size("_q") > 0)
            part = some.withColumn("_k", F.explode("_q")).join(F.broadcast(named), "_k").drop("_k", "_q")
            met = part if met is None else met.unionByName(part)
    hits = met.withColumn("start", F.regexp_instr("_t", F.col("_p")) - 1).where(F.col("start") >= 0).withColumn("_len", F.length(F.regexp_substr("_t", F.col("_p"))))
    first = Window.partitionBy(quote_id, *keys).orderBy("_ord", "start")
    placed = hits.select(quote_id, *keys, "_ord", "_off", "start", "_len").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return placed.select(quote_id, *keys, F.col("_ord").alias(order), (F.col("_off") + F.col("start")).alias("start"), (F.col("_off") + F.col("start") + F.col("_len")).alias("end"))


def unverified_figures(statements: DataFrame, sources: DataFrame, statement_id: str, *keys: str, statement: str = "statement", text: str = "text") -> DataFrame:
    """(statement_id, keys, core): figures of a statement that no text of its document holds (an anti-join)."""
    said = statements.select(statement_id, *keys, F.explode(figure_cores(F.col(statement))).alias("core")).distinct()
    known = sources.select(*keys, F.explode(figure_cores(F.col(text))).alias("core")).distinct()
    return said.join(known, [*keys, "core"], "left_anti").select(statement_id, *keys, "core")


def scrub_figures(text: Column, known: Column) -> Column:
    """struct<text, stripped>: the text without sentences whose figures are not all among ``known``."""
    parts = split_for_scrubbing(text)
    kept = F.filter(parts, lambda s: F.size(F.array_except(figure_cores(s), known)) == 0)
    return F.struct(F.trim(F.array_join(kept, " ")).alias("text"), (F.size(kept) < F.size(parts)).alias("stripped"))


def finalise(insights: DataFrame, sources: DataFrame, *keys: str, text: str = "text", quote: str | None = None, within: tuple[str, ...] = (), order: str = "ord") -> DataFrame:
    """Insights (keys, title, summary, why, meaning, confidence) after all guards.

    Advice and unverified figures go, quarters lose their year, and where a figure was stripped confidence is Low; what
    keeps neither summary nor meaning is dropped.  A title that only repeats the summary gives way to one of its topic,
    if there is a ``category``.  ``quote`` names a column of quotes: one that the document holds gets its range
    (quote_ord, quote_start, quote_end), another goes and confidence is Low; ``within`` names the columns that tell the
    insights of a document apart.
    """
    figures = sources.select(*keys, F.explode(figure_cores(F.col(text))).alias("c")).groupBy(*keys).agg(F.collect_set("c").alias("_known"))  # of one document
    known = F.coalesce("_known", F.array().cast("array<string>"))
    out = insights.join(figures, list(keys), "left")
    for name in ("summary", "why", "meaning"):
        out = out.withColumn(f"_{name}", scrub_figures(fiscal_labels(scrub_advice(F.col(name))), known))
    stripped = F.col("_summary.stripped") | F.col("_why.stripped") | F.col("_meaning.stripped")
    out = out.withColumn("confidence", F.when(stripped, "Low").otherwise(F.col("confidence")))
    for name in ("summary", "why", "meaning"):
        out = out.withColumn(name, F.col(f"_{name}.text"))
    title = fiscal_labels(scrub_advice(F.col("title")))
    if "category" in insights.columns:
        from quire.operators.insights import ensure_title

        title = ensure_title(title, F.col("summary"), F.col("category"))
    out = out.where((F.col("summary") != "") | (F.col("meaning") != "")).withColumn("title", title).drop("_known", "_summary", "_why", "_meaning")
    if quote is None:
        return out
    named = out.withColumn("_q", F.xxhash64(*keys, *within, F.col(quote)))
    asked = named.where(F.trim(F.col(quote)) != "").select("_q", *keys, F.col(quote).alias("quote")).distinct()
    found = find_quotes(asked, sources, "_q", *keys, text=text, order=order, within=True).select("_q", *keys, F.col(order).alias("quote_ord"), F.col("start").alias("quote_start"), F.col("end").alias("quote_end"))
    told = named.join(found, ["_q", *keys], "left").drop("_q")
    lost = (F.trim(F.coalesce(F.col(quote), F.lit(""))) != "") & F.col("quote_start").isNull()
    return told.withColumn("confidence", F.when(lost, "Low").otherwise(F.col("confidence"))).withColumn(quote, F.when(~lost, F.trim(F.col(quote))))
