"""Tables in the shapes the operators take, made from the test tables; the oracles make the same ones in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.sentences import lines
from quire.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ord, line, start, end) of all documents."""
    return lines(table(spark, sf_dir, "documents"), "doc_id")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, form, text): conversations as item forms, with a table of contents and bodies of 2,500 characters and more."""
    turns = table(spark, sf_dir, "conversations").where("length(text) > 0")
    head = F.concat(F.lit("ITEM "), (F.col("turn") + 1).cast("string"), F.lit(". The "), F.col("role"))
    body = F.concat(head, F.lit("\n"), F.expr("repeat(concat(text, ' '), cast(ceil(2500 / length(text)) as int))"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", head.alias("head"), body.alias("body")))).alias("t"))
    text = F.concat(F.array_join(F.transform("t", lambda x: x["head"]), "\n"), F.lit("\n"), F.array_join(F.transform("t", lambda x: x["body"]), "\n"))
    return rows.select("conv_id", F.lit("10-K").alias("form"), text.alias("text"))


FILINGS_SQL = """
    select conv_id, '10-K' as form, string_agg(head, chr(10) order by turn) || chr(10) || string_agg(head || chr(10) || repeat(text || ' ', cast(ceil(2500 / length(text)) as int)), chr(10) order by turn) as text
    from (select conv_id, turn, text, 'ITEM ' || (turn + 1) || '. The ' || role as head from conversations where length(text) > 0) group by conv_id"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, section_id, section_order, sent_idx, sentence, start, end): whole turns as sentences with words that ranking looks for."""
    turns = table(spark, sf_dir, "conversations")
    section = F.element_at(F.array(*[F.lit(x) for x in ("item_7_mdna", "item_1a_risk_factors", "item_3_legal_proceedings", "item_9b_other")]), (F.col("turn") % 4 + 1).cast("int"))
    lead = F.element_at(F.array(*[F.lit(x) for x in ("Revenue grew 12% on demand: ", "Litigation risk remains: ", "Dividends were paid: ", "Nothing of note: ", "Net income and margins rose to $4,100: ")]), (F.col("turn") % 5 + 1).cast("int"))
    sentence = F.concat(lead, F.regexp_replace("text", r"\s+", " "))
    return turns.select("conv_id", section.alias("section_id"), (F.col("turn") % 4 + 1).cast("int").alias("section_order"), F.col("turn").cast("int").alias("sent_idx"), sentence.alias("sentence"), F.lit(0).alias("start"), F.length(sentence).alias("end"))


STATEMENTS_SQL = r"""
    select conv_id, ['item_7_mdna','item_1a_risk_factors','item_3_legal_proceedings','item_9b_other'][turn % 4 + 1] as section_id, turn % 4 + 1 as section_order, turn as sent_idx,
        ['Revenue grew 12% on demand: ','Litigation risk remains: ','Dividends were paid: ','Nothing of note: ','Net income and margins rose to $4,100: '][turn % 5 + 1] || regexp_replace(text, '\s+', ' ', 'g') as sentence
    from conversations"""


def sentiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, raw, score): labels as raw sentiment of their documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    raw = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "lang", "source", raw.alias("raw"), ((F.col("doc_id") % 100) / 100).alias("score"))


SENTIMENTS_SQL = """
    select l.doc_id, d.lang, d.source, case when toxic = 1 then 'negative' when quality = 1 then 'positive' else 'neutral' end as raw, (l.doc_id % 100) / 100.0::double as score
    from labels l join documents d on l.doc_id = d.doc_id"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as facts of suppliers: entity, concept, period_end, duration, seq, value, currency, dimensional."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("entity"), F.concat("l_returnflag", "l_linestatus").alias("concept"), F.date_format(F.last_day("l_shipdate"), "yyyy-MM-dd").alias("period_end"),
        F.col("l_quantity").alias("duration"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"), F.col("l_extendedprice").alias("value"),
        F.lit(None).cast("string").alias("currency"), (F.col("l_tax") == 0).alias("dimensional"),
    )


FACTS_SQL = """
    select l_suppkey as entity, l_returnflag || l_linestatus as concept, strftime(last_day(l_shipdate::date), '%Y-%m-%d') as period_end, l_quantity as duration,
        l_orderkey, l_linenumber, l_partkey, l_extendedprice as value from lineitem where not (l_tax = 0)"""

PICKED_SQL = f"""
    best as (select * from (select *, row_number() over (partition by entity, concept, period_end order by duration desc, l_orderkey, l_linenumber, l_partkey, value) as n from ({FACTS_SQL})) where n = 1),
    ranked as (select *, row_number() over (partition by entity, concept order by period_end desc) as k from best),
    picked as (select entity, concept, max(case when k = 1 then period_end end) as current_end, max(case when k = 1 then value end) as current_value,
        max(case when k = 2 then period_end end) as prior_end, max(case when k = 2 then value end) as prior_value from ranked group by entity, concept)"""


def clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ms``: milliseconds squeezed a thousandfold, so that requests meet."""
    ev = table(spark, sf_dir, "events")
    return ev.withColumn("ms", F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1000) / 1000).cast("bigint"))


CLOCK_SQL = "select *, cast(floor((epoch_us(ts) / 1000.0) / 1000.0) as bigint) as ms from events"


def event_files(spark: SparkSession, sf_dir: str, again: int = 7) -> str:
    """A folder of three files of events in the order of time, written one after the other, so that a stream has micro-batches.

    Each file but the first repeats every ``again``-th event of the one before.
    """
    folder = shared_folder(spark, "events")
    ev = table(spark, sf_dir, "events").withColumn("part", F.when(F.dayofmonth("ts") <= 10, 0).when(F.dayofmonth("ts") <= 20, 1).otherwise(2))
    for k in range(3):
        part = ev.where(F.col("part") == k)
        if again and k:
            part = part.union(ev.where((F.col("part") == k - 1) & (F.col("event_id") % again == 0)))
        part.drop("part").coalesce(1).write.mode("append").parquet(folder)
    return folder


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, prior_id): each document with the latest earlier one that has a line of 40 characters or more in common.

    Neighbours of one line are found by a window over its documents, so a line that many share makes no pairs.
    """
    said = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    held = said.where(F.length("line") >= 40).select("doc_id", F.xxhash64("line").alias("h"), F.md5("line").alias("m")).distinct()
    before = held.withColumn("was", F.lag("doc_id").over(Window.partitionBy("h", "m").orderBy("doc_id")))
    return before.where("was is not null").groupBy("doc_id").agg(F.max("was").alias("prior_id"))


VERSIONS_SQL = """
    select doc_id, max(was) as prior_id from (select doc_id, lag(doc_id) over (partition by line order by doc_id) as was
        from (select distinct doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where length(line) >= 40)) where was is not null group by doc_id"""
