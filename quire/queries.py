"""The registered queries of the document operators, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import proxies as P
from quire.functions import numbers as N
from quire.functions import text as T
from quire.operators import analysis, cache, chunks, classify, composites, evidence, facts, flags, ingest, insights, models, priors, redline, relevance, report, scoring, segment, sentences, sentiment, similarity, vectors
from quire.plans.registry import FORM_KEYWORDS, KEYWORDS, LEXICON, PRIORITY, TITLES
from quire.sources import files, html, json
from quire.session import shared_folder, written
from quire.streaming import progress, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def q(s: str) -> str:
    """A string as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


# ── sentences ────────────────────────────────────────────────────────────────

_WS = r"[ \t\n\r\f\x0B]"
_GUARD = r"(^|[^A-Za-z.])(\.*" + T.guard_words(r"\.*") + r"\.*)([.!?])"
_END = r"""([.!?]["')\]]*)([ \t\n\r]+[A-Z0-9"'(\[])"""
_LOOSE = r"""([.!?])(\s+)([A-Z(“"$0-9])"""


def _spans_sql(marked: str, least: int, most: int, source: str = "documents", key: str = "doc_id") -> str:
    return rf"""
    s0 as (select {key}, translate(coalesce(text, ''), chr(1) || chr(2), '  ') as t from {source}),
    s1 as (select {key}, t, string_split({marked}, chr(1)) as parts from s0),
    s2 as (select {key}, t, unnest(parts) as piece, generate_subscripts(parts, 1) as n from s1),
    s3 as (select {key}, n, length(piece) as len, coalesce(sum(length(piece)) over (partition by {key} order by n rows between unbounded preceding and 1 preceding), 0) as off, t from s2),
    s4 as (select {key}, n, off, substr(t, off::bigint + 1, len) as raw from s3),
    s5 as (select {key}, n, off + length(raw) - length(regexp_replace(raw, '^{_WS}+', '')) as s_start, regexp_replace(raw, '^{_WS}+|{_WS}+$', '', 'g') as sentence from s4),
    sent as (select {key}, cast(row_number() over (partition by {key} order by n) - 1 as int) as sent_idx, sentence, cast(s_start as int) as s_start, cast(s_start + length(sentence) as int) as s_end from s5 where length(sentence) between {least} and {most})"""


_SENT_A = _spans_sql(f"regexp_replace(regexp_replace(t, {q(_GUARD)}, '\\1\\2' || chr(2), 'g'), {q(_END)}, '\\1' || chr(1) || '\\2', 'g')", 20, 100000000)
_SENT_B = _spans_sql(f"regexp_replace(t, {q(_LOOSE)}, '\\1' || chr(1) || '\\2\\3', 'g')", 30, 600)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("start", "s_start").withColumnRenamed("end", "s_end")


@query(f"with {_SENT_A} select * from sent")
def sentence_spans(spark, d):
    """STR1: sentences with exact offsets."""
    return _named(sentences.sentences(P.table(spark, d, "documents"), "doc_id"))


@query(f"with {_SENT_B} select * from sent")
def sentence_spans_loose(spark, d):
    """STR2: the splitter that ranking uses."""
    return _named(sentences.sentences(P.table(spark, d, "documents"), "doc_id", loose=True))


@query(f"with {_SENT_A} select lang, count(*) as n_sentences, count(distinct doc_id) as n_docs, round(avg(length(sentence)), 6) as avg_chars, max(s_end) as last_end from sent join documents using (doc_id) group by lang")
def sentence_stats(spark, d):
    """STR1 with counts by language."""
    s = _named(sentences.sentences(P.table(spark, d, "documents"), "doc_id", "lang"))
    return s.groupBy("lang").agg(F.count("*").alias("n_sentences"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg(F.length("sentence")), 6).alias("avg_chars"), F.max("s_end").alias("last_end"))


@query(f"with {_SENT_A}, l as (select doc_id, min(position(chr(10) in text)) as cut from documents group by doc_id) select doc_id, sent_idx, s_start, s_end from sent join l using (doc_id) where not (cut > 0 and s_start < cut)")
def sentences_outside_tables(spark, d):
    """FLT12: sentences that overlap a table range go, the others keep their number; the first line is the table."""
    docs = P.table(spark, d, "documents").withColumn("cut", F.locate("\n", "text"))
    s = sentences.sentences(docs, "doc_id", "cut")
    tables = F.when(F.col("cut") > 0, F.array(F.struct(F.lit(0).alias("s"), F.col("cut").alias("e"))))
    return _named(s.where(sentences.outside_tables(F.col("start"), F.col("end"), tables)).select("doc_id", "sent_idx", "start", "end"))


# ── text functions ───────────────────────────────────────────────────────────

_NORM = r"""trim(regexp_replace(regexp_replace(translate(lower(%s), '‘’“”', '''''""'), '[^a-z0-9%%$.\s]', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(f"select doc_id, md5({_NORM % 'text'}) as norm_md5, length({_NORM % 'text'}) as n from documents")
def norm_for_match(spark, d):
    """STR4."""
    n = T.norm_for_match(F.col("text"))
    return P.table(spark, d, "documents").select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("bigint").alias("n"))


_TOKENS = f"list_filter(list_distinct(string_split({_NORM % 'text'}, ' ')), lambda x: x <> '')"


@query(f"with t as (select doc_id, {_TOKENS} as s from documents) select a.doc_id, b.doc_id as other_id, round(case when len(a.s) = 0 and len(b.s) = 0 then 1.0 else len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::double end, 6) as jaccard from t a join t b on b.doc_id = a.doc_id + 1")
def token_jaccard_pairs(spark, d):
    """SET2: neighbouring documents."""
    t = written(P.table(spark, d, "documents").select("doc_id", T.token_set(F.col("text")).alias("s")), "words")  # cut out once
    o = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("other_id"), F.col("s").alias("o"))
    return t.join(o, "doc_id").select("doc_id", "other_id", F.round(T.jaccard(F.col("s"), F.col("o")), 6).alias("jaccard"))


_FIG = r"(\$\s?)?(\d[\d,]*(?:\.\d+)?)(\s?%)?"
_CORES = rf"""(select doc_id, source, replace(regexp_extract(m, '(\d[\d,]*(?:\.\d+)?)', 1), ',', '') as core, m from (select doc_id, source, unnest(regexp_extract_all(text, {q(_FIG)})) as m from documents))"""
_SIGNIFICANT = r"(m like '$%' or m like '%\%' escape '\' or core like '%.%' or length(core) >= 4)"


@query(f"select doc_id, core, count(*) as n from {_CORES} where {_SIGNIFICANT} group by doc_id, core")
def figure_cores(spark, d):
    """STR11: significant figures of every document."""
    return P.table(spark, d, "documents").select("doc_id", F.explode(T.figure_cores(F.col("text"))).alias("core")).groupBy("doc_id", "core").agg(F.count("*").alias("n"))


@query(f"with f as (select * from {_CORES} where {_SIGNIFICANT}) select distinct doc_id, source, core from f where doc_id % 2 = 1 and not exists (select 1 from f g where g.source = f.source and g.core = f.core and g.doc_id % 2 = 0)")
def unverified_figures(spark, d):
    """JN15: figures of odd documents that no even document of their source has."""
    docs = P.table(spark, d, "documents")
    return evidence.unverified_figures(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), "doc_id", "source", statement="text")


@query(r"""select o_orderkey, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%B %d, %Y') when 1 then strftime(o_orderdate, '%d %b %Y') else strftime(o_orderdate, '%m/%d/%Y') end as said, strftime(o_orderdate, '%Y-%m-%d') as iso from orders
    union all select * from (values (-1, '2024-02-30T00:00', '2024-02-30'), (-2, 'Sept. 3rd, 2021', '2021-09-03'), (-3, 'Foo 3, 2021', null), (-4, '13/01/2020', null), (-5, '', null))""")
def iso_dates(spark, d):
    """DAT1."""
    o = P.table(spark, d, "orders")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MMMM dd, yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd MMM yyyy")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    few = spark.createDataFrame([(-1, "2024-02-30T00:00"), (-2, "Sept. 3rd, 2021"), (-3, "Foo 3, 2021"), (-4, "13/01/2020"), (-5, "")], "o_orderkey bigint, said string")
    return o.select("o_orderkey", said.alias("said")).unionByName(few).withColumn("iso", T.iso_date(F.col("said")))


@query(r"select page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') as bare, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) as host from pages")
def url_parts(spark, d):
    """STR17."""
    return P.table(spark, d, "pages").select("page_id", T.url_without_fragment(F.col("url")).alias("bare"), T.host(F.col("url")).alias("host"))


@query(r"""select doc_id, ord, regexp_replace(substr(regexp_replace(regexp_replace(lower(line), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48), 'zzzz$', 'zzzz') as slug,
    array_to_string(list_filter(string_split_regex(trim(line), '\s+'), lambda w: w <> '')[1:10], ' ') || case when len(list_filter(string_split_regex(trim(line), '\s+'), lambda w: w <> '')) > 10 then '…' else '' end as head
    from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1)::int as ord from documents)""")
def line_heads(spark, d):
    """STR15, STR20: slugs and first words of all lines."""
    return P.line_sections(spark, d).select("doc_id", "ord", T.slug(F.col("line")).alias("slug"), T.first_words(F.col("line"), 10).alias("head"))


# ── flags and tone ───────────────────────────────────────────────────────────

_LEX = "(values " + ", ".join(f"({q(t)}, {q(w)}, {q(n)}, {str(c).lower()})" for t, w, n, c in LEXICON) + ") as lex(type, word, note, cs)"
_FLAGS = rf"""
    f0 as (select doc_id, source, type, word, note, regexp_replace(translate(text, chr(1) || chr(2), '  '), case when cs then '' else '(?i)' end || '\b' || word || '\b', chr(1) || '\0' || chr(2), 'g') as m from documents, {_LEX} where contains(lower(text), lower(word))),
    f1 as (select doc_id, source, type, word, note, string_split(m, chr(1)) as parts from f0),
    f2 as (select doc_id, source, type, word, note, unnest(parts) as piece, generate_subscripts(parts, 1) as n from f1),
    f3 as (select doc_id, source, type, note, n, piece, coalesce(sum(length(replace(piece, chr(2), ''))) over (partition by doc_id, type, word order by n rows between unbounded preceding and 1 preceding), 0) as off from f2),
    flags as (select doc_id, source, type, note, string_split(piece, chr(2))[1] as term, cast(off as int) as f_start, cast(off + length(string_split(piece, chr(2))[1]) as int) as f_end from f3 where n > 1)"""


def _flags(spark, d, *more: str):
    return flags.flag(P.table(spark, d, "documents"), flags.lexicon(spark), "doc_id", *more)


@query(f"with {_FLAGS} select doc_id, type, term, note, f_start, f_end from flags")
def lexicon_flags(spark, d):
    """STR5, SRC12, CMP4: every hit of every term with its place, and the note of the layer that has the term first."""
    return _flags(spark, d).select("doc_id", "type", "term", "note", F.col("start").alias("f_start"), F.col("end").alias("f_end"))


_CAUTION = " Actual results could differ materially. It may rain."
_CAUTIOUS = f"docs as (select doc_id, source, text || case when doc_id % 2 = 0 then {q(_CAUTION)} else '' end as text from documents)"


@query(f"""with {_CAUTIOUS}, {_FLAGS.replace("from documents", "from docs")}, {_SENT_A.replace("from documents", "from docs")}, safe as (select * from sent where regexp_matches(sentence, {q(flags.BOILERPLATE)}))
    select doc_id, type, term, f_start, exists (select 1 from safe where safe.doc_id = flags.doc_id and f_start >= s_start and f_start < s_end) as boilerplate from flags""")
def boilerplate_flags(spark, d):
    """FLT14: flags that start in a sentence of safe-harbour language, of which every other document has one."""
    docs = P.table(spark, d, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 2 == 0, _CAUTION).otherwise("")).alias("text"))
    return flags.flag(docs, flags.lexicon(spark), "doc_id").select("doc_id", "type", "term", F.col("start").alias("f_start"), "boilerplate")


@query(f"with {_FLAGS} select source, type, count(*) as n, count(distinct doc_id) as n_docs from flags where type <> 'weak_modal' group by source, type")
def flag_counts_by_type(spark, d):
    """AG8, FLT15: counts of the types that are switched on."""
    on = {t: t != "weak_modal" for t in {r[0] for r in LEXICON}}
    return flags.visible(_flags(spark, d, "source"), on, boilerplate=True).groupBy("source", "type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"with {_FLAGS}, c as (select source, type, count(*) as k from flags group by source, type) select source, sum(k)::bigint as n, sum(k) > 40 as heavy, string_agg(replace(type, '_', ' ') || ' ×' || k, ', ' order by k desc, type) as parts from c group by source having sum(k) >= 8")
def flag_density(spark, d):
    """AG8: sources dense with flags."""
    return flags.density(_flags(spark, d, "source"), "source")


_TONE = r"grew|grow(?:th|ing)?|increas\w+|improv\w+|record|strong\w*|robust|exceed\w+|outperform\w+|expansion|expand\w+|gain(?:s|ed)?|higher|rose|surg\w+|accelerat\w+|favorab\w+|profitab\w+|momentum|resilien\w+|solid|upside|tailwind|raised|strengthen\w+"
_POS = rf"len(regexp_extract_all(text, '(?i)\b(?:{_TONE})\b'))"


@query(rf"""with {_FLAGS}, neg as (select doc_id, count(*) as neg from flags where type in ('negative', 'litigious') group by doc_id),
    s as (select doc_id, source, {_POS} as pos, coalesce(neg, 0) as neg from documents left join neg using (doc_id))
    select doc_id, pos, neg, case when pos + neg < 3 then 'Neutral' when (pos - neg) / (pos + neg)::double > 0.2 then 'Bullish' when (pos - neg) / (pos + neg)::double < -0.2 then 'Bearish' when pos > 0 and neg > 0 then 'Mixed' else 'Neutral' end as tone from s""")
def lexicon_tone(spark, d):
    """AG7: tone of each document."""
    docs = P.table(spark, d, "documents")
    return sentiment.lexicon_tone(docs, _flags(spark, d, "source"), "doc_id", section="source").select("doc_id", "pos", "neg", "tone")


_READ = "case when n < 4 then 'Neutral' when pos / n > neg / n * 1.5 and pos / n > 0.1 then 'Bullish' when neg / n > pos / n * 1.5 and neg / n > 0.1 then 'Bearish' when pos / n > 0.2 and neg / n > 0.2 then 'Mixed' else 'Neutral' end"


@query(rf"""with {_FLAGS}, neg as (select source, count(*) as neg from flags where type in ('negative', 'litigious') group by source), p as (select source, sum({_POS})::double as pos from documents group by source),
    s as (select source, pos, coalesce(neg, 0)::double as neg, pos + coalesce(neg, 0) as n from p left join neg using (source)) select source, pos::bigint as pos, neg::bigint as neg, {_READ} as read from s""")
def tone_by_source(spark, d):
    """AG7: the read of each source."""
    docs = P.table(spark, d, "documents")
    t = sentiment.lexicon_tone(docs, _flags(spark, d, "source"), "doc_id", section="source").groupBy("source").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return t.withColumn("read", sentiment.tone_of_document(F.col("pos"), F.col("neg")))


_CAL = f"select *, case when raw in ('positive', 'negative') and score >= 0.6 then raw else 'neutral' end as label from ({P.SENTIMENTS_SQL})"
_TALLY = "count(*) filter (label = 'positive') as positive, count(*) filter (label = 'negative') as negative, count(*) filter (label = 'neutral') as neutral, count(*) as total"


def _calibrated(spark, d):
    s = P.sentiments(spark, d)
    return s.withColumn("label", sentiment.calibrate(F.col("raw"), F.col("score")))


@query(f"select lang, source, {_TALLY} from ({_CAL}) group by grouping sets ((lang, source), (lang))")
def sentiment_rollup(spark, d):
    """NUM9, AG1, AG3: tallies by language and source, and by language."""
    c = _calibrated(spark, d)
    by_source = sentiment.tally(c, "lang", "source")
    whole = by_source.groupBy("lang").agg(*[F.sum(x).alias(x) for x in ("positive", "negative", "neutral", "total")]).withColumn("source", F.lit(None).cast("string"))
    return by_source.unionByName(whole)


@query(f"""with t as (select source, {_TALLY} from ({_CAL}) group by source), u as (select *, positive / total::double as p, negative / total::double as q, case when source in ('src1', 'src11') then 0.35 else 0 end as lift from t)
    select source, positive, negative, total, round(p - q + lift, 6) as net, case when total < 3 then 'Neutral' when p - q > 0.15 then 'Bullish' when p - q < -0.15 then 'Bearish' when p > 0.1 and q > 0.1 then 'Mixed' else 'Neutral' end as skew,
        case when total < 10 then 'Neutral' when p > q * 1.5 and p > 0.1 then 'Bullish' when q > p * 1.5 and q > 0.1 then 'Bearish' when p > 0.08 and q > 0.08 then 'Mixed' else 'Neutral' end as read,
        floor(positive * 100.0 / total + 0.5)::bigint as pct_positive from u""")
def sentiment_reads(spark, d):
    """AG4, AG5, AG6, NUM6: net, skew and read of each source; two sources stand for risk sections."""
    t = sentiment.tally(_calibrated(spark, d), "source")
    cols = F.col("positive"), F.col("negative"), F.col("total")
    sid = F.when(F.col("source").isin("src1", "src11"), "item_1a_risk_factors").otherwise("item_7_mdna")
    return t.select("source", "positive", "negative", "total", F.round(sentiment.adjusted_net(*cols, sid), 6).alias("net"), sentiment.section_skew(*cols, F.lit("Neutral")).alias("skew"), sentiment.overall_read(*cols, F.lit("Neutral")).alias("read"), N.percent(F.col("positive"), F.col("total")).alias("pct_positive"))


@query(f"""with {_SENT_A}, {_FLAGS}, s as (select doc_id, sent_idx, s_start, s_end, raw from sent join ({P.SENTIMENTS_SQL}) using (doc_id)),
    t as (select doc_id, case when exists (select 1 from flags f where f.doc_id = s.doc_id and f.type = 'litigious' and s.s_start < f.f_end and s.s_end > f.f_start) then 'neutral' else raw end as label from s)
    select doc_id, {_TALLY} from t group by doc_id""")
def boilerplate_damping(spark, d):
    """JN8, AG2: sentences that overlap a range are neutral; licence language stands for boilerplate."""
    s = sentences.sentences(P.table(spark, d, "documents"), "doc_id").join(P.sentiments(spark, d).select("doc_id", F.col("raw").alias("label")), "doc_id")
    safe = _flags(spark, d).where("type = 'litigious'").withColumn("boilerplate", F.lit(True))
    return sentiment.tally(sentiment.damp(s, safe, "doc_id"), "doc_id")


# ── segmentation ─────────────────────────────────────────────────────────────

_HEADER = r"(^|\n)(\s{0,4})(ITEM\s+(\d+(?:[A-Z]|\.\d{2}|\.[A-Z])?)\s*[.:\-–—]?\s+[^\n]{2,100})"
_HITS = rf"""
    fil as ({P.FILINGS_SQL}),
    h1 as (select conv_id, string_split(regexp_replace(text, '(?i){_HEADER}', '\1\2' || chr(1) || '\3' || chr(2), 'g'), chr(1)) as parts from fil),
    h2 as (select conv_id, unnest(parts) as piece, generate_subscripts(parts, 1) as n from h1),
    h3 as (select conv_id, n, piece, coalesce(sum(length(replace(piece, chr(2), ''))) over (partition by conv_id order by n rows between unbounded preceding and 1 preceding), 0)::int as head_start from h2),
    hits as (select conv_id, lower(regexp_extract(piece, '(?i)^ITEM\s+(\d+(?:[A-Z]|\.\d{{2}}|\.[A-Z])?)', 1)) as item_key, head_start, (head_start + length(string_split(piece, chr(2))[1]))::int as head_end from h3 where n > 1),
    marked as (select h.*, (select count(distinct o.item_key) from hits o where o.conv_id = h.conv_id and o.head_start between h.head_start - 2000 and h.head_start + 2000) >= 3 as in_contents from hits h),
    picked as (select conv_id, item_key, coalesce(min(head_start) filter (not in_contents), max(head_start)) as head_start from marked group by conv_id, item_key),
    bounds as (select p.conv_id, p.item_key, p.head_start, h.head_end, lead(p.head_start) over (partition by p.conv_id order by p.head_start) as next from picked p join hits h on h.conv_id = p.conv_id and h.head_start = p.head_start)"""
_ITEM_IDS = "(values " + ", ".join(f"({q(k)}, {q(i)}, {o})" for k, i, o in segment.items("10-K")) + ") as reg(item_key, section_id, section_order)"
_SECTIONS = rf"""sections as (select conv_id, section_id, section_order, (head_end + length(body) - length(regexp_replace(body, '^\s+', '')))::int as s_start, s_end::int as s_end, regexp_replace(body, '^\s+|\s+$', '', 'g') as text from (
    select b.conv_id, section_id, section_order, head_end, coalesce(next, length(f.text)) as s_end, substr(f.text, head_end + 1, coalesce(next, length(f.text)) - head_end) as body from bounds b join fil f using (conv_id) join {_ITEM_IDS} using (item_key) where head_end < coalesce(next, length(f.text))))"""


@query(f"with {_HITS} select * from marked")
def item_headers(spark, d):
    """STR6, AG9: headers, and whether they stand in a table of contents."""
    return segment.mark_contents(segment.item_hits(P.filings(spark, d), "conv_id"), "conv_id")


@query(f"with {_HITS}, {_SECTIONS} select conv_id, section_id, section_order, s_start, s_end, md5(text) as text_md5 from sections")
def item_sections(spark, d):
    """CMP2, WIN1, WIN2, JN1: sections of item forms."""
    s = segment.item_sections(P.filings(spark, d), "conv_id")
    return _named(s.select("conv_id", "section_id", "section_order", "start", "end", F.md5("text").alias("text_md5")))


@query(f"with {_HITS}, {_SECTIONS} select conv_id, case when bool_or(section_id like '%mdna%' and length(trim(text)) < 50) or bool_or(section_id like '%risk_factors%' and length(trim(text)) = 0) then 'low' else 'high' end as segmentation from sections group by conv_id")
def segmentation_confidence(spark, d):
    """FLT10."""
    return segment.confidence(segment.item_sections(P.filings(spark, d), "conv_id"), "conv_id")


_S1 = rf"""(select conv_id, string_agg(['RISK FACTORS', 'USE OF PROCEEDS', 'DILUTION', 'LEGAL MATTERS'][turn % 4 + 1] || ' ' || turn || chr(10) || text, chr(10) order by turn) as text from conversations group by conv_id)"""


def _s1_hits() -> str:
    rows = []
    for i, (sid, pattern) in enumerate(TITLES["S-1"]):
        p = q(rf"(?i)^([\s\S]*)((?:^|\n)(?:[ \t]{{0,4}}{pattern}[^\n]{{0,120}}))")
        rows.append(f"select conv_id, {q(sid)} as section_id, {10 * (i + 1)} as section_order, length(text) as size, length(regexp_extract(text, {p}, 1)) as hs, length(regexp_extract(text, {p}, 1)) + length(regexp_extract(text, {p}, 2)) as he from s1 where regexp_matches(text, {p})")
    return " union all ".join(rows)


@query(f"""with s1 as {_S1}, h as ({_s1_hits()}), c as (select *, count(*) over (partition by conv_id) as k, lead(hs) over (partition by conv_id order by hs, section_order) as nx from h)
    select conv_id, section_id, section_order, he::int as s_start, coalesce(nx, size)::int as s_end from c where k > 1 and he < coalesce(nx, size)
    union all select conv_id, 'document_body', 1, 0, length(text)::int from s1 where length(text) > 0 and conv_id not in (select conv_id from c where k > 1)""")
def title_sections(spark, d):
    """STR7, WIN3: sections at the last match of each title."""
    return _named(segment.title_sections(_titled(spark, d), "S-1", "conv_id"))


def _titled(spark, d):
    turns = P.table(spark, d, "conversations")
    head = F.element_at(F.array(*[F.lit(x) for x in ("RISK FACTORS", "USE OF PROCEEDS", "DILUTION", "LEGAL MATTERS")]), (F.col("turn") % 4 + 1).cast("int"))
    row = F.concat(head, F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("row")))), lambda x: x["row"]), "\n").alias("text"))


_S1_COUNT = f"s1 as {_S1}, h as ({_s1_hits()}), c as (select *, count(*) over (partition by conv_id) as k, lead(hs) over (partition by conv_id order by hs, section_order) as nx from h)"
_BY_FORM = f"""{_HITS}, {_SECTIONS}, {_S1_COUNT},
    titled as (select conv_id, section_id, section_order, he as s_start, coalesce(nx, size) as s_end from c where k > 1 and he < coalesce(nx, size) union all select conv_id, 'document_body', 1, 0, length(text) from s1 where length(text) > 0 and conv_id not in (select conv_id from c where k > 1)),
    cut as (select conv_id, '10-K' as form, section_id, section_order, s_start, s_end from sections where conv_id % 3 = 0 union all select conv_id, 'S-1', section_id, section_order, s_start, s_end from titled where conv_id % 3 = 1
        union all select conv_id, 'UNKNOWN', 'document_body', 1, 0, length(text) from fil where conv_id % 3 = 2)"""


def _mixed_forms(spark, d):
    """(conv_id, form, text): conversations as filings with items, with titles, and of no known form."""
    titled = _titled(spark, d).select("conv_id", F.lit("S-1").alias("form"), "text").where("conv_id % 3 = 1")
    itemed = P.filings(spark, d).where("conv_id % 3 <> 1").withColumn("form", F.when(F.col("conv_id") % 3 == 0, F.col("form")).otherwise("UNKNOWN"))
    return itemed.unionByName(titled)


@query(f"with {_BY_FORM} select conv_id, form, section_id, section_order::int as section_order, s_start::int as s_start, s_end::int as s_end from cut")
def sections_by_form(spark, d):
    """CMP2: items, titles or the whole document, as each row's form asks for."""
    return _named(segment.sections_by_form(_mixed_forms(spark, d), "conv_id").drop("text"))


@query(f"""with {_BY_FORM}, k as (select conv_id, form, count(*) as n from cut group by all), b as (select distinct conv_id from k)
    select conv_id, case when conv_id % 11 = 5 then 'UNKNOWN' else form end as form, case when conv_id % 11 <> 5 then 'Firm ' || conv_id || ' Corp' end as company, case when conv_id % 11 <> 5 then '2023-12-31' end as period,
        case when conv_id % 11 = 5 then 0 else 2 end as pages, conv_id % 11 = 5 as failed, case when conv_id % 11 = 5 then 0 else n end as n_sections from k""")
def text_ingest(spark, d):
    """CMP1, CMP3, SRC4, SRC6, STR27: files of pages to documents; one in eleven can't be read, and says so."""
    head = F.concat(F.lit("Firm "), F.col("conv_id").cast("string"), F.lit(" Corp\n(Exact name of registrant as specified in its charter)\nFor the fiscal year ended December 31, 2023\n"), F.when(F.col("form") != "UNKNOWN", F.concat(F.lit("FORM "), F.col("form"))).otherwise("A letter"), F.lit("  \n\f"))
    content = F.encode(F.concat(head, "text"), "utf-8")
    files_of = _mixed_forms(spark, d).select("conv_id", F.when(F.col("conv_id") % 11 == 5, F.concat(F.unhex(F.lit("FF")), content)).otherwise(content).alias("content"))
    docs, _ = ingest.ingest_texts(files_of.withColumn("length", F.octet_length("content")), "conv_id")
    return docs.select("conv_id", "form", "company", "period", "pages", F.col("error").isNotNull().alias("failed"), F.col("n_sections").cast("bigint").alias("n_sections"))


@query(r"""select page_id, 'report_' || n || '_' || case when slug = '' then 'section' else slug end as section_id, label, n::int as section_order from (select page_id, n, label, regexp_replace(substr(regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48), 'zzzz$', 'zzzz') as slug from (
    select page_id, row_number() over (partition by page_id order by i) as n, label from (select page_id, generate_subscripts(hs, 1) as i, trim(regexp_replace(regexp_replace(unnest(hs), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) as label from (select page_id, regexp_extract_all(html, '(?is)<h[123]\b[^>]*>(.*?)</h[123]>', 1) as hs from pages)) where length(label) between 1 and 160))""")
def heading_sections(spark, d):
    """CMP3, STR15."""
    return segment.heading_sections(P.table(spark, d, "pages"), "page_id")


# ── pages and forms ──────────────────────────────────────────────────────────

_URLS = [
    (1, "https://www.sec.gov/Archives/edgar/data/320193/000032019324000123/aapl-10-k_2024.htm", "<p>x</p>"), (2, "https://www.sec.gov/Archives/edgar/data/320193/0000320193-24-000123-index.htm", ""),
    (3, "https://www.sec.gov/ix?doc=/x", '<div contextref="c1">1</div>'), (4, "https://www.sec.gov/edgar/search/#/q=a", ""), (5, "https://data.sec.gov/report", ""), (6, "ftp://www.sec.gov/", ""),
    (7, "https://chromewebstore.google.com/detail/x", ""), (8, "https://www.fool.com/earnings/q3-8-k.html", ""), (9, "https://finance.yahoo.com/quote/X", ""), (10, "file:///tmp/a.pdf", ""),
    (11, "https://efts.sec.gov/LATEST", ""), (12, "https://www.sec.gov/cgi-bin/x", '<ix:nonNumeric name="dei:DocumentType">10-Q</ix:nonNumeric>'), (13, "https://example.com/def14a.pdf?x=1", ""),
    (14, "https://www.sec.gov/Archives/edgar/data/320193/0000320193-24-000123/main.htm", ""),
]
_URL_SQL = "(values " + ", ".join(f"({i}, {q(u)}, {q(h)})" for i, u, h in _URLS) + ") as u(page_id, url, html)"
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_ALL_PAGES = f"(select page_id + 1000000 as page_id, url, html from pages union all select * from {_URL_SQL})"


def _pages(spark, d):
    few = spark.createDataFrame(_URLS, "page_id bigint, url string, html string")
    return P.table(spark, d, "pages").withColumn("page_id", F.col("page_id") + 1000000).select("page_id", "url", "html").unionByName(few)


@query(rf"""with p as (select *, {_HOST} as host, {_PATH} as path from {_ALL_PAGES}), c as (select *, case
        when not regexp_matches(url, '^(?i)https?://[^/?#]') or regexp_matches(host, '(?:^|\.)chromewebstore\.google\.com$|^chrome\.google\.com$') then 'unsupported' when not regexp_matches(host, '(?:^|\.)sec\.gov$') then 'ir_or_financial'
        when regexp_matches(path, '(?i)/Archives/edgar/data/') and regexp_matches(path, '(?i)-index\.(html?|json)$') then 'edgar_index' when regexp_matches(url, '(?i)/Archives/edgar/data/') then 'edgar_filing'
        when regexp_matches(html, '(?i)name=["'']dei:(?:documenttype|entityregistrantname)["'']') then 'edgar_filing' when regexp_matches(html, '(?i)<[^>]+\scontextref=|<ix:header|<ix:nonnumeric') then 'edgar_ixbrl'
        when regexp_matches(host, '(?:^|\.)efts\.sec\.gov$') or regexp_matches(url, '(?i)/cgi-bin/browse-edgar|/edgar/search|/cgi-bin/srqsb') then 'sec_search' else 'sec_data_report' end as category from p)
    select page_id, category, category in ('sec_data_report', 'sec_search') as readable, case when category in ('ir_or_financial', 'unsupported') then 'ir' else 'edgar' end as bucket,
        case when not regexp_matches(url, '^(?i)(?:https?://[^/?#]|file:)') or host in ('chromewebstore.google.com') then 'unsupported' when regexp_matches(host, '(?:^|\.)sec\.gov$') then 'auto_host' else 'injectable' end as injectability,
        case when host in ('www.fool.com', 'finance.yahoo.com') then replace(host, 'www.', '') end as site from c""")
def page_categories(spark, d):
    """FLT1 to FLT4, FLT17."""
    p = _pages(spark, d).withColumn("category", classify.page_category(F.col("url"), F.col("html")))
    return p.select("page_id", "category", classify.is_readable_non_filing(F.col("category")).alias("readable"), classify.host_bucket(F.col("category")).alias("bucket"), classify.injectability(F.col("url")).alias("injectability"), classify.site_profile(F.col("url")).alias("site"))


@query(rf"""select page_id, case when page_id in (1, 2, 14) then '320193' end as cik, case when page_id in (1, 2, 14) then '0000320193-24-000123' end as accession, lpad((page_id % 7919)::varchar, 10, '0') as padded,
    'https://www.sec.gov/Archives/edgar/data/' || (page_id % 7919) || '/000032019324000123/d.htm' as archive, regexp_matches(url, '(?i)^[^?#]*\.pdf(?:[?#]|$)') as pdf from {_ALL_PAGES}""")
def edgar_addresses(spark, d):
    """STR18, STR19, SRC5."""
    a, n = classify.accession(F.col("url")), F.col("page_id") % 7919
    return _pages(spark, d).select("page_id", a["cik"].alias("cik"), a["accession"].alias("accession"), classify.padded_cik(n).alias("padded"), classify.archive_url(n, F.lit("0000320193-24-000123"), F.lit("d.htm")).alias("archive"), files.is_pdf(F.col("url")).alias("pdf"))


_FORM_TEXTS = [(1, None, "", "QUARTERLY REPORT ON FORM 10-Q for"), (2, "10-K/A", "", ""), (3, None, "https://x.com/a/8-k_1.htm", ""), (4, "odd", "https://x.com/", "Notice of Annual Meeting"), (5, None, "", "nothing"), (6, "DEFA14A", "", "FORM 10-K"), (7, None, "", "see Form S-1 registration")]


@query("select * from (values (1, '10-Q', 'low'), (2, '10-K', 'high'), (3, '8-K', 'medium'), (4, 'DEF 14A', 'low'), (5, 'UNKNOWN', 'low'), (6, 'DEF 14A', 'high'), (7, 'S-1', 'low')) as t(doc_id, form, confidence) union all select doc_id + 100, 'UNKNOWN', 'low' from documents")
def form_detection(spark, d):
    """FLT5, FLT6."""
    few = spark.createDataFrame(_FORM_TEXTS, "doc_id bigint, declared string, url string, text string")
    docs = P.table(spark, d, "documents").select((F.col("doc_id") + 100).alias("doc_id"), F.lit(None).cast("string").alias("declared"), F.lit("").alias("url"), "text")
    return few.unionByName(docs).select("doc_id", classify.detect_form(F.col("declared"), F.col("url"), F.col("text")).alias("f")).select("doc_id", "f.form", "f.confidence")


_GATES = [(c, f, s, h, n) for c in ("edgar_filing", "ir_or_financial", "pdf", "sec_search") for f in ("10-K", "UNKNOWN", "DATA_REPORT") for s in ("high", "low") for h in (True, False) for n in (1, 3)]
_GATE_SQL = f"(select doc_id, g.* exclude (i) from labels join (values " + ", ".join(f"({i}, {q(c)}, {q(f)}, {q(s)}, {str(h).lower()}, {n})" for i, (c, f, s, h, n) in enumerate(_GATES)) + f") as g(i, category, form, segmentation, by_headings, n_sections) on doc_id % {len(_GATES)} = i)"


def _gated(spark, d):
    """Labelled documents, dealt out over all combinations of what gates look at."""
    kinds = spark.createDataFrame([(i, *g) for i, g in enumerate(_GATES)], "i bigint, category string, form string, segmentation string, by_headings boolean, n_sections int")
    return P.table(spark, d, "labels").select("doc_id", (F.col("doc_id") % len(_GATES)).alias("i")).join(F.broadcast(kinds), "i").drop("i")


@query(f"""with g as (select *, case when segmentation = 'low' then true when category = 'edgar_filing' or form = 'DATA_REPORT' then false when by_headings or form = 'UNKNOWN' then true else n_sections <= 1 end as low from {_GATE_SQL})
    select *, low and category in ('ir_or_financial', 'pdf') as general, category = 'edgar_filing' and form = 'UNKNOWN' and n_sections <= 1 as exhibit from g""")
def document_gates(spark, d):
    """FLT7, FLT8, over all combinations."""
    g = _gated(spark, d)
    g = g.withColumn("low", classify.low_confidence(F.col("category"), F.col("form"), F.col("segmentation"), F.col("by_headings"), F.col("n_sections")))
    return g.withColumn("general", classify.general_financial(F.col("category"), F.col("low"))).withColumn("exhibit", classify.exhibit(F.col("category"), F.col("form"), F.col("n_sections")))


@query(r"""select page_id, case when length(h1) between 3 and 160 then h1 when title = '' then null when length(short) >= 3 then short else title end as name from (select page_id, h1, title, trim(regexp_extract(title, '^(.*?)(?:\s*[|–—]|$)', 1)) as short from (
    select page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) as h1, trim(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) as title from pages))""")
def page_names(spark, d):
    """STR16."""
    return P.table(spark, d, "pages").select("page_id", classify.page_name(F.col("html")).alias("name"))


# ── filings and facts ────────────────────────────────────────────────────────


@query("""with o as (select o_orderkey, o_custkey, o_orderpriority, o_orderdate::date as day from orders)
    select a.o_orderkey, coalesce(max(struct_pack(d := b.day, k := b.o_orderkey)).k, (select max(c.o_orderkey) from o c where c.o_custkey = a.o_custkey and c.o_orderpriority = a.o_orderpriority and c.day = a.day and c.o_orderkey < a.o_orderkey)) as prior
    from o a left join o b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority and b.day < a.day group by a.o_orderkey, a.o_custkey, a.o_orderpriority, a.day""")
def prior_filing(spark, d):
    """JN5: the as-of prior of every order as a filing."""
    o = P.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
    return priors.prior_filing(o, "o_custkey", "o_orderpriority", date="day", key="o_orderkey").select("o_orderkey", "prior")


@query("select o_custkey, o_orderpriority, o_orderkey as prior from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 2")
def prior_filing_unknown_period(spark, d):
    """JN5: the second latest."""
    return priors.second_latest(P.table(spark, d, "orders"), "o_custkey", "o_orderpriority", date="o_orderdate", key="o_orderkey")


@query("select o_custkey, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int) as seq, o_orderkey::varchar as accession, strftime(o_orderdate, '%Y-%m-%d') as report_date, o_orderpriority as form, '' as document from orders")
def submission_rows(spark, d):
    """SRC9: column arrays of JSON as rows; missing arrays give empty strings."""
    o = P.table(spark, d, "orders")
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")))
    recent = F.struct(F.transform("r", lambda x: x["o_orderkey"].cast("string")).alias("accessionNumber"), F.transform("r", lambda x: x["day"]).alias("reportDate"), F.transform("r", lambda x: x["o_orderpriority"]).alias("form"))
    raw = o.groupBy("o_custkey").agg(rows.alias("r")).select("o_custkey", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json"))
    return priors.submission_rows(raw, "o_custkey").select("o_custkey", "seq", "accession", "report_date", "form", "document")


_YOY = "case when prior_value <> 0 then (current_value - prior_value) / abs(prior_value) end"


@query("""with fit as (select *, case when json_valid(props) then coalesce(json_type(props, '$.k') in ('UBIGINT', 'BIGINT'), true) else false end as ok from clicks)
    select click_id, arrived_at, 'read' as told, (props->>'$.k')::bigint as k, props->>'$.device.os' as os, json_array_length(props, '$.items')::int as n_items, null as raw from fit where props is null or ok
    union all select click_id, arrived_at, 'rejected', null, null, null, props from fit where props is not null and not ok""")
def json_two_modes(spark, d):
    """JSN1: JSON of clicks as columns; what does not parse, or has a text for a number, lies beside it, as it was, and without it the strict reader gives the same."""
    kind = "k bigint, device struct<os:string,ver:string>, tags array<string>, items array<struct<sku:bigint,qty:bigint>>"
    clicks = P.table(spark, d, "clicks").select("click_id", "arrived_at", "props")
    read, rejected = json.parsed(clicks, kind, "props")
    strict = json.parsed_strictly(read.drop("parsed"), kind, "props")
    one = strict.select("click_id", "arrived_at", F.lit("read").alias("told"), "parsed.k", "parsed.device.os", F.when(F.col("parsed.items").isNotNull(), F.size("parsed.items")).alias("n_items"), F.lit(None).cast("string").alias("raw"))
    return one.unionByName(rejected.select("click_id", "arrived_at", F.lit("rejected").alias("told"), F.col("props").alias("raw")), allowMissingColumns=True)


@query(f"with {P.PICKED_SQL} select entity, concept, current_end, current_value, prior_end, prior_value, round({_YOY}, 6) as yoy from picked")
def facts_current_prior(spark, d):
    """AG10, WIN4, NUM2."""
    p = facts.current_and_prior(P.facts(spark, d), "entity", "concept")
    return p.select("entity", "concept", "current_end", "current_value", "prior_end", "prior_value", F.round("yoy", 6).alias("yoy"))


@query(f"""with {P.PICKED_SQL} select a.entity, case a.concept when 'AF' then 'Gross margin' else 'Net margin' end as metric, round(a.current_value / r.current_value, 6) as current, round(case when a.prior_value is not null and r.prior_value <> 0 then a.prior_value / r.prior_value end, 6) as prior
    from picked a join picked r on a.entity = r.entity and r.concept = 'NO' and r.current_value <> 0 where a.concept in ('AF', 'RF')""")
def margins(spark, d):
    """NUM3: two concepts as shares of a third."""
    p = facts.current_and_prior(P.facts(spark, d), "entity", "concept")
    m = facts.margins(p, "entity", label="concept", base="NO", parts={"AF": "Gross margin", "RF": "Net margin"})
    return m.select("entity", "metric", F.round("current", 6).alias("current"), F.round("prior", 6).alias("prior"))


_INLINE = """<html><ix:header><xbrli:context id="c1"><xbrli:period><xbrli:startDate>2023-01-01</xbrli:startDate><xbrli:endDate>2023-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="c0"><xbrli:period><xbrli:startDate>2022-01-01</xbrli:startDate><xbrli:endDate>2022-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="s1"><xbrli:entity><xbrli:segment>a</xbrli:segment></xbrli:entity><xbrli:period><xbrli:endDate>2023-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:unit id="u"><xbrli:measure>iso4217:EUR</xbrli:measure></xbrli:unit></ix:header><body>
<ix:nonFraction name="us-gaap:Revenues" contextref="c1" unitref="u" scale="6">1,200</ix:nonFraction><ix:nonFraction name="us-gaap:Revenues" contextref="c0" unitref="u" scale="6">1,000</ix:nonFraction>
<ix:nonFraction name="us-gaap:Revenues" contextref="s1" unitref="u" scale="6">9,999</ix:nonFraction><ix:nonFraction name="us-gaap:GrossProfit" contextref="c1" unitref="u" scale="6">300</ix:nonFraction>
<ix:nonFraction name="us-gaap:NetIncomeLoss" contextref="c1" unitref="u" scale="6" sign="-">60</ix:nonFraction></body></html>"""


@query("""select c_custkey, t.label, 'USD' as unit, 'EUR' as currency_code, t.now as current_value, t.was as prior_value, t.yoy from customer, lateral (values ('Revenue', (c_custkey * 1200) * 1e6, c_custkey * 1e9, case when c_custkey <> 0 then 0.2::double end), ('Gross profit', (c_custkey % 97 + 3) * 1e6, null, null), ('Net income', -(c_custkey % 13 + 1) * 1e6, null, null)) as t(label, now, was, yoy)""")
def inline_fact_lines(spark, d):
    """SRC11, JN6, AG11, NUM1, NUM4: line items of inline-fact documents, one a customer."""
    key = F.col("c_custkey")
    html_ = F.lit(_INLINE)
    # the smallest first, so that no value put in is taken for one to replace
    for said, value in ((">60<", (key % 13 + 1).cast("string")), (">300<", (key % 97 + 3).cast("string")), (">1,200<", F.format_number(key * 1200, 0)), (">1,000<", F.format_number(key * 1000, 0))):
        html_ = F.replace(html_, F.lit(said), F.concat(F.lit(">"), value, F.lit("<")))
    page = P.table(spark, d, "customer").select("c_custkey", html_.alias("html"))
    raw = html.facts_of(html.inline_facts(page, "c_custkey"), "c_custkey")
    lines = facts.line_items(facts.current_and_prior(raw, "c_custkey", "concept"), "c_custkey")
    return lines.select("c_custkey", "label", "unit", "currency_code", "current_value", "prior_value", F.round("yoy", 6).alias("yoy"))


@query("with c as (select o_custkey, year(o_orderdate) as y, count(*) as n from orders group by 1, 2), r as (select *, row_number() over (partition by o_custkey order by n desc, y) as k, lead(n, 1, 0) over (partition by o_custkey order by n desc, y) as nx from c) select o_custkey, y::int as year, n, case when abs(y - 1996) = 1 then y::int end as shifted from r where k = 1 and n >= 3 and n >= 2 * nx")
def fiscal_dominant_year(spark, d):
    """AG14, FLT26: the dominant order year of customers, and where it is off 1996 by one."""
    o = P.table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    return facts.dominant_year(o, "o_custkey").withColumn("shifted", facts.calendar_offset(F.col("year"), F.lit("1996-12-31")))


# ── relevance ────────────────────────────────────────────────────────────────


_DIMS = ["revenue", "margins", "shares", "risk"]


def _hit(dim: str) -> str:
    return rf"regexp_matches(sentence, '(?i)\b(?:{KEYWORDS[dim]})\b')"


_RANK_CASE = "case " + " ".join(f"when starts_with(section_id, {q(p)}) then {i}" for i, p in enumerate(PRIORITY)) + f" else {len(PRIORITY)} end"


@query(f"with {_HITS}, {_SECTIONS} select conv_id, section_id, {_RANK_CASE} as rank from sections")
def section_priority(spark, d):
    """ORD1: the priority of the sections of filings."""
    return segment.item_sections(P.filings(spark, d), "conv_id").select("conv_id", "section_id", relevance.priority(F.col("section_id")).alias("rank"))


_SCORED = rf"""st as ({P.STATEMENTS_SQL}), ord as (select *, {_RANK_CASE} as prio, {' + '.join(f'(2 * {_hit(x)}::int)' for x in _DIMS)} as kw from st),
    num as (select *, row_number() over (partition by conv_id order by prio, section_order, sent_idx) as reading from ord),
    scored as (select *, kw + 2 * regexp_matches(sentence, '\$\s?[\d,.]+|\d+(?:\.\d+)?\s?%|\b\d{{2,}}\b')::int + (prio < {len(PRIORITY)})::int as score from num where kw > 0)"""


@query(f"with {_SCORED} select conv_id, sent_idx::int as sent_idx, section_id, score::int as score, rank::int as rank from (select *, row_number() over (partition by conv_id order by score desc, reading) as rank from scored) where rank <= 3")
def relevance_topk(spark, d):
    """FLT18 to FLT20, NUM10, ORD2, ORD3."""
    r = relevance.top(relevance.scored(P.statements(spark, d), _DIMS, "conv_id"), 3, "conv_id")
    return r.select("conv_id", "sent_idx", "section_id", "score", "rank")


@query(f"with st as ({P.STATEMENTS_SQL}) select conv_id, sent_idx::int as sent_idx, array_to_string(list_filter([" + ", ".join(f"case when {_hit(x)} then {q(x)} end" for x in KEYWORDS) + "], lambda x: x is not null), ',') as dims from st")
def keyword_dimensions(spark, d):
    """FLT18, FLT19."""
    return P.statements(spark, d).select("conv_id", "sent_idx", F.array_join(relevance.dimensions(F.col("sentence")), ",").alias("dims"))


@query(f"""with recursive {_SCORED}, q as (select conv_id, reading, sentence, row_number() over (partition by conv_id order by score desc, reading) as k from scored),
    r as (select conv_id, 0::bigint as k, 0::bigint as used, false as full, []::bigint[] as took from (select distinct conv_id from q)
        union all select r.conv_id, q.k, case when not r.full and r.used + length(q.sentence) + 1 <= 1500 then r.used + length(q.sentence) + 1 else r.used end, r.full or (r.used + length(q.sentence) + 1 <= 1500 and r.used + length(q.sentence) + 1 >= 1425), case when not r.full and r.used + length(q.sentence) + 1 <= 1500 then list_append(r.took, q.reading) else r.took end
        from r join q on q.conv_id = r.conv_id and q.k = r.k + 1),
    l as (select *, row_number() over (partition by conv_id order by k desc) as n from r), w as (select conv_id, used, took from l where n = 1)
    select w.conv_id, coalesce((select string_agg(sentence, ' ' order by reading) from q where q.conv_id = w.conv_id and list_contains(w.took, q.reading)), '') as excerpt, used::int as used from w""")
def budget_pack(spark, d):
    """WIN5, CMP9: excerpts of 1,500 characters."""
    return relevance.pack(relevance.scored(P.statements(spark, d), _DIMS, "conv_id"), 1500, "conv_id")


@query(f"with {_SCORED}, m as (select conv_id, lower(substr(sentence, 1, 80)) as key, min(struct_pack(s := -score, r := reading)) as b from scored group by 1, 2), k as (select conv_id, (b).r as reading, row_number() over (partition by conv_id order by (b).s, (b).r) as place from m) select s.conv_id, s.sent_idx::int as sent_idx, k.place::int as place from k join scored s on s.conv_id = k.conv_id and s.reading = k.reading where place <= 2")
def takeaway_dedup(spark, d):
    """SET5: takeaways that begin differently."""
    r = relevance.top(relevance.scored(P.statements(spark, d), _DIMS, "conv_id"), 1_000_000, "conv_id")
    return insights.distinct_takeaways(r, 2, "conv_id").select("conv_id", "sent_idx", "place")


@query()
def section_overview(spark, d):
    """WIN6, CMP9: the budget of an overview."""
    s = segment.item_sections(P.filings(spark, d), "conv_id").withColumn("label", F.col("section_id"))
    return relevance.overview(s, 3000, "conv_id")


# ── vectors ──────────────────────────────────────────────────────────────────


@query("select a.vec_id, b.vec_id as other_id, round(greatest(-1, least(1, list_inner_product(a.embedding::double[], b.embedding::double[]))), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    """VEC1: neighbouring vectors."""
    e = P.table(spark, d, "embeddings").select("vec_id", "embedding")
    o = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("o"))
    return e.join(o, "vec_id").select("vec_id", "other_id", F.round(N.cosine(F.col("embedding"), F.col("o")), 6).alias("cosine"))


_CENTRAL = "c as (select a.label, a.vec_id, coalesce(sum(greatest(0, list_inner_product(a.embedding::double[], b.embedding::double[]))) filter (a.vec_id <> b.vec_id), 0) / greatest(1, count(*) - 1) as score from embeddings a join embeddings b on a.label = b.label group by 1, 2)"


@query(f"with {_CENTRAL} select label, vec_id, round(score, 6) as score from c")
def centrality(spark, d):
    """AG13: mean positive similarity within a label."""
    c = vectors.centrality(P.table(spark, d, "embeddings"), "label")
    return c.select("label", "vec_id", F.round("score", 6).alias("score"))


@query(f"with {_CENTRAL}, r as (select *, row_number() over (partition by label order by round(score, 9) desc, vec_id) as k from c) select label, vec_id, row_number() over (partition by label order by vec_id)::int as place from r where k <= 5")
def centrality_topn(spark, d):
    """ORD4: the five most central of each label in reading order."""
    c = vectors.centrality(P.table(spark, d, "embeddings"), "label").withColumn("score", F.round("score", 9))
    return vectors.select_top(c, F.lit(5), "label", order="vec_id").select("label", "vec_id", "place")


@query("with v as (select embedding::double[] as e from embeddings where vec_id = 0) select vec_id, round(0.5 * least(1.0, (vec_id % 8) / 5.0) + 0.5 * (greatest(-1, least(1, list_inner_product(embedding::double[], v.e))) + 1) / 2, 6) as blend from embeddings, v")
def blended_rerank(spark, d):
    """NUM11, CMP10: keyword score and similarity to one query, blended."""
    e = P.table(spark, d, "embeddings")
    first = e.where("vec_id = 0").select("embedding").first()
    return vectors.similarity_to(e if first else e.limit(0), list(first[0]) if first else []).select("vec_id", F.round(relevance.blended(F.col("vec_id") % 8, F.col("similarity")), 6).alias("blend"))


# ── redline ──────────────────────────────────────────────────────────────────

_LINES = "(select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1)::int as ord from documents)"
_ALIGNED = rf"""
    ver as ({P.VERSIONS_SQL}),
    cur as (select doc_id, ord, md5(line) as section_id, line as text from {_LINES} where doc_id in (select doc_id from ver)),
    pri0 as (select v.doc_id, ord, md5(line) as section_id, line as text, row_number() over (partition by v.doc_id, md5(line) order by ord desc) as n from ver v join {_LINES} l on l.doc_id = v.prior_id),
    pri as (select * from pri0 where n = 1),
    al as (select coalesce(c.doc_id, p.doc_id) as doc_id, coalesce(c.section_id, p.section_id) as section_id, case when p.ord is null then 'added' when c.ord is null then 'removed' else 'matched' end as status, c.ord as current_ord, p.ord as prior_ord, c.text as ct, p.text as pt
        from cur c full outer join pri p on c.doc_id = p.doc_id and c.section_id = p.section_id)"""


def _two_versions(spark, d):
    """Lines, named by what they say, of documents that have an earlier version, and of that version."""
    lines = sentences.lines(P.table(spark, d, "documents"), "doc_id").select("doc_id", F.md5("line").alias("section_id"), "ord", F.col("line").alias("text"))
    pairs = written(P.versions(spark, d), "versions")
    prior = lines.withColumnRenamed("doc_id", "prior_id").join(pairs, "prior_id").drop("prior_id")
    return lines.join(pairs.select("doc_id"), "doc_id", "left_semi"), prior.select("doc_id", "section_id", "ord", "text")


def _aligned(spark, d):
    return redline.align(*_two_versions(spark, d), "doc_id")


@query(f"with {_ALIGNED} select doc_id, section_id, status, current_ord, prior_ord from al")
def section_alignment(spark, d):
    """JN2, SET8: lines of a document against those of the latest earlier one that shares a long line with it."""
    return _aligned(spark, d).select("doc_id", "section_id", "status", "current_ord", "prior_ord")


def _token_sql(column: str) -> str:
    return f"list_filter(list_distinct(string_split({_NORM % column}, ' ')), lambda x: x <> '')"


_JACCARD = "case when len(s) = 0 and len(t) = 0 then 1.0 else len(list_intersect(s, t)) / (len(s) + len(t) - len(list_intersect(s, t)))::double end"
# Of the scored pairs of a document the best one by one: a pair a step, kept if both of its sides are free.
_GREEDY = f"""{_ALIGNED}, a as (select doc_id, current_ord as a, {_token_sql('ct')} as s from al where status = 'added'), r as (select doc_id, prior_ord as r, {_token_sql('pt')} as t from al where status = 'removed'),
    p as (select doc_id, a, r, {_JACCARD} as score from a join r using (doc_id)),
    k as (select *, row_number() over (partition by doc_id order by score desc, a, r) as n from p where score >= 0.2),
    walk as (select doc_id, 0::bigint as n, []::int[] as ua, []::int[] as ur from k where n = 1 union all
        select k.doc_id, k.n, case when list_contains(ua, a) or list_contains(ur, r) then ua else list_append(ua, a) end, case when list_contains(ua, a) or list_contains(ur, r) then ur else list_append(ur, r) end from walk join k on k.doc_id = walk.doc_id and k.n = walk.n + 1),
    ends as (select doc_id, arg_max(ua, n) as ua, arg_max(ur, n) as ur from walk group by doc_id),
    pick as (select doc_id, unnest(ua) as a, unnest(ur) as r from ends)"""


@query(f"with recursive {_GREEDY} select doc_id, a, r, round(score, 6) as score from pick join k using (doc_id, a, r)")
def alignment_best_pairs(spark, d):
    """JN3: all leftover lines that are alike, one to one, the best first."""
    return redline.similar_leftovers(_aligned(spark, d), "doc_id", least=0.2).withColumn("score", F.round("score", 6))


@query(f"""with recursive {_GREEDY}
    select al.doc_id, al.section_id, case when pick.r is not null then 'matched' else status end as status, current_ord, coalesce(prior_ord, pick.r) as prior_ord from al left join pick on pick.doc_id = al.doc_id and pick.a = al.current_ord and al.status = 'added'
    where not (status = 'removed' and exists (select 1 from pick q where q.doc_id = al.doc_id and q.r = al.prior_ord))""")
def alignment_fallback(spark, d):
    """JN3, GRD1: lines aligned by what they say, and the leftover ones that are alike as matched."""
    return redline.align_with_fallback(*_two_versions(spark, d), "doc_id", least=0.2).select("doc_id", "section_id", "status", "current_ord", "prior_ord")


@query(f"""with ver as ({P.VERSIONS_SQL}), {_SENT_A}, x as (select doc_id, sent_idx, {_token_sql('sentence')} as s from sent),
    p as (select v.doc_id, c.sent_idx as a, o.sent_idx as r, c.s, o.s as t from ver v join x c on c.doc_id = v.doc_id join x o on o.doc_id = v.prior_id)
    select doc_id, a, r, round({_JACCARD}, 6) as score from p where {_JACCARD} >= 0.5""")
def similar_sentences(spark, d):
    """JN4, SET2, SET3: sentences of a document and of its earlier version with half of their words in common, looked up by their rarest words."""
    pairs = written(P.versions(spark, d), "versions")
    named = pairs.select("doc_id").union(pairs.select(F.col("prior_id"))).distinct()
    docs = P.table(spark, d, "documents").select("doc_id", "text").join(named, "doc_id", "left_semi")
    said = written(docs.select("doc_id", F.transform(T.sentence_spans(F.col("text")), lambda x: F.array_join(T.token_set(x["text"]), " ")).alias("said")), "said")
    both = pairs.join(said, "doc_id").join(said.select(F.col("doc_id").alias("prior_id"), F.col("said").alias("was")), "prior_id")
    return similarity.similar_of_two(both, "said", "was", "doc_id").withColumn("score", F.round("score", 6))


def _versions(spark, d):
    docs = P.table(spark, d, "documents").select("doc_id", "text")
    half = F.split("text", "\n")
    older = F.array_join(F.filter(half, lambda x, i: i % 5 != 2), "\n")
    return docs.select("doc_id", F.col("text").alias("current_text"), F.regexp_replace(older, " of ", " with ").alias("prior_text"))


@query()
def section_redline(spark, d):
    """CMP8, SEQ1, SEQ2, JN4, AG15, NUM8, STR21: every document against an edited version of itself."""
    r = redline.redline(_versions(spark, d), "doc_id")
    return r.select("doc_id", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"), F.round("magnitude", 6).alias("magnitude"), "added_sentences", "removed_sentences", "reworded_sentences", "pct_changed", "summary")


@query("select doc_id, quality::int as added, toxic::int as removed, case when quality + toxic = 0 then 'The two versions say the same.' else array_to_string(list_filter([case when quality = 1 then '1 new sentence' end, case when toxic = 1 then '1 dropped sentence' end], lambda x: x is not null), ', ') || '; about ' || (doc_id % 100) || ' % of the text differs.' end as summary from labels")
def change_summaries(spark, d):
    """STR21 from counts alone."""
    rows = P.table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("added"), F.col("toxic").cast("int").alias("removed"))
    return rows.withColumn("summary", redline.change_summary(F.col("added"), F.col("removed"), F.lit(0), (F.col("doc_id") % 100), F.lit("")))


@query("select doc_id, section_id, rank::int as rank, label, severity, category, summary from (select doc_id, 'item_1a_risk_factors' as section_id, 1 as rank, case when doc_id % 100 >= 25 then 'Watch Item' else 'Neutral' end as label, case when doc_id % 100 >= 25 then 'Medium' else 'Low' end as severity, 'Risk' as category, 'changed' as summary from labels where doc_id % 100 >= 2)")
def change_cards(spark, d):
    """CMP13, FLT22, ORD5."""
    rows = P.table(spark, d, "labels").select("doc_id", F.lit("item_1a_risk_factors").alias("section_id"), ((F.col("doc_id") % 100) / 100).alias("magnitude"), F.lit("changed").alias("summary"))
    return insights.change_cards(rows, "doc_id")


# ── guards ───────────────────────────────────────────────────────────────────


_QUOTES = "select item_id, text as quote from benchmark union all select item_id + 100000, substr(text, 1, 14) from benchmark union all select item_id + 200000, substr(text, 8, 19) from benchmark union all select item_id + 300000, substr(text, 3, 26) from benchmark"


@query(f"with b as (select item_id, trim(substr(trim(quote), 1, 240)) as quote from ({_QUOTES})) select item_id, doc_id, (position(lower(quote) in lower(text)) - 1)::int as q_start, length(quote)::int as size from b, documents where length(quote) >= 12 and position(lower(quote) in lower(text)) > 0")
def evidence_lookup(spark, d):
    """JN14, STR8: items of the benchmark, and pieces of one to four words cut out of them, in all documents."""
    items = P.table(spark, d, "benchmark").select("item_id", "text")
    quotes = items.select("item_id", F.col("text").alias("quote"))
    for k, (at, size) in enumerate(((1, 14), (8, 19), (3, 26)), 1):
        quotes = quotes.unionByName(items.select((F.col("item_id") + k * 100000).alias("item_id"), F.substring("text", at, size).alias("quote")))
    docs = P.table(spark, d, "documents").select("doc_id", F.lit(1).alias("ord"), "text")
    return evidence.find_quotes(quotes, docs, "item_id", "doc_id").select("item_id", "doc_id", F.col("start").alias("q_start"), (F.col("end") - F.col("start")).alias("size"))


_SAID = [(1, "Margins rose. Investors should buy now. Cash grew."), (2, "A strong buy."), (3, "Nothing here. It holds."), (4, "We recommend buying it! Sales fell."), (5, "Results for Q3 FY2026 and Q1 2027 were filed.")]


@query("select * from (values (1, 'Margins rose. Cash grew.', true), (2, '', true), (3, 'Nothing here. It holds.', false), (4, 'Sales fell.', true), (5, 'Results for Q3 and Q1 were filed.', false)) as t(id, text, advised) union all select doc_id + 100, text, false from documents")
def advice_scrub(spark, d):
    """FLT24, STR9, STR10."""
    few = spark.createDataFrame(_SAID, "id bigint, text string")
    rows = few.unionByName(P.table(spark, d, "documents").select((F.col("doc_id") + 100).alias("id"), "text"))
    return rows.select("id", T.fiscal_labels(evidence.scrub_advice(F.col("text"))).alias("text"), evidence.is_advice(F.col("text")).alias("advised"))


@query()
def insight_titles(spark, d):
    """STR13, STR14, FLT25, WIN7: titles of statements, made distinct."""
    s = P.statements(spark, d).withColumn("title", insights.ensure_title(F.lit(""), F.col("sentence"), F.lit("Operations"))).withColumnRenamed("sentence", "summary")
    return insights.unique_titles(s, "conv_id", order="sent_idx").select("conv_id", "sent_idx", "title")


@query("select doc_id, ord, case when row_number() over (partition by doc_id, lower(trim(line)) order by ord) = 1 then line else '' end as line from " + _LINES)
def blanked_repeats(spark, d):
    """SET6: repeated lines of a document emptied."""
    return insights.blank_repeats(P.line_sections(spark, d), "line", "doc_id", order="ord").select("doc_id", "ord", "line")


# ── stores and clocks ────────────────────────────────────────────────────────

_STORE = "(select user_id, event_type, max(struct_pack(t := ts, i := event_id)) as m from events group by 1, 2)"


def _store(spark, d):
    ev = P.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return cache.upsert(ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1"), "user_id", "event_type", tie="event_id")


@query(f"select user_id, event_type, (m).i as event_id from {_STORE}")
def cache_upsert_latest(spark, d):
    """SNK1."""
    return _store(spark, d).select("user_id", "event_type", "event_id")


@query(f"select user_id, event_type from (select *, row_number() over (order by (m).t desc, user_id desc, event_type desc) as n from {_STORE}) where n > 80")
def lru_eviction(spark, d):
    """SNK1, ORD9: what goes beyond a cap of 80."""
    return cache.evictions(_store(spark, d), cache.CAPS["sentiment"], "user_id", "event_type").select("user_id", "event_type")


@query("with c as (select distinct user_id from events where event_type = 'purchase') select e.event_id, c.user_id is not null as hit from events e left join c using (user_id)")
def cache_hit_miss(spark, d):
    """SRC13: users with a cached record."""
    ev = P.table(spark, d, "events")
    return cache.lookup(ev.select("event_id", "user_id"), ev.where("event_type = 'purchase'").select("user_id").distinct(), "user_id").select("event_id", "hit")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by case event_type when 'view' then 1 else 2 end, ts desc, event_id) as n from events where event_type in ('view', 'click')) where n = 1")
def preferred_register(spark, d):
    """JN12, SNK5: of each user the latest view, else click."""
    ev = P.table(spark, d, "events").where("event_type in ('view', 'click')")
    latest = ev.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.col("ts").desc(), "event_id"))).where("k = 1")
    return cache.prefer_register(latest, "user_id", registers=("view", "click"), register="event_type").select("user_id", "event_id")


@query(f"select event_id, max(ms - i * 125) over (partition by user_id order by ms, event_id rows unbounded preceding) + i * 125 as start_ms from (select *, row_number() over (partition by user_id order by ms, event_id) - 1 as i from ({P.CLOCK_SQL}))")
def rate_limiter(spark, d):
    """ST4: starts 125 ms apart, by user."""
    return cache.limited_starts(P.clock(spark, d), "user_id", order="event_id").select("event_id", F.col("start").alias("start_ms"))


@query("select user_id, round(list_reduce(list_prepend(0.0::double, list(value order by ts, event_id)), lambda m, v: case when m = 0 then v else m * 0.7 + v * 0.3 end), 6) as mean from events group by user_id")
def ema_latency(spark, d):
    """WIN8, ST2."""
    rows = P.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("r"))
    return rows.select("user_id", F.round(cache.ema(F.transform("r", lambda x: x["value"])), 6).alias("mean"))


@query("with e as (select user_id, event_type, ts, event_id, lag(event_type) over (partition by user_id order by ts, event_id) as was from events), k as (select * from e where was is null or was <> event_type), n as (select *, lead(ts) over (partition by user_id order by ts, event_id) as nx from k) select user_id, event_id, floor(epoch(nx))::bigint - floor(epoch(ts))::bigint as wait from n where floor(epoch(nx))::bigint - floor(epoch(ts))::bigint > 86400")
def stall_gaps(spark, d):
    """ST8: waits of over a day between events that differ."""
    return cache.gaps(P.table(spark, d, "events"), "user_id", value="event_type", seconds=86400, tie="event_id").select("user_id", "event_id", "wait")


@query(f"""with recursive c as (select user_id, ms, row_number() over (partition by user_id order by ms, event_id) as k from ({P.CLOCK_SQL})),
    r as (select user_id, k, ms as at, 0::bigint as hits, 1::bigint as misses from c where k = 1 union all select c.user_id, c.k, case when c.ms - r.at < 100000 then r.at else c.ms end, r.hits + (c.ms - r.at < 100000)::bigint, r.misses + (c.ms - r.at >= 100000)::bigint from r join c on c.user_id = r.user_id and c.k = r.k + 1)
    select user_id, max(hits) as hits, max(misses) as misses from r group by user_id""")
def ttl_cache(spark, d):
    """ST5: entries live from their writing; reads don't renew them."""
    return cache.ttl_hits(P.clock(spark, d), "user_id", order="event_id", ttl=100000)


@query("with e as (select user_id, event_type, event_id, least(value, 50) as v from events), b as (select *, max(v) over (partition by user_id, event_type order by event_id rows unbounded preceding) as best from e), m as (select *, best - coalesce(lag(best) over (partition by user_id, event_type order by event_id), 0) as more from b), t as (select user_id, count(distinct event_type) * 50.0 as total from e group by user_id) select event_id, round(sum(more) over (partition by user_id order by event_id rows unbounded preceding) / total, 6) as share from m join t using (user_id)")
def load_progress(spark, d):
    """AG18: monotone shares of what is loaded."""
    ev = P.table(spark, d, "events").select("user_id", "event_type", "event_id", "value", F.lit(50.0).alias("size"))
    return cache.load_progress(ev, "user_id", file="event_type", loaded="value", order="event_id").select("event_id", F.round("share", 6).alias("share"))


# ── streams ──────────────────────────────────────────────────────────────────


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_progressive_counts(spark, d):
    """ST1: counts per hour through the incremental plan."""
    s = progress.running_counts(progress.read_events(spark, P.event_files(spark, d, again=0)), "event_type", delay="40 days")
    return progress.run_once(s).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("select user_id, count(*) as n, round(sum(value), 4) as total, max(struct_pack(ts := ts, event_id := event_id)).event_id as last_event from events group by user_id")
def stream_folded_table(spark, d):
    """SNK1, SNK9: events of each user folded into a keyed table, every micro-batch given twice and an old one once more; none counts again."""
    events = progress.read_events(spark, P.event_files(spark, d, again=0))
    rows = events.select("user_id", F.lit(1).cast("bigint").alias("n"), F.coalesce("value", F.lit(0.0)).alias("total"), F.struct("ts", "event_id").alias("last"))
    table = sinks.FoldedTable(spark, shared_folder(spark, "users"), rows.schema, ["user_id"], {"n": F.sum("n"), "total": F.sum("total"), "last": F.max("last")}, buckets=8)

    def again(batch, batch_id):
        table.merge(batch, batch_id)
        table.merge(batch, 0)

    sinks.fold_stream(rows, table, shared_folder(spark, "checkpoint"), again)
    return table.current(spark).select("user_id", "n", F.round("total", 4).alias("total"), F.col("last.event_id").alias("last_event"))


@query("""with e as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from (select user_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) <= 10800000000 then 0 else 1 end as new from events)),
    s as (select user_id, k, min(epoch_us(ts)) as first_us, max(epoch_us(ts)) as last_us, count(*) as n, k = max(k) over (partition by user_id) as final from e group by user_id, k)
    select user_id, first_us, last_us, n from s where not final or last_us // 1000 + 10800000 < (select max(epoch_us(ts)) // 1000 - 600000 from events)""")
def stream_silences(spark, d):
    """ST3, ST8: spells of activity that three hours of silence end, the last of a user by a timer."""
    events = progress.read_events(spark, P.event_files(spark, d, again=0))
    return progress.run_once(progress.silences(events, "user_id", 3 * 3_600_000), mode="append")


@query("with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 5 minutes then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from e) select user_id, count(*) as n, min(ts) as first from s group by user_id, k")
def stream_sessions(spark, d):
    """ST3, ST7: sessions with a gap of five minutes."""
    s = progress.sessions(progress.read_events(spark, P.event_files(spark, d, again=0)), "user_id", delay="40 days")
    return progress.run_once(s).select("user_id", "n", F.col("start").cast("timestamp_ntz").alias("first"))


@query("select count(distinct event_id) as n, count(distinct user_id) as users from events")
def stream_dedup(spark, d):
    """ST11: events that a later file repeats, dropped within the watermark."""
    s = progress.distinct_events(progress.read_events(spark, P.event_files(spark, d)), "event_id", delay="40 days")
    return progress.run_once(s, "append").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


# ── documents through several operators ──────────────────────────────────────


@query()
def html_normalised(spark, d):
    """SRC1, SRC2: normalised pages with segments and table ranges."""
    return html.normalised(P.table(spark, d, "pages"), "page_id").select("page_id", F.length("text").alias("n_chars"), F.size("segments").alias("n_segments"), F.size("tables").alias("n_tables"), F.sha2("text", 256).alias("text_sha256"))


@query()
def section_chunks(spark, d):
    """STR25: chunks of all documents."""
    return chunks.chunk_sections(P.table(spark, d, "documents"), "doc_id").select("doc_id", "chunk_idx", F.col("start").alias("c_start"), F.col("end").alias("c_end"))


_LOSS = r"loss(?:es)?|declin\w+|decreas\w+|weak\w*|threat\w*|adverse\w*|worthless|impair\w+|litigation"


_LABELS = rf"""k as (select doc_id, p, n, case when p > n and p / (p + n)::double >= 0.6 then 'positive' when n > p and n / (p + n)::double >= 0.6 then 'negative' else 'neutral' end as label
        from (select doc_id, len(regexp_extract_all(sentence, '(?i)\b(?:{_TONE})\b')) as p, len(regexp_extract_all(sentence, '(?i)\b(?:{_LOSS})\b')) as n from sent))"""


@query(f"with {_SENT_A}, {_LABELS} select doc_id, count_if(label = 'positive') as positive, count_if(label = 'negative') as negative, count_if(label = 'neutral') as neutral, count(*) as total from k group by doc_id")
def sentence_sentiment(spark, d):
    """CMP6, MDL1: the stand-in classifier over all sentences."""
    s = models.classify(sentences.sentences(P.table(spark, d, "documents"), "doc_id"))
    return sentiment.tally(s, "doc_id")


@query(rf"""with {_SENT_A}, l as (select doc_id, md5(coalesce(text, '')) as h, min(position(chr(10) in text)) as cut from documents group by all),
    st as (select distinct h from l where doc_id % 4 = 0),
    s as (select sent.doc_id, h, len(regexp_extract_all(sentence, '(?i)\b(?:{_TONE})\b')) as p, len(regexp_extract_all(sentence, '(?i)\b(?:{_LOSS})\b')) as n from sent join l using (doc_id) where not (cut > 0 and s_start < cut) and h not in (select h from st)),
    k as (select doc_id, case when p > n and p / (p + n)::double >= 0.6 then 'positive' when n > p and n / (p + n)::double >= 0.6 then 'negative' else 'neutral' end as label, case when p = n then 1.0 else greatest(p, n) / (p + n)::double end as score from s)
    select doc_id, false as cached, count(*) as n, count_if(label = 'positive') as positive, count_if(label = 'negative') as negative, round(sum(score), 6) as score from k group by doc_id
    union all select doc_id, true, 1, 0, 1, 0.75 from l where h in (select h from st)""")
def sentiment_pass(spark, d):
    """CMP6, MDL1, SRC13: documents that the store has are taken from there, the sentences of the others are scored once each, outside their first lines."""
    docs = P.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = F.when(F.instr("text", "\n") > 0, F.array(F.struct(F.lit(0).alias("s"), (F.instr("text", "\n") - 1).cast("int").alias("e"))))
    sections = docs.select("doc_id", F.md5("text").alias("text_hash"), F.lit("item_7_mdna").alias("section_id"), F.lit(1).alias("section_order"), F.lit(0).alias("start"), "text", first.alias("tables"))
    one = F.array(F.struct(F.lit(1).alias("place"), F.lit("item_7_mdna").alias("section_id"), F.lit(0).alias("sent_idx"), F.lit("negative").alias("label"), F.lit(0.75).alias("score"), F.lit(0).alias("start"), F.lit(1).alias("end")))
    store = sections.where("doc_id % 4 < 2").select("doc_id", "text_hash", F.when(F.col("doc_id") % 4 == 0, "words").otherwise("another").alias("model"), one.alias("results"))
    results, _ = scoring.sentiment_pass(sections, store, "doc_id", model="words", tables="tables")
    return results.groupBy("doc_id", "cached").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "positive").alias("positive"), F.count_if(F.col("label") == "negative").alias("negative"), F.round(F.sum("score"), 6).alias("score"))


@query()
def extractive_summary(spark, d):
    """CMP7, VEC2: the most central sentences of each document in reading order."""
    return _central(P.table(spark, d, "documents"), written(sentences.sentences(P.table(spark, d, "documents"), "doc_id"), "sentences"))


def _central(docs, every):
    s = every.withColumn("key", F.col("doc_id") * 100000 + F.col("sent_idx"))
    scored = vectors.centrality(s, "doc_id", id_col="key", vector="sentence", encoder=vectors.hashed_vectors).join(docs.select("doc_id", F.length("text").alias("size")), "doc_id").withColumn("score", F.round("score", 9))
    top = vectors.select_top(scored, vectors.target_count(F.col("size")), "doc_id", order="key")
    return top.select("doc_id", (F.col("key") % 100000).alias("sent_idx"), "place")


@query("select doc_id, 'report-' || source || '-10-K-2024-01-01.json' as name, 2 + length(text) - length(replace(text, chr(10), '')) > 0 as filled from documents")
def report_names(spark, d):
    """SNK7, SNK8."""
    name = report.file_name(F.col("source"), F.lit("10-K"), F.lit("2024-01-01T00:00"))
    return P.table(spark, d, "documents").select("doc_id", name.alias("name"), report.has_content(F.length("text")).alias("filled"))


def _report(spark, d):
    docs = P.table(spark, d, "documents").select("doc_id", "source", "lang")
    every = written(sentences.sentences(P.table(spark, d, "documents"), "doc_id"), "sentences")
    tone = sentiment.tally(models.classify(every), "doc_id")
    versions = _versions(spark, d)
    # the text goes through with its ranges, as a join would send all texts again; only what is shown is cut out
    told = redline.redline(versions, "doc_id", "current_text")
    changed = told.select("doc_id", "summary", report.shown_passages(F.transform(F.slice("added", 1, report.SHOWN), lambda r: F.substring(F.col("current_text"), r["start"] + 1, r["end"] - r["start"]))).alias("added"))
    known = facts.current_and_prior(P.facts(spark, d), "entity", "concept").withColumnRenamed("entity", "doc_id").select("doc_id", "concept", "current_end", "current_value", "prior_end", "prior_value")
    cards = insights.change_cards(P.table(spark, d, "labels").select("doc_id", F.lit("item_7_mdna").alias("section_id"), ((F.col("doc_id") % 100) / 100).alias("magnitude"), F.lit("changed").alias("summary")), "doc_id")
    best = _central(P.table(spark, d, "documents"), every).join(every, ["doc_id", "sent_idx"]).select("doc_id", "place", "sentence")
    parts = {"fundamentals": (known, None), "insights": (cards, "rank"), "summary": (best, "place"), "flags": (_flags(spark, d), "start"), "sentences": (every, "sent_idx"), "sentiment": (tone, None), "redline": (changed, None)}
    return report.assemble(docs, parts, "doc_id")


@query()
def export_report_rows(spark, d):
    """SNK5, SNK6, AG12: a JSON report per document: facts, insights, summary, flags, sentences, tone, and the passages that changed."""
    return _report(spark, d)


@query(f"""with {P.PICKED_SQL}, {_FLAGS}, {_SENT_A}, nf as (select doc_id, count(*) as n, min(f_start) as at from flags group by doc_id), ns as (select doc_id, count(*) as n, arg_max(sentence, sent_idx) as last from sent group by doc_id),
    nk as (select entity as doc_id, count(*) as n, round(sum(current_value), 2) as total from picked group by entity)
    select doc_id, source, coalesce(nk.n, 0) as n_facts, nk.total, (doc_id in (select doc_id from labels where doc_id % 100 >= 2))::int as n_insights,
        least(coalesce(ns.n, 0), case when length(text) < 500 then 2 when length(text) < 2000 then 3 when length(text) < 8000 then 5 when length(text) < 20000 then 7 else 9 end) as n_summary,
        coalesce(nf.n, 0) as n_flags, nf.at as first_flag, coalesce(ns.n, 0) as n_sentences, md5(ns.last) as last_sentence from documents left join nk using (doc_id) left join nf using (doc_id) left join ns using (doc_id)""")
def report_parts(spark, d):
    """SNK6: what the reports hold, read back from their JSON."""
    kind = "source string, fundamentals array<struct<current_value:double>>, insights array<struct<label:string>>, summary array<struct<place:int>>, flags array<struct<start:int>>, sentences array<struct<sentence:string>>, sentiment array<struct<total:bigint>>, redline array<struct<summary:string>>"
    r = json.parsed_strictly(_report(spark, d), kind, "report")
    n = lambda part: F.size(f"parsed.{part}").cast("bigint")
    total = F.round(F.aggregate("parsed.fundamentals", F.lit(0.0), lambda a, x: a + x["current_value"]), 2)
    return r.select(
        "doc_id", "parsed.source", n("fundamentals").alias("n_facts"), F.when(n("fundamentals") > 0, total).alias("total"), n("insights").cast("int").alias("n_insights"), n("summary").alias("n_summary"), n("flags").alias("n_flags"),
        F.get("parsed.flags.start", F.lit(0)).alias("first_flag"), n("sentences").alias("n_sentences"), F.md5(F.try_element_at(F.col("parsed.sentences.sentence"), F.lit(-1))).alias("last_sentence"),
    )


# ── further operators ────────────────────────────────────────────────────────

_FINE = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"


@query("select page_id, case when regexp_matches(html, 'class=\"ad\"') then 'consent_wall' when regexp_matches(html, '<nav>') then 'paywall' else 'open' end as gate from " + _ALL_PAGES)
def gate_states(spark, d):
    """FLT16: consent before paywall before open."""
    return _pages(spark, d).select("page_id", classify.gate_state(F.col("html"), F.lit('class="ad"'), F.lit("<nav>")).alias("gate"))


@query(f"with g as (select *, case when segmentation = 'low' then true when category = 'edgar_filing' or form = 'DATA_REPORT' then false when by_headings or form = 'UNKNOWN' then true else n_sections <= 1 end as low from {_GATE_SQL}) select doc_id, category, form, segmentation, by_headings, n_sections, case when form = 'DATA_REPORT' or (category = 'edgar_filing' and form = 'UNKNOWN' and n_sections <= 1) or (low and category not in ('ir_or_financial', 'pdf')) then 'summary' when (low and category in ('ir_or_financial', 'pdf')) or category = 'pdf' then 'summary,analyst,sentiment' else 'summary,analyst,sentiment,changes' end as capabilities from g")
def document_capabilities(spark, d):
    """FLT9, over all combinations."""
    g = _gated(spark, d)
    low = classify.low_confidence(F.col("category"), F.col("form"), F.col("segmentation"), F.col("by_headings"), F.col("n_sections"))
    return g.withColumn("capabilities", F.array_join(ingest.capabilities(F.col("category"), F.col("form"), low, F.col("n_sections")), ","))


@query("select conv_id, case when length(b) >= 200 then b else a end as text from (select conv_id, max(case when turn = 0 then text end) as a, arg_max(text, struct_pack(l := length(text), t := turn)) filter (turn > 0) as b from conversations group by conv_id) where coalesce(length(b), 0) >= 200 or a is not null")
def longest_frames(spark, d):
    """SRC3, AG20: the first turn stands for the top document, the others for its frames."""
    frames = P.table(spark, d, "conversations").withColumn("is_top", F.col("turn") == 0)
    # of equally long frames the last counts, in both engines
    return html.longest_frame(frames, "conv_id", least=200, order="turn").where("text is not null")


@query("with r as (select o_custkey, o_orderkey from orders where o_orderkey % 3 <> 0), x as (select distinct o_custkey from r) select o_custkey, o_orderkey from r union all select o.o_custkey, o.o_orderkey from orders o where o.o_orderkey % 3 = 0 and o.o_custkey not in (select o_custkey from x)")
def filings_with_continuation(spark, d):
    """SRC10, SET1: older filings only for those who have no recent one."""
    o = P.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    recent = o.where("o_orderkey % 3 <> 0")
    return priors.with_continuation(recent, o.where("o_orderkey % 3 = 0"), recent, "o_custkey")


@query("select event_id from events where user_id not in (select user_id from events where event_type = 'purchase' and value > 90)")
def cache_delete(spark, d):
    """SNK2: records of some keys deleted."""
    ev = P.table(spark, d, "events")
    return cache.delete(ev, ev.where("event_type = 'purchase' and value > 90"), "user_id").select("event_id")


@query("select event_id, case when event_id % 5 = 4 then 250.0 else 600.0 * power(2, event_id % 4) + event_id % 250 end as wait from events")
def retry_backoff(spark, d):
    """ST6: doubling waits with jitter; what the server asks for wins."""
    i = F.col("event_id")
    return P.table(spark, d, "events").select("event_id", cache.backoff(i % 4, i % 250, F.when(i % 5 == 4, 250.0)).alias("wait"))


@query(f"with {_FLAGS}, p as (select distinct doc_id, (doc_id * 37) % 2000 as position from documents), h as (select p.doc_id, p.position, f.type, row_number() over (partition by p.doc_id order by f_start, f_end, term) as n, f_start from p join flags f on f.doc_id = p.doc_id and f_start <= position and position < f_end + 200) select p.doc_id, p.position, h.f_start from p left join h on h.doc_id = p.doc_id and n = 1")
def flag_at_position(spark, d):
    """JN9: the first flag, widened by 200 characters, that covers a position of each document."""
    points = P.table(spark, d, "documents").select("doc_id", ((F.col("doc_id") * 37) % 2000).alias("position")).distinct()
    wide = _flags(spark, d).select("doc_id", "start", (F.col("end") + 200).alias("end"))
    return ingest.at_position(points, wide, "doc_id").select("doc_id", "position", F.col("start").alias("f_start"))


@query(f"select doc_id, ord, case when length(line) > 0 and instr(text, chr(10)) > 0 and s_start < 500 and s_start + length(line) > 100 then 1 else 0 end as n_tables from (select doc_id, ord, line, text, coalesce(sum(length(line) + 1) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding), 0) as s_start from {_LINES} join (select doc_id, text from documents) using (doc_id))")
def tables_by_section(spark, d):
    """JN10: the table range 100 to 500 given to the lines it overlaps."""
    lines = sentences.lines(P.table(spark, d, "documents").withColumn("many", F.contains("text", F.lit("\n"))), "doc_id", "many")
    with_tables = ingest.tables_of(lines, F.array(F.struct(F.lit(100).alias("s"), F.lit(500).alias("e"))))
    return with_tables.select("doc_id", "ord", F.when(F.col("many") & (F.length("line") > 0), F.size("tables")).otherwise(0).alias("n_tables"))


@query(f"with {_HITS}, {_SECTIONS} select conv_id, section_id, case when section_id = 'item_1_business' then 'What it does' else replace(section_id, '_', ' ') end as label from sections")
def section_labels(spark, d):
    """JN11: labels of sections, or their ids."""
    s = segment.item_sections(P.filings(spark, d), "conv_id").select("conv_id", "section_id")
    labels = s.where("section_id = 'item_1_business'").distinct().withColumn("label", F.lit("What it does"))
    return ingest.labelled(s, labels, "conv_id")


@query(f"with {_HITS}, {_SECTIONS}, w as (select * from (values (3, 'item_1_business'), (2, 'item_1a_risk'), (0, 'item_7_mdna'), (1, 'item_7a')) as w(i, p)), h as (select distinct conv_id, section_id, i from sections join w on starts_with(section_id, p)) select conv_id, section_id, row_number() over (partition by conv_id order by i)::int as rank from h qualify rank <= 3")
def first_to_summarise(spark, d):
    """ORD7."""
    return ingest.first_to_summarise(segment.item_sections(P.filings(spark, d), "conv_id"), "conv_id")


@query("select event_id, case when value <= 0 then 'Scoring x…' when ceil(value * 3) <= 3 then 'Scoring x… almost done' when ceil(value * 3) < 90 then 'Scoring x… about ' || ceil(value * 3)::bigint || 's left' else 'Scoring x… about ' || floor(ceil(value * 3) / 60 + 0.5)::bigint || ' min left' end as told from events")
def remaining_time(spark, d):
    """NUM12."""
    return P.table(spark, d, "events").select("event_id", ingest.remaining(F.lit("x"), F.col("value") * 3000).alias("told"))


@query(f"select doc_id, string_agg(line, chr(10) order by ord) filter (used <= 400) as digest from (select *, sum(length(line) + 1) over (partition by doc_id order by ord rows unbounded preceding) as used from (select doc_id, unnest({_FINE}) as line, generate_subscripts({_FINE}, 1) as ord from documents)) group by doc_id having min(length(line) + 1) filter (ord = 1) <= 400")
def synthesis_digest(spark, d):
    """STR34: lines up to a budget of 400 characters; nothing after the first that passes it."""
    docs = P.table(spark, d, "documents")
    out = insights.digest(F.filter(F.split("text", "\n"), lambda x: x != ""), 400)
    return docs.select("doc_id", out.alias("digest")).where("digest <> ''")


@query("""with t as (select conv_id, list(regexp_replace(text, '\\s+', ' ', 'g') order by turn) filter (role = 'user') as u, list(regexp_replace(text, '\\s+', ' ', 'g') order by turn) filter (role = 'assistant') as a from conversations where text is not null group by conv_id)
    select conv_id, array_to_string(list_concat(['Signals'], list_concat(list_transform(coalesce(u, [])[1:4], lambda x: '[risk] ' || x), list_transform(coalesce(a, [])[1:3], lambda x: '[narrative] ' || x))), chr(10)) as digest from t""")
def digest_items(spark, d):
    """STR34: the first four items of a list and three of the narrative, each with its name."""
    said = P.table(spark, d, "conversations").where("text is not null").select("conv_id", "role", F.struct("turn", F.regexp_replace("text", r"\s+", " ").alias("text")).alias("x"))
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("x")))), lambda x: x["text"])
    rows = said.groupBy("conv_id").agg(of("user").alias("risk"), of("assistant").alias("narrative"))
    return rows.select("conv_id", F.array_join(insights.digest_lines(F.lit("Signals"), {"risk": F.col("risk"), "narrative": F.col("narrative")}), "\n").alias("digest"))


@query("select event_id, case when event_type in ('view', 'click') then event_type else 'other' end as kind, case when value between 1 and 5 then floor(value + 0.5)::int else 3 end as score from events")
def coerced_values(spark, d):
    """STR33: enums and scores with defaults."""
    return P.table(spark, d, "events").select("event_id", insights.coerce(F.col("event_type"), ["view", "click"], "other").alias("kind"), models.score_1_to_5(F.col("value")).alias("score"))


@query(f"""with t as (select source, {_TALLY} from ({_CAL}) group by source), p as (select source, floor(positive * 100.0 / total + 0.5)::bigint as a, floor(negative * 100.0 / total + 0.5)::bigint as b, floor(neutral * 100.0 / total + 0.5)::bigint as c from t)
    select source, 'The tone is ' || case when c >= 60 then 'mostly neutral' when c >= 40 then 'largely neutral, with some directional tone' else 'unusually opinionated' end || ': ' || case when a - b >= 8 then 'positive statements prevail' when a - b <= -8 then 'negative statements prevail' else 'positive and negative statements balance' end || ' (' || a || '% against ' || b || '%).' as told from p""")
def tone_consensus(spark, d):
    """ARR3."""
    t = sentiment.tally(_calibrated(spark, d), "source")
    return t.select("source", sentiment.consensus(*[F.col(c) for c in ("positive", "negative", "neutral", "total")]).alias("told"))


@query("select doc_id, sha256(coalesce(text, '')) as hash from documents")
def content_hashes(spark, d):
    """STR24."""
    return P.table(spark, d, "documents").select("doc_id", ingest.content_hash(F.col("text")).alias("hash"))


@query("select c_custkey, case when c_custkey % 4 <> 3 then c_name end as company, case c_custkey % 3 when 0 then strftime(date '2020-01-31' + (c_custkey % 900)::int, '%Y-%m-%d') when 1 then '2022-03-31' end as period, case when c_custkey % 5 <> 4 then substr(c_mktsegment, 1, 4) end as ticker from customer")
def cover_pages(spark, d):
    """STR27, SRC6: covers of customers as registrants, some without a name, a period or a symbol."""
    c, key = P.table(spark, d, "customer"), F.col("c_custkey")
    day = F.date_format(F.date_add(F.lit("2020-01-31").cast("date"), (key % 900).cast("int")), "MMMM d, yyyy")
    name = F.concat("c_name", F.when(key % 4 != 3, F.lit("\n(Exact name of registrant as specified)\n")).otherwise("\n"))
    period = F.when(key % 3 == 0, F.concat(F.lit("For the fiscal year ended "), day)).when(key % 3 == 1, "For the quarterly period ended: March 31, 2022").otherwise("No period")
    text = F.concat(F.lit("FORM\n"), name, period, F.when(key % 5 != 4, F.concat(F.lit("\nTrading Symbol(s)\n"), F.substring("c_mktsegment", 1, 4), F.lit("\n"))).otherwise(""))
    found = files.cover(text)
    return c.select("c_custkey", found["company"].alias("company"), found["period"].alias("period"), found["ticker"].alias("ticker"))


@query("select page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) as company from pages union all select * from (values (-1, 'Linked Org'), (-2, 'Declared Inc'), (-3, 'Site'))")
def company_names(spark, d):
    """STR28, STR29: declared, linked, site and heading names."""
    few = [(-1, '<script type="application/ld+json">{"@graph": [{"@type": "Thing"}, {"publisher": {"@type": ["NewsOrganization"], "name": " Linked Org "}}]}</script><h1>x y</h1>'), (-2, '<ix:nonNumeric name="dei:EntityRegistrantName" contextref="c">Declared Inc</ix:nonNumeric>'), (-3, '<meta property="og:site_name" content="Site"><script type="application/ld+json">{bad</script>')]
    pages = P.table(spark, d, "pages").select("page_id", "html").unionByName(spark.createDataFrame(few, "page_id bigint, html string"))
    return pages.select("page_id", ingest.company_name(F.col("html")).alias("company"))


@query()
def page_ingest(spark, d):
    """CMP1: pages to documents."""
    docs, _ = ingest.ingest(P.table(spark, d, "pages"), "page_id")
    return docs.select("page_id", "category", "form", "confidence", "company", "segmentation", "n_sections", "text_hash")


@query()
def finalised_insights(spark, d):
    """CMP12: statements through all guards against their own conversation."""
    st = P.statements(spark, d).select("conv_id", "sent_idx", F.lit("A title").alias("title"), F.col("sentence").alias("summary"), F.lit("Investors should buy. It matters.").alias("why"), F.lit("").alias("meaning"), F.lit("High").alias("confidence"))
    src = P.table(spark, d, "conversations").select("conv_id", F.concat("text", F.lit(" 12%")).alias("text"))
    return evidence.finalise(st, src, "conv_id").select("conv_id", "sent_idx", "summary", "why", "confidence")


@query()
def deterministic_analysis(spark, d):
    """CMP11, CMP16, AG17: the analysis of conversations as filings."""
    st = P.statements(spark, d)
    docs = st.select("conv_id").distinct().select("conv_id", F.lit("Acme").alias("company"), F.lit("10-K").alias("form"))
    sents = models.classify(st).select("conv_id", "label")
    fl = flags.flag(P.table(spark, d, "conversations"), flags.lexicon(spark), "conv_id")
    red = docs.select("conv_id", F.lit("item_7_mdna").alias("section_id"), ((F.col("conv_id") % 50) / 100).alias("magnitude"), F.lit("changed").alias("summary"))
    fx = docs.select("conv_id", F.lit("Revenue").alias("label"), F.lit("USD").alias("unit"), F.lit(1.25e9).alias("current_value"), F.lit(0.1).alias("yoy"))
    return analysis.analyse(docs, st, sents, fl, red, fx, "conv_id")


@query("select user_id, count(*) as n, round(list_reduce(list(value order by ts, event_id), lambda m, v: m * 0.7 + v * 0.3), 6) as mean from events group by user_id")
def running_means(spark, d):
    """ST2, WIN8: exponential means kept as state over micro-batches."""
    s = progress.running_means(progress.read_events(spark, P.event_files(spark, d, again=0)), "user_id", order=("ts", "event_id"))
    return progress.run_once(s, "update").groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("mean", "n"), 6).alias("mean"))


# ── composites and what belongs to them ──────────────────────────────────────


@query("select o_orderkey, strftime(o_orderdate, '%B %-d, %Y') as long, strftime(o_orderdate, '%b %-d, %Y') as short from orders union all select * from (values (-1, '', ''), (-2, 'soon', 'soon'))")
def calendar_dates(spark, d):
    """DAT2: dates for display, whatever the time zone."""
    few = spark.createDataFrame([(-1, None), (-2, "soon")], "o_orderkey bigint, iso string")
    rows = P.table(spark, d, "orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:59:59Z")).alias("iso")).unionByName(few)
    return rows.select("o_orderkey", T.calendar_date(F.col("iso")).alias("long"), T.calendar_date(F.col("iso"), short=True).alias("short"))


@query(r"""with c as (select doc_id, [trim(regexp_replace(x, '\s+', ' ', 'g')) for x in string_split(text, chr(10))[1:6]] as flat, [trim(regexp_replace(x, '\s+', ' ', 'g')) for x in string_split(text, chr(10))[1:4]] as few from documents)
    select doc_id, array_to_string([case when length(x) > 220 then substr(x, 1, 220) || '…' else x end for x in flat], '|') as shown, array_to_string([case when length(x) > 280 then substr(x, 1, 280) || '…' else x end for x in few], '|') as prompted from c""")
def display_limits(spark, d):
    """ORD8: six passages of 220 characters on display, four of 280 in a prompt."""
    lines = F.split("text", "\n")
    shown, prompted = report.shown_passages(lines), report.shown_passages(lines, report.SNIPPETS, report.SNIPPET_CHARS)
    return P.table(spark, d, "documents").select("doc_id", F.array_join(shown, "|").alias("shown"), F.array_join(prompted, "|").alias("prompted"))


@query("select event_id, lead(event_id) over (partition by user_id, event_type order by ts, event_id) is not null as aborted, lead(ts) over (partition by user_id, event_type order by ts, event_id) as aborted_at from events")
def last_in_flight(spark, d):
    """ST9: of the runs of a key only the newest isn't aborted."""
    ev = P.table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return cache.last_in_flight(ev, "user_id", "event_type", tie="event_id").select("event_id", "aborted", "aborted_at")


@query("with c as (select * from events where event_type = 'view' and event_id % 2 = 0), k as (select distinct user_id from c) select event_id, true as replayed from c union all select event_id, false from events where event_type = 'click' and user_id not in (select user_id from k)")
def cached_replay(spark, d):
    """ST10: events of users in the cache are replayed, those of others come live."""
    ev = P.table(spark, d, "events").select("user_id", "event_id", "event_type")
    return cache.replay(ev.where("event_type = 'view' and event_id % 2 = 0"), ev.where("event_type = 'click'"), "user_id").select("event_id", "replayed")


@query(f"with {_FLAGS}, m as (select max(doc_id) as doc_id from documents) select m.doc_id, 0::bigint as others, coalesce((select count(*) from flags f where f.doc_id = m.doc_id), 0) as n_flags, 0::bigint as after_clearing from m")
def session_store(spark, d):
    """SNK3, SNK4, SRC14: a document opened evicts all others; read back with its flags; then every cache is cleared."""
    docs = P.table(spark, d, "documents").select("doc_id", "text")
    opened = docs.join(F.broadcast(docs.agg(F.max("doc_id").alias("doc_id"))), "doc_id", "left_semi")
    store = cache.session_of(docs, opened, "doc_id")
    read = cache.read_session(store, _flags(spark, d).select("doc_id", "type", "start", "end"), "doc_id")
    (cleared,) = cache.drop_all(store)
    counts = read.select("doc_id", F.size("flags").cast("bigint").alias("n_flags"))
    others = store.agg((F.count("*") - 1).alias("others"))
    return counts.join(F.broadcast(others), F.lit(True)).join(F.broadcast(cleared.agg(F.count("*").alias("after_clearing"))), F.lit(True)).select("doc_id", "others", "n_flags", "after_clearing")


_URGENT = "select o_custkey as c, o_orderkey as k, strftime(o_orderdate, '%Y-%m-%d') as d, o_orderkey % 3 <> 0 as recent from orders where o_orderpriority = '1-URGENT'"
_CHOSEN = """select q.c, coalesce(max(struct_pack(d := o.d, k := o.k)) filter (o.d < q.period).k, case when q.period is not null then list_sort(list(o.k) filter (o.d = q.period), 'DESC')[2] end, case when q.period is null then list_sort(list(struct_pack(d := o.d, k := o.k)), 'DESC')[2].k end) as k
    from q join o on o.c = q.c where {} group by q.c, q.period"""


@query(f"""with o as ({_URGENT}), q as (select o_custkey as c, case when o_custkey % 2 = 0 then max(strftime(o_orderdate, '%Y-%m-%d')) end as period from orders group by 1),
    a as ({_CHOSEN.format('o.recent')}), first as (select * from a where k is not null), b as ({_CHOSEN.format('q.c not in (select c from first)')})
    select c as o_custkey, k::varchar as accession, 'https://www.sec.gov/Archives/edgar/data/' || c || '/' || k || '/doc.htm' as url from (select * from first union all select * from b where k is not null)""")
def resolved_priors(spark, d):
    """CMP15, SRC10, STR19: priors by period, in words or unknown, from recent filings, else with those of the continuation."""
    o = P.table(spark, d, "orders")
    rows = o.select("o_custkey", F.format_string("%012d", "o_orderkey").alias("accession"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("report_date"), F.lit("").alias("filing_date"), F.col("o_orderpriority").alias("form"), F.lit("doc.htm").alias("document"), (F.col("o_orderkey") % 3 != 0).alias("recent"))
    asked = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("day")).select("o_custkey", F.lit("1-URGENT").alias("wanted_form"), F.when(F.col("o_custkey") % 2 == 0, F.date_format("day", "MMMM d, yyyy")).otherwise("unknown").alias("period"))
    found = composites.resolve_priors(asked, rows.where("recent").drop("recent"), rows.where("not recent").drop("recent"), "o_custkey", cik="o_custkey")
    plain = F.regexp_replace("accession", "^0+(?=.)", "")
    return found.select("o_custkey", plain.alias("accession"), F.regexp_replace("url", "/0+([0-9]+/doc)", "/$1").alias("url"))


@query()
def filing_comparison(spark, d):
    """CMP8, SET7, JN2, JN3: turns as sections against versions with edited, dropped and renamed ones, section by section."""
    turns = P.table(spark, d, "conversations")
    ids = F.array(*[F.lit(x) for x in ("item_7_mdna", "item_1a_risk_factors", "item_2_properties", "item_7a_market_risk")])
    now = turns.groupBy("conv_id", (F.col("turn") % 4).cast("int").alias("ord")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    now = now.select("conv_id", F.get(ids, F.col("ord")).alias("section_id"), "ord", "text")
    renamed = F.when((F.col("conv_id") % 4 == 1) & (F.col("ord") == 0), "item_99_other").otherwise(F.col("section_id"))
    was = now.where("ord <> 1 or conv_id % 3 <> 0").withColumn("section_id", renamed).withColumn("text", F.regexp_replace("text", r"(\w+)\. ", "$1 indeed. "))
    told = redline.compare_filings(now, was, "conv_id")
    return told.select("conv_id", "section_id", "status", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"), F.round("magnitude", 6).alias("magnitude"), "summary")


@query()
def semantic_excerpts(spark, d):
    """CMP10, ORD6: excerpts ranked by words and by meaning."""
    return composites.semantic_excerpts(P.statements(spark, d), ["revenue", "risk"], 1500, "conv_id").select("conv_id", F.sha2("excerpt", 256).alias("excerpt_sha256"), "used")


def card_model(prompt: str) -> str | None:
    """A stand-in for a generative model: no answer for some prompts, else a card about the prompt's first statement."""
    import json

    stage, _, body = prompt.partition("\n")
    if len(body) % 4 == 0:
        return None
    first = body.split(". ")[0][:200]
    return "```json\n" + json.dumps([{"title": "", "summary": first, "why": "Investors should buy. It matters 99,999.", "label": "Odd", "severity": "High", "confidence": "High", "evidence": first[:30]}]) + "\n```"


@query()
def staged_analysis(spark, d):
    """CMP14, CMP12, MDL3, MDL4, JSN1: a model's cards over the deterministic floor."""
    st = P.statements(spark, d)
    cards, docs = composites.staged_analysis(st, analysis.dimension_cards(st, 2, "conv_id"), "conv_id", model=card_model)
    return cards.join(docs.select("conv_id", "degraded"), "conv_id").select("conv_id", "stage", "pos", "category", "title", "confidence", "source", "degraded")


@query()
def section_summaries(spark, d):
    """CMP17, JN12, SNK1: cached summaries, a model's notes, and extracts where it has none."""
    sections = segment.item_sections(P.filings(spark, d), "conv_id").select("conv_id", "section_id", "text")
    anchors = F.array(F.struct(F.lit(0).alias("start"), F.lit(5).alias("end")))
    store = sections.where("conv_id % 5 = 0").select("conv_id", "section_id", F.lit("extractive").alias("register"), F.lit("cached").alias("summary"), anchors.alias("anchors"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    told, _ = composites.summarise(sections, store, "builtin", "conv_id", "section_id", model=card_model)
    return told.select("conv_id", "section_id", "register", F.sha2("summary", 256).alias("summary_sha256"), "from_cache")


def _type_sql(kind: str) -> str:
    return q(r"(?i)\b(?:" + "|".join(re.escape(term) for t, term, *_ in LEXICON if t == kind) + r")\b")


_WHY_SQL = "concat_ws(' ', case dim " + " ".join(f"when {q(x)} then {q(n)}" for x, n in insights.SUBJECT.items()) + " end, " + ", ".join(f"case when regexp_matches(sentence, {_type_sql(k)}) then {q(n)} end" for k, n in insights.CAVEAT.items()) + ")"
_NUMERIC_SQL = r"regexp_matches(sentence, '\$\s?[\d,.]+|\d+(?:\.\d+)?\s?%|\b\d{2,}\b')"


@query(rf"""with st as ({P.STATEMENTS_SQL}), t as (select *, len(regexp_extract_all(sentence, '(?i)\b(?:{_TONE})\b')) - len(regexp_extract_all(sentence, {_type_sql('negative')})) as b, {_NUMERIC_SQL} as fig,
        conv_id % 3 as k from st),
    x as (select conv_id, sent_idx, sentence, b, fig, k, unnest(list_filter([{", ".join(f"case when {_hit(x)} then {q(x)} end" for x in KEYWORDS)}], lambda x: x is not null)) as dim from t)
    select conv_id, sent_idx, dim, {_WHY_SQL} as why,
        case when b <> 0 then case when b > 0 then 'More good than bad news' else 'More bad than good news' end || case when fig then ', with figures to compare.' else ', without a figure.' end
            when fig then 'A figure to compare with the period before.' when k = 0 then '' else case when k = 1 then 'The text around it leans to the good.' else 'The text around it leans to the bad.' end end as meaning from x""")
def insight_notes(spark, d):
    """STR30: why statements matter and what they mean."""
    st = P.statements(spark, d).select("conv_id", "sent_idx", "sentence", F.explode(relevance.dimensions(F.col("sentence"))).alias("dim"))
    numeric, around = F.col("sentence").rlike(relevance.NUMERIC), F.col("conv_id") % 3  # the tone around: none, good, bad
    return st.select("conv_id", "sent_idx", "dim", insights.why_it_matters(F.col("sentence"), F.col("dim")).alias("why"), insights.what_it_means(F.col("sentence"), numeric, around + 2, 1.5 - around, F.when(around == 0, "Neutral").otherwise("Mixed")).alias("meaning"))


@query(f"""with {_FLAGS}, k as (select doc_id, type, count(*) as n from flags group by 1, 2), f as (select doc_id, string_agg(replace(type, '_', ' ') || ' ' || n, ', ' order by n desc, type) as flagged from k group by 1)
    select doc_id, 'Facts: Revenue $' || doc_id || 'M' || coalesce(chr(10) || 'Flags: ' || flagged, '') as hints from documents left join f using (doc_id)""")
def analysis_hints(spark, d):
    """CMP16: what is known without a model, as hints."""
    docs = P.table(spark, d, "documents").select("doc_id")
    types = _flags(spark, d).groupBy("doc_id", "type").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.collect_list(F.struct("type", "n")).alias("types"))
    nothing = F.lit(0).cast("bigint")
    rows = docs.join(types, "doc_id", "left").withColumn("types", F.coalesce("types", F.array().cast("array<struct<type:string,n:bigint>>")))
    head = F.concat(F.lit("Revenue $"), F.col("doc_id").cast("string"), F.lit("M"))
    return rows.select("doc_id", analysis.hints(head, nothing, nothing, nothing, F.col("types"), F.array().cast("array<string>")).alias("hints"))


@query("with o as (select event_id as id, 400 + event_id % 700 as first, (event_id % 11 + 1) * 900 as later from events) select id as event_id, (case when first >= 750 and later >= 500 then 500 when later + 500 <= 8000 then later + 500 else 8000 end)::bigint as ready_ms, (first >= 750 and later >= 500) or later + 500 <= 8000 as settled from o")
def ready_pages(spark, d):
    """SRC15: when a growing page may be read: enough text, at rest, or after the longest wait."""
    ev = P.table(spark, d, "events").select("event_id", (F.col("event_id") % 700 + 400).alias("first"), ((F.col("event_id") % 11 + 1) * 900).alias("later"))
    seen = F.array(F.struct(F.lit(0).cast("bigint").alias("ms"), F.col("first").alias("size")), F.struct(F.col("later").alias("ms"), (F.col("first") + 5000).alias("size")))
    return progress.ready_at(ev.select("event_id", F.explode(seen).alias("s")).select("event_id", "s.ms", "s.size"), "event_id")


@query(r"""select doc_id, trim(regexp_replace(translate(text, '‘’“”–—•' || chr(160), '''''""--* '), '\s+', ' ', 'g')) as plain, replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as shown from (select doc_id, text, string_split(text, chr(10))[1] as line from documents)""")
def report_texts(spark, d):
    """STR22, STR31: plain text for reports, and a text that stands in HTML as it is."""
    docs = P.table(spark, d, "documents")
    return docs.select("doc_id", T.report_text(F.col("text")).alias("plain"), report.escaped(F.split("text", "\n")[0]).alias("shown"))


@query("select conv_id, turn, case when turn % 3 = 0 then 'true:point ' || turn || '|false:' || role when turn % 3 = 1 then 'true:' || substr(text, 3, 5) else 'false:note' end as items from conversations where length(text) >= 7")
def summary_items(spark, d):
    """STR23, SNK6: cached summaries as items of a report: notes without their marks, passages, plain notes."""
    c = P.table(spark, d, "conversations").where("length(text) >= 7")
    third = F.col("turn") % 3
    note = F.when(third == 0, F.concat(F.lit("  - **point "), F.col("turn").cast("string"), F.lit("**\n\n"), F.col("role"))).when(third == 2, "note").otherwise("")
    anchors = F.when(third == 1, F.array(F.struct(F.lit(2).alias("start"), F.lit(7).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    items = report.summary_items(F.when(third == 0, "builtin").otherwise("extractive"), note, anchors, F.col("text"))
    return c.select("conv_id", "turn", F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["bullet"].cast("string"), x["text"])), "|").alias("items"))


@query("select o_custkey, 'https://data.sec.gov/submissions/CIK' || lpad(o_custkey::varchar, 10, '0') || '.json' as url, 'https://data.sec.gov/submissions/CIK' || lpad(o_custkey::varchar, 10, '0') || '-submissions-001.json' as older from (select distinct o_custkey from orders)")
def submission_addresses(spark, d):
    """STR19, SRC9, SRC10: where a company's submissions and their continuation are."""
    rows = P.table(spark, d, "orders").select("o_custkey").distinct()
    name = F.concat(F.lit("CIK"), classify.padded_cik(F.col("o_custkey")), F.lit("-submissions-001.json"))
    return rows.select("o_custkey", classify.submissions_url(F.col("o_custkey")).alias("url"), composites.continuation_url(name).alias("older"))


@query("""with m as (select user_id, 2020 + event_id % 3 as y from events union all select user_id, 2020 + user_id % 4 from events), c as (select user_id, y, count(*) as n from m group by 1, 2), k as (select *, row_number() over (partition by user_id order by n desc, y) as r, coalesce(lead(n) over (partition by user_id order by n desc, y), 0) as nx from c)
    select user_id, y::int as year, n from k where r = 1 and n >= 3 and n >= 2 * nx""")
def fiscal_years_of_texts(spark, d):
    """AG14, FLT26: the year that the texts of a user name most."""
    said = F.concat(F.lit("Fiscal "), (F.col("event_id") % 3 + 2020).cast("string"), F.lit(", fiscal years "), (F.col("user_id") % 4 + 2020).cast("string"), F.lit(" and FY2021"))
    named = P.table(spark, d, "events").select("user_id", F.explode(facts.year_mentions(said)).alias("year"))
    return facts.dominant_year(named, "user_id")


@query(f"with {_FLAGS}, {_SENT_A}, b as (select doc_id, s_start as lo, s_end as hi from sent where sent_idx = 0) select f.doc_id, type, term, f_start + 10 as f_start from flags f left join b using (doc_id) where lo is null or f_start < lo or f_start >= hi")
def flags_outside_tables(spark, d):
    """FLT13, ARR2: flags lifted by an offset, without those that begin in a table range (the first sentence of each document)."""
    docs = P.table(spark, d, "documents")
    first = F.get(T.sentence_spans(F.col("text")), F.lit(0))
    ranged = docs.withColumn("at", F.lit(10)).withColumn("tables", F.when(first.isNotNull(), F.array(F.struct((first["start"] + 10).alias("s"), (first["end"] + 10).alias("e")))))
    return flags.flag(ranged, flags.lexicon(spark), "doc_id", offset="at", tables="tables").select("doc_id", "type", "term", F.col("start").alias("f_start"))


@query(r"select doc_id, lower(term) as term, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '(?i)\bund\b')) as term from documents) group by 1, 2")
def own_terms(spark, d):
    """SET4, MDL5: a user's own term on top of the lexicon."""
    terms = flags.lexicon(spark, [("own", "und", "a word of the user's", False)])
    found = flags.flag(P.table(spark, d, "documents"), terms, "doc_id").where("type = 'own'")
    return found.groupBy("doc_id", F.lower("term").alias("term")).agg(F.count("*").alias("n"))


_FORM_HIT = {x: _hit(x) + (rf" or (conv_id % 2 = 0 and regexp_matches(sentence, '(?i)\b(?:{FORM_KEYWORDS['S-1'][x]})\b'))" if x in FORM_KEYWORDS["S-1"] else "") for x in KEYWORDS}


@query(f"with st as (select * replace (sentence || ' use of proceeds' as sentence) from ({P.STATEMENTS_SQL})) select conv_id, sent_idx::int as sent_idx, array_to_string(list_filter([" + ", ".join(f"case when {_FORM_HIT[x]} then {q(x)} end" for x in KEYWORDS) + "], lambda x: x is not null), ',') as dims from st")
def form_keywords(spark, d):
    """FLT19: a form's own words on top of those of the dimensions, over whole turns."""
    st = P.statements(spark, d).withColumn("form", F.when(F.col("conv_id") % 2 == 0, "S-1").otherwise("10-K")).withColumn("sentence", F.concat("sentence", F.lit(" use of proceeds")))
    return st.select("conv_id", "sent_idx", F.array_join(relevance.dimensions(F.col("sentence"), F.col("form")), ",").alias("dims"))


@query("""with v as (select o_orderkey, o_orderkey % 5 as u, case o_orderkey % 3 when 0 then (o_orderkey % 900) * 1e6 when 1 then (o_orderkey % 900) * 1e9 else -(o_orderkey % 900) * 1e3 end as x from orders),
    c as (select *, case when abs(x) >= 1e12 then printf('%.2fT', abs(x) / 1e12) when abs(x) >= 1e9 then printf('%.2fB', abs(x) / 1e9) when abs(x) >= 1e6 then printf('%.1fM', abs(x) / 1e6) when abs(x) >= 1e3 then printf('%.1fK', abs(x) / 1e3) end as body from v)
    select o_orderkey, case u when 0 then case when x < 0 then '-' else '' end || '$' || coalesce(body, printf('%.2f', abs(x))) when 1 then case when x < 0 then '-' else '' end || '€' || coalesce(body, printf('%.2f', abs(x))) when 2 then coalesce(body, printf('%.0f', abs(x))) when 3 then printf('CHF %.2f', x) else printf('%.1f%%', x * 100) end as shown, case when x > 0 then '+' else '' end || printf('%.1f%%', x * 100) as change from c""")
def shown_values(spark, d):
    """NUM5: amounts, shares, per-share values and percentages as they are shown."""
    k = F.col("o_orderkey")
    x = F.when(k % 3 == 0, (k % 900) * 1e6).when(k % 3 == 1, (k % 900) * 1e9).otherwise(-(k % 900) * 1e3)
    unit = F.when(k % 5 < 2, "USD").when(k % 5 == 2, "shares").when(k % 5 == 3, "USD/shares").otherwise("pure")
    currency = F.when(k % 5 == 1, "EUR").when(k % 5 == 3, "CHF")
    return P.table(spark, d, "orders").select("o_orderkey", N.value_text(x, unit, currency).alias("shown"), N.signed_percent(x).alias("change"))
