"""Pages to documents: the composite of classifying, normalising, detecting and segmenting."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import iso_date, once
from quire.operators import classify, segment

# Capabilities of a document, and the sections that are summarised first.
CAPABILITIES = ["summary", "analyst", "sentiment", "changes"]
SUMMARISED_FIRST = ["item_7_mdna", "item_7a", "item_1a_risk", "item_1_business", "part_ii_item_7", "part_i_item_1a", "part_i_item_1"]
#: Categories of pages that are cut at their headings instead of at items.
READABLE = ("ir_or_financial", "sec_data_report", "sec_search")
ORGANISATION = re.compile(r"Organization|Corporation|LocalBusiness", re.I)


def content_hash(text: Column) -> Column:
    """Identity of a text for stores and joins."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


#: Where linked data names its organisation, and how many lists and objects deep it is looked for (fixed values).
OWNERS, DEPTH = ("@graph", "publisher", "author", "organization", "mainEntity"), 5


def linked_nodes(data):
    """Objects of parsed linked data in the order in which they are written, each before those it names as owners."""
    todo = [(data, DEPTH)]
    while todo:
        node, left = todo.pop()
        if not left:
            continue
        if isinstance(node, dict):
            yield node
            inner = [node[k] for k in OWNERS if k in node]
        else:
            inner = node if isinstance(node, list) else []
        todo += [(x, left - 1) for x in reversed(inner)]


def organisation(data) -> str | None:
    """The name of the first organisation in parsed linked data."""
    for node in linked_nodes(data):
        kinds = node.get("@type")
        kinds = kinds if isinstance(kinds, list) else [kinds]
        name = node.get("name")
        if isinstance(name, str) and name.strip() and any(ORGANISATION.search(str(k)) for k in kinds):
            return name.strip()
    return None


def linked_name(html: Column) -> Column:
    """The organisation of a page's linked data, or null; only pages with such data reach Python."""
    import pandas as pd
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def run(blocks):
        out = []
        for b in blocks:
            name = None
            for raw in b if b is not None else []:
                try:
                    name = name or organisation(json.loads(raw))
                except ValueError:
                    continue
            out.append(name)
        return pd.Series(out, dtype="object")

    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return run(blocks)


def dei_fact(html: Column, name: str) -> Column:
    """The text of the first inline fact ``dei:<name>``, or null."""
    found = F.regexp_extract(html, rf"(?is)<[^>]+name=[\"']dei:{name}[\"'][^>]*>(.*?)</", 1)
    return F.nullif(F.trim(F.regexp_replace(found, "<[^>]*>", "")), F.lit(""))


def company_name(html: Column) -> Column:
    """Declared name, linked data, site name, a heading of 2 to 120 characters, else the title before a year or form."""
    site = F.regexp_extract(html, r"(?is)<meta[^>]+(?:property|name)=[\"']og:site_name[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    h1 = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""), r"\s+", " "))
    h1 = once(h1, lambda x: F.when(F.length(x).between(2, 120), x))
    title = F.trim(F.regexp_extract(html, r"(?is)<title\b[^>]*>\s*([^|–—\n<]{3,80}?)\s*(?:\d{4}|10-K|10-Q|8-K|S-1|DEF|proxy)", 1))
    return F.coalesce(dei_fact(html, "EntityRegistrantName"), linked_name(html), F.nullif(F.trim(site), F.lit("")), h1, F.nullif(title, F.lit("")))


def ingest(pages: DataFrame, *keys: str, url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(documents, sections) of pages.

    documents: keys, url, category, bucket, form, confidence, company, period, accession, text, tables, text_hash,
    segmentation, n_sections.  sections: keys, section_id, section_order, start, end, text.  Pages that are not
    filings are cut at their headings; a filing's sections come from its item headers or titles, as its form has them.
    """
    from quire.session import written
    from quire.sources.html import normalised

    # the page goes through with its text, so that nothing is joined back to it
    found = normalised(pages.select(*keys, url, html, F.col(html).alias("_source")), *keys, url, html, html="_source")
    form = classify.detect_form(dei_fact(F.col(html), "DocumentType"), F.col(url), F.col("text"))
    docs = found.select(
        *keys, F.col(url).alias("url"), classify.page_category(F.col(url), F.col(html)).alias("category"), form.alias("f"), company_name(F.col(html)).alias("company"),
        once(dei_fact(F.col(html), "DocumentPeriodEndDate"), iso_date).alias("period"), classify.accession(F.col(url))["accession"].alias("accession"), "text", "tables", content_hash(F.col("text")).alias("text_hash"), F.col(html).alias("_source"),
    )
    docs = docs.withColumn("bucket", classify.host_bucket(F.col("category"))).withColumn("form", F.col("f.form")).withColumn("confidence", F.col("f.confidence")).drop("f")
    docs = written(docs, "pages")  # a page is gone through once, whatever is asked of it
    # a page that is no filing is cut at its headings
    readable = F.col("category").isin(*READABLE)
    own = ["section_id", "section_order", "start", "end", "text"]
    headed = segment.heading_texts(docs.where(readable), *keys, "form", html="_source").select(*keys, "form", *own)
    sections = segment.sections_by_form(docs.where(~readable), *keys).unionByName(headed)
    docs = docs.drop("_source")
    seg = segment.confidence(sections, *keys, count="n_sections")
    out = docs.join(seg, list(keys), "left").withColumn("n_sections", F.coalesce("n_sections", F.lit(0)))
    return out.withColumn("segmentation", F.coalesce("segmentation", F.lit("low"))), sections


def ingest_texts(documents: DataFrame, *keys: str, url: str | None = None, parse=None) -> tuple[DataFrame, DataFrame]:
    """(documents, sections) of files without markup: rows (keys, length, content, and the address in ``url`` if there is one).

    documents: keys, text, pages, error, form, confidence, company, period, ticker, text_hash, segmentation, n_sections;
    sections: keys, form, section_id, section_order, start, end, text.  A file that can't be read keeps its row, with its
    error, and has no sections.
    """
    from quire.session import written
    from quire.sources.files import cover
    from quire.sources.pages import paged_texts, plain_pages

    own = [*keys, *([url] if url else [])]
    read = paged_texts(documents, *own, parse=parse or plain_pages)
    form = classify.detect_form(F.lit(None).cast("string"), F.col(url) if url else F.lit(""), F.coalesce("text", F.lit("")))
    docs = read.withColumn("_f", form).withColumn("_c", cover(F.col("text")))
    docs = docs.select(*own, "text", "pages", "error", "_f.form", "_f.confidence", "_c.company", "_c.period", "_c.ticker", content_hash(F.col("text")).alias("text_hash"))
    docs = written(docs, "texts")  # a file is parsed, and its text looked through, once
    sections = segment.sections_by_form(docs.where("error is null"), *keys)
    out = docs.join(segment.confidence(sections, *keys, count="n_sections"), list(keys), "left").withColumn("n_sections", F.coalesce("n_sections", F.lit(0)))
    return out.withColumn("segmentation", F.coalesce("segmentation", F.lit("low"))), sections


def capabilities(category: Column, form: Column, low: Column, n_sections: Column) -> Column:
    """What applies to a document: reports, indexes, exhibits and generic pages keep the summary only; general financial
    pages and PDFs have no prior version to compare with."""
    general = classify.general_financial(category, low)
    bare = (form == "DATA_REPORT") | (category == "edgar_index") | classify.exhibit(category, form, n_sections) | (low & ~general)
    names = [F.lit(c) for c in CAPABILITIES]
    return F.when(bare, F.array(names[0])).when(general | (category == "pdf"), F.array(*names[:3])).otherwise(F.array(*names))


def first_to_summarise(sections: DataFrame, *keys: str, most: int = 3) -> DataFrame:
    """(keys, section_id, rank): of each wanted prefix the first section that has it, ``most`` of them."""
    from pyspark.sql import Window

    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(SUMMARISED_FIRST)])
    hits = sections.select(*keys, "section_id", "section_order", F.explode(F.filter(wanted, lambda w: F.startswith("section_id", w["p"]))).alias("w"))
    first = F.row_number().over(Window.partitionBy(*keys, "w.i").orderBy("section_order", "section_id"))
    ranked = hits.withColumn("_n", first).where("_n = 1").withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("w.i")))
    return ranked.where(F.col("rank") <= most).select(*keys, "section_id", "rank")


def remaining(label: Column, ms: Column) -> Column:
    """What is being scored, and about how long it will take."""
    secs = F.ceil(ms / 1000)
    base = F.concat(F.lit("Scoring "), label, F.lit("…"))
    return (
        F.when(ms.isNull() | (ms <= 0), base).when(secs <= 3, F.concat(base, F.lit(" almost done")))
        .when(secs < 90, F.concat(base, F.lit(" about "), secs.cast("string"), F.lit("s left"))).otherwise(F.concat(base, F.lit(" about "), F.floor(secs / 60 + 0.5).cast("string"), F.lit(" min left")))
    )


def tables_of(sections: DataFrame, tables: Column) -> DataFrame:
    """sections with ``tables``: the ranges of their document that overlap them."""
    return sections.withColumn("tables", F.filter(tables, lambda t: (t["s"] < F.col("end")) & (t["e"] > F.col("start"))))


def at_position(points: DataFrame, ranges: DataFrame, *keys: str, position: str = "position") -> DataFrame:
    """points with the first range (by start) of their document that covers them; a point in none keeps nulls.

    The ranges of one document are searched as an array, so a point never meets those of another.
    """
    cols = [c for c in ranges.columns if c not in keys]
    held = ranges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", *[c for c in cols if c not in ("start", "end")]))).alias("_r"))
    hit = F.get(F.filter("_r", lambda r: (r["start"] <= F.col(position)) & (F.col(position) < r["end"])), F.lit(0))
    return points.join(held, list(keys), "left").withColumn("_h", hit).select(*points.columns, *[F.col(f"_h.{c}").alias(c) for c in cols])


def labelled(rows: DataFrame, labels: DataFrame, *keys: str) -> DataFrame:
    """rows with the label of their section, else its id with blanks."""
    return rows.join(labels.select(*keys, "section_id", "label"), [*keys, "section_id"], "left").withColumn("label", F.coalesce("label", F.regexp_replace("section_id", "_", " ")))
