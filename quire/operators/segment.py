"""Segmentation of filings into sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import once
from quire.plans.registry import ITEM_FORMS, TITLES, items

#: A header is in a table of contents if so many item numbers start within so many characters of it.
CLUSTER_REACH, CLUSTER_KEYS = 2000, 3
# An item header, and wording that points elsewhere.
ITEM_HEADER = r"(?i)(^|\n)(\s{0,4})(ITEM\s+(\d+(?:[A-Z]|\.\d{2}|\.[A-Z])?)\s*[.:\-–—]?\s+[^\n]{2,100})"
BY_REFERENCE = r"(?i)incorporat\w*\s+(?:herein\s+)?by reference"
POINTER = r"(?i)\b(?:appears|set forth|included|contained)\b[^.]{0,80}\b(?:on pages?|under the heading|as exhibit|in exhibit|in (?:the|its) annual report)"
SHORT_MDNA, LONG_POINTER = 50, 15_000


def registry(spark) -> DataFrame:
    """(form, item_key, section_id, section_order) of the item forms; 116 rows."""
    return spark.createDataFrame([(f, *row) for f in ITEM_FORMS for row in items(f)], "form string, item_key string, section_id string, section_order int")


def _headers(text: Column) -> Column:
    """array<struct<item_key, head_start, head_end>> of the item headers, from one pass with marks around each."""
    marked = F.regexp_replace(F.translate(text, "\u0001\u0002", "  "), ITEM_HEADER, "$1$2\u0001$3\u0002")
    none = F.array().cast("array<struct<head:string,start:int>>")

    def step(acc, piece):
        head, has = F.substring_index(piece, "\u0002", 1), F.contains(piece, F.lit("\u0002"))
        out = F.when(has, F.concat(acc["out"], F.array(F.struct(head.alias("head"), acc["at"].alias("start"))))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(piece) - has.cast("int")).alias("at"), out.alias("out"))

    hits = F.aggregate(F.split(marked, "\u0001"), F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    key = lambda h: F.lower(F.regexp_extract(h["head"], r"(?i)^ITEM\s+(\d+(?:[A-Z]|\.\d{2}|\.[A-Z])?)", 1))
    return F.transform(hits, lambda h: F.struct(key(h).alias("item_key"), h["start"].alias("head_start"), (h["start"] + F.length(h["head"])).alias("head_end")))


def item_hits(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, item_key, head_start, head_end): item headers."""
    return docs.select(*keys, F.explode(_headers(F.col(text))).alias("h")).select(*keys, "h.*")


def mark_contents(hits: DataFrame, *keys: str) -> DataFrame:
    """hits with ``in_contents``: headers packed as in a table of contents."""
    near = Window.partitionBy(*keys).orderBy("head_start").rangeBetween(-CLUSTER_REACH, CLUSTER_REACH)
    return hits.withColumn("in_contents", F.size(F.collect_set("item_key").over(near)) >= CLUSTER_KEYS)


def choose_headers(hits: DataFrame, *keys: str) -> DataFrame:
    """Of each item the first header outside a table of contents, else the last of all."""
    one = F.struct("head_start", "head_end")
    best = F.coalesce(F.min(F.when(~F.col("in_contents"), one)), F.max(one))
    return mark_contents(hits, *keys).groupBy(*keys, "item_key").agg(best.alias("h")).select(*keys, "item_key", "h.head_start", "h.head_end")


#: Headers that start within CLUSTER_REACH of one on either side, at most: the shortest has nine characters and a line end.
NEAR_HEADERS = CLUSTER_REACH // 10 + 1


def _chosen(headers: Column) -> Column:
    """What ``choose_headers`` keeps of a document's headers, in the order of the text; headers are looked at with their neighbours only."""

    def marked(hits: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            about = F.slice(hits, F.greatest(i + 1 - NEAR_HEADERS, F.lit(1)), F.lit(2 * NEAR_HEADERS + 1))
            near = F.filter(about, lambda o: F.abs(o["head_start"] - h["head_start"]) <= CLUSTER_REACH)
            within = F.size(F.array_distinct(F.transform(near, lambda o: o["item_key"]))) >= CLUSTER_KEYS
            return F.struct(h["item_key"].alias("item_key"), within.alias("within"), F.when(within, -h["head_start"]).otherwise(h["head_start"]).alias("rank"), h["head_start"].alias("head_start"), h["head_end"].alias("head_end"))

        return F.array_sort(F.transform(hits, one))

    def firsts(ranked: Column) -> Column:
        kept = F.filter(ranked, lambda h, i: (i == 0) | (F.get(ranked, i - 1)["item_key"] != h["item_key"]))
        return F.array_sort(F.transform(kept, lambda h: F.struct(h["head_start"].alias("head_start"), h["head_end"].alias("head_end"), h["item_key"].alias("item_key"))))

    return once(once(headers, marked), firsts)


_CUT = "array<struct<item_key:string,section_id:string,section_order:int,start:int,end:int,text:string>>"


def _bare(text: Column) -> Column:
    """The whole text as the one section, nothing of an empty text."""
    one = F.struct(F.lit(None).cast("string").alias("item_key"), F.lit("document_body").alias("section_id"), F.lit(1).alias("section_order"), F.lit(0).alias("start"), F.length(text).alias("end"), F.trim(text).alias("text"))
    return F.when(F.length(text) > 0, F.array(one)).otherwise(F.array()).cast(_CUT)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _item_cuts(text: Column) -> Column:
    """Sections of a text at its item headers; those of known and unknown items have no section_id yet."""

    def cut(kept: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            end = F.coalesce(F.get(kept, i + 1)["head_start"], F.length(text))
            return F.struct(h["item_key"].alias("item_key"), h["head_end"].alias("head_end"), end.alias("end"))

        def filled(h: Column) -> Column:
            def of(body: Column) -> Column:
                lead = F.length(body) - F.length(F.regexp_replace(body, r"^\s+", ""))
                return F.struct(h["item_key"].alias("item_key"), F.lit(None).cast("string").alias("section_id"), F.lit(None).cast("int").alias("section_order"), (h["head_end"] + lead).alias("start"), h["end"].alias("end"), _stripped(body).alias("text"))

            return once(F.substring(text, h["head_end"] + 1, h["end"] - h["head_end"]), of)

        bounds = F.filter(F.transform(kept, one), lambda h: h["head_end"] < h["end"])
        return F.when(F.size(kept) > 0, F.transform(bounds, filled).cast(_CUT)).otherwise(_bare(text))

    return F.coalesce(once(_chosen(_headers(text)), cut), _bare(text))


def _named_items(cuts: DataFrame, *keys: str) -> DataFrame:
    """(keys, form, section_id, section_order, start, end, text) of rows (keys, form, cuts); what is no item of its form goes."""
    names = registry(cuts.sparkSession).withColumnsRenamed({"section_id": "_id", "section_order": "_order"})
    rows = cuts.select(*keys, "form", F.explode("cuts").alias("c")).select(*keys, "form", "c.*")
    rows = rows.join(F.broadcast(names), ["form", "item_key"], "left").where("item_key is null or _id is not null")
    return rows.select(*keys, "form", F.coalesce("section_id", "_id").alias("section_id"), F.coalesce("section_order", "_order").alias("section_order"), "start", "end", "text")


def item_sections(docs: DataFrame, *keys: str, form: str = "form", text: str = "text") -> DataFrame:
    """(keys, form, section_id, section_order, start, end, text): what runs from each header to the next kept one.

    Unknown item numbers end a section but make none.  Documents without any header become one section.  A text is gone
    through where it stands: rows are neither joined nor read again.
    """
    return _named_items(docs.select(*keys, F.col(form).alias("form"), _item_cuts(F.col(text)).alias("cuts")), *keys)


def _title_cuts(text: Column, form: str, fill: bool = True) -> Column:
    """Sections of a text at the last match of each title of a form, their texts left out without ``fill``."""
    body = F.translate(text, "\u0001\u0002", "  ")
    none = F.struct(F.lit(None).cast("int").alias("head_start"), F.lit(None).cast("int").alias("head_end"))

    def last_match(pattern: str) -> Column:
        # (of several alternatives only the first may be indented, and only the last takes the rest of its line)
        marked = F.regexp_replace(body, rf"(?i)((?:^|\n)(?:[ \t]{{0,4}}{pattern}[^\n]{{0,120}}))", "\u0001$1\u0002")

        def placed(m: Column) -> Column:
            tail = F.substring_index(m, "\u0001", -1)  # the last match, its end marked, and what follows
            start = F.length(text) - F.length(tail) + 1
            return F.when(F.contains(m, F.lit("\u0001")), F.struct(start.alias("head_start"), (start + F.instr(tail, "\u0002") - 1).alias("head_end"))).otherwise(none)

        return once(marked, placed)

    def named(section_id: str, order: int):
        return lambda x: F.struct(x["head_start"].alias("head_start"), F.lit(order).alias("section_order"), x["head_end"].alias("head_end"), F.lit(section_id).alias("section_id"))

    last = [F.transform(F.array(last_match(pattern)), named(section_id, 10 * (n + 1))) for n, (section_id, pattern) in enumerate(TITLES[form])]

    def cut(hits: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            end = F.coalesce(F.get(hits, i + 1)["head_start"], F.length(text))
            part = _stripped(F.substring(text, h["head_end"] + 1, end - h["head_end"])) if fill else F.lit(None).cast("string")
            return F.struct(F.lit(None).cast("string").alias("item_key"), h["section_id"].alias("section_id"), h["section_order"].alias("section_order"), h["head_end"].alias("start"), end.alias("end"), part.alias("text"))

        return F.when(F.size(hits) > 1, F.filter(F.transform(hits, one), lambda c: c["start"] < c["end"]).cast(_CUT)).otherwise(_bare(text))

    return once(F.array_sort(F.filter(F.concat(*last), lambda x: x["head_start"].isNotNull())), cut)


def title_sections(docs: DataFrame, form: str, *keys: str, text: str = "text") -> DataFrame:
    """(keys, section_id, section_order, start, end): sections of a form without item numbers, at the *last* match of each title.

    With fewer than two titles a document is one section.
    """
    cuts = docs.select(*keys, F.explode(_title_cuts(F.col(text), form, fill=False)).alias("c"))
    return cuts.select(*keys, "c.section_id", "c.section_order", "c.start", "c.end")


def sections_by_form(docs: DataFrame, *keys: str, form: str = "form", text: str = "text") -> DataFrame:
    """(keys, form, section_id, section_order, start, end, text): each document cut the way its form asks for, in one plan.

    Forms with items are cut at item headers, forms with titles at these, any other document is one section; an empty
    text has none.  Every row takes one of the ways, and documents are gone through once.
    """
    f, t = F.coalesce(F.col(form), F.lit("UNKNOWN")), F.col(text)
    way = F.when(f.isin(*ITEM_FORMS), _item_cuts(t))
    for name in (x for x in TITLES if x not in ITEM_FORMS):
        way = way.when(f == name, _title_cuts(t, name))
    return _named_items(docs.select(*keys, f.alias("form"), way.otherwise(_bare(t)).alias("cuts")), *keys)


def is_by_reference(section_id: Column, text: Column) -> Column:
    """Whether a discussion section only points elsewhere."""
    return section_id.rlike("mdna|operating_review") & (F.length(text) < LONG_POINTER) & (text.rlike(BY_REFERENCE) | text.rlike(POINTER))


def confidence(sections: DataFrame, *keys: str, count: str | None = None) -> DataFrame:
    """(keys, segmentation), with the number of sections as ``count`` if asked for: low if a document fell back to one section or a main section is (nearly) empty."""
    size = F.length(F.trim("text"))
    bad = (F.col("section_id").rlike("mdna|operating_review") & (size < SHORT_MDNA)) | (F.col("section_id").rlike("risk_factors") & (size == 0))
    one = (F.count("*") == 1) & F.bool_or(F.col("section_id") == "document_body") & F.bool_or(F.col("form").isin(*ITEM_FORMS))
    more = [F.count("*").alias(count)] if count else []
    return sections.groupBy(*keys).agg(F.when(one | F.bool_or(bad), "low").otherwise("high").alias("segmentation"), *more)


def heading_sections(pages: DataFrame, *keys: str, html: str = "html") -> DataFrame:
    """(keys, section_id, label, section_order): headings h1 to h3 of 1 to 160 characters as sections."""
    from quire.functions.text import slug

    heads = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<h[123]\b[^>]*>(.*?)</h[123]>"), F.lit(1))
    label = F.trim(F.regexp_replace(F.regexp_replace(F.col("raw"), "<[^>]*>", ""), r"\s+", " "))
    rows = pages.select(*keys, F.posexplode(F.filter(F.transform(heads, lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", ""), r"\s+", " "))), lambda x: F.length(x).between(1, 160))).alias("n", "raw"))
    base = slug(label)
    return rows.select(*keys, F.concat(F.lit("report_"), (F.col("n") + 1).cast("string"), F.lit("_"), F.when(base == "", "section").otherwise(base)).alias("section_id"), label.alias("label"), (F.col("n") + 1).alias("section_order"))


#: Characters that make what precedes the first heading a section (fixed value).
PREAMBLE = 40


def heading_texts(docs: DataFrame, *keys: str, html: str = "html", text: str = "text") -> DataFrame:
    """(keys, section_id, label, section_order, start, end, text): the text below each heading, up to the next one.

    Headings are looked for in the normalised text one after the other, each behind the one before; what precedes the
    first is a preamble if it has ``PREAMBLE`` characters.  Sections without text are left out, and a document without
    headings is one section.
    """
    from quire.functions.text import slug

    heads = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<h[123]\b[^>]*>(.*?)</h[123]>"), F.lit(1))
    labels = F.filter(F.transform(heads, lambda h: F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", ""), r"\s+", " "))), lambda x: F.length(x).between(1, 160))
    held = "array<struct<label:string,head:int,start:int>>"
    # acc.at: behind the last heading found; a label is looked for as a line of its own, and passed over if there is none
    place = "locate(concat('\\n', x, '\\n'), concat('\\n', _t, '\\n'), acc.at + 1)"
    fold = f"""aggregate(_l, struct(0 as at, cast(array() as {held}) as out), (acc, x) -> if({place} > 0,
        struct({place} - 1 + length(x) as at, concat(acc.out, array(named_struct('label', x, 'head', {place} - 1, 'start', {place} - 1 + length(x)))) as out), acc), acc -> acc.out)"""
    placed = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_t"), labels.alias("_l")).withColumn("_h", F.expr(fold))
    opening = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(0).alias("head"), F.lit(0).alias("start")))
    rows = placed.withColumn("_all", F.concat(opening.cast(held), "_h"))
    each = rows.select(*keys, "_t", "_h", "_all", F.posexplode("_all").alias("section_order", "h"))
    end = F.coalesce(F.get("_all", F.col("section_order") + 1)["head"], F.length("_t"))
    cut = each.select(*keys, "_h", "section_order", "h.label", F.col("h.start").alias("start"), end.alias("end"), F.regexp_replace(F.substring(F.col("_t"), F.col("h.start") + 1, end - F.col("h.start")), r"^\s+|\s+$", "").alias("text"))
    opens, alone = F.col("section_order") == 0, F.size("_h") == 0
    kept = cut.where((F.col("text") != "") & (~opens | alone | (F.length("text") >= PREAMBLE)))
    base = slug(F.col("label"))
    name = F.when(alone, "document_body").when(opens, "report_0_preamble").otherwise(F.concat(F.lit("report_"), F.col("section_order").cast("string"), F.lit("_"), F.when(base == "", "section").otherwise(base)))
    return kept.select(*keys, name.alias("section_id"), F.coalesce("label", F.lit("Preamble")).alias("label"), "section_order", "start", "end", "text")
