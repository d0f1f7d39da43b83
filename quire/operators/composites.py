"""Operators made of several: prior resolution, semantic excerpts, staged analysis, section summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import iso_date
from quire.operators import cache, classify, evidence, insights, models, priors, relevance, sentences, vectors
from quire.plans.registry import KEYWORDS
from quire.session import written

# ── the prior of a filing ──


def continuation_url(name: Column) -> Column:
    return F.concat(F.lit("https://data.sec.gov/submissions/"), name)


def _picked(requests: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, p): the prior of each request among the rows of its keys, as a struct.

    The latest of a strictly earlier date; where none is earlier, the one after the first of the request's own date;
    without a usable period, the second latest.  Greater accession numbers come first among equal dates.
    """
    day = iso_date(F.col("report_date"))
    one = F.struct(day.alias("day"), F.col("accession"), F.col("document"), F.col("filing_date"), F.col("report_date"), F.col("form"))
    met = requests.join(rows.select(*keys, one.alias("r")), list(keys)).where(priors.usable(F.col("r.form"), F.col("r.accession"), F.col("r.document"), F.col("wanted_form")))
    of_period = F.slice(F.reverse(F.array_sort(F.collect_list(F.when(F.col("r.day") == F.col("target"), F.col("r"))))), 2, 1)
    latest = F.slice(F.reverse(F.array_sort(F.collect_list("r"))), 2, 1)  # the filings of one company and form
    grouped = met.groupBy(*keys, "target").agg(F.max(F.when(F.col("r.day") < F.col("target"), F.col("r"))).alias("earlier"), F.get(of_period, F.lit(0)).alias("same"), F.get(latest, F.lit(0)).alias("second"))
    return grouped.select(*keys, F.when(F.col("target").isNull(), F.col("second")).otherwise(F.coalesce("earlier", "same")).alias("p")).where("p is not null")


def resolve_priors(requests: DataFrame, recent: DataFrame, older: DataFrame, *keys: str, cik: str = "cik") -> DataFrame:
    """(keys, accession, document, form, report_date, filing_date, url): the prior that a filing is compared with.

    requests: keys, wanted_form, period (any form of date; null or unreadable: unknown), one row for each of keys.
    recent and older: rows as of ``priors.submission_rows``; older ones, of the continuation, only count for requests that
    find nothing among the recent.  Amendments have another form and never count.
    """
    asked = requests.select(*keys, "wanted_form", iso_date(F.col("period")).alias("target"))
    first = _picked(asked, recent, *keys)
    open_ = asked.join(first.select(*keys), list(keys), "left_anti")
    every = priors.with_continuation(recent, older, first, *keys)
    found = first.unionByName(_picked(open_, every, *keys))
    return found.select(*keys, *[F.col(f"p.{c}").alias(c) for c in ("accession", "document", "form", "report_date", "filing_date")], classify.archive_url(F.col(cik), F.col("p.accession"), F.col("p.document")).alias("url"))


# ── excerpts by meaning ──

#: What each dimension looks for, in words of our own; an encoder turns it into a vector.
LOOKED_FOR = {
    "revenue": "how sales develop: growth, volumes, prices, orders", "margins": "what is earned on sales: margins, costs, profit", "cashflow": "cash from the business, investment, what cash is at hand",
    "balancesheet": "what is owed: debt, covenants, liabilities, impairments", "shares": "what holders get: dividends, buybacks, dilution", "risk": "what may go wrong: uncertainty, lawsuits, rules, rivals",
    "management": "what management expects, plans and says of demand",
}


def semantic_excerpts(rows: DataFrame, dims: list[str], budget: int, *keys: str, encoder=vectors.hashed_vectors, form: str | None = None) -> DataFrame:
    """(keys, excerpt, used): like ``relevance.pack``, with sentences ranked half by words and half by meaning.

    The pool of a document are its ``relevance.CANDIDATES`` best sentences over all dimensions, encoded once; those with a
    word of ``dims`` are ranked by the blend and packed.  Without an encoder, or where it fails for a document, the order
    of the keywords stands.
    """
    by_words = relevance.scored(rows, dims, *keys, form=form)
    try:
        queries = None if encoder is None else [list(map(float, v)) for v in encoder([LOOKED_FOR[d] for d in dims])]
    except Exception:  # a model that fails leaves the excerpt to the keywords
        queries = None
    if queries is None:
        return relevance.pack(by_words, budget, *keys)
    pool = relevance.top(relevance.scored(rows, list(KEYWORDS), *keys, form=form), relevance.CANDIDATES, *keys)
    coded = vectors.encode(pool, encoder=lenient(encoder))
    near = sum((vectors.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in q])) for q in queries), F.lit(0.0)) / len(queries)
    fine = F.min(F.col("embedding").isNotNull()).over(Window.partitionBy(*keys))
    judged = coded.withColumn("fine", fine).withColumn("own", relevance.keyword_score(F.col("sentence"), F.col("section_id"), dims, form)).withColumn("score", relevance.blended(F.col("score"), near))
    ranked = judged.where("fine and own > 0")
    failed = judged.where(~F.col("fine")).select(*keys).distinct()
    return relevance.pack(ranked, budget, *keys).unionByName(relevance.pack(by_words.join(failed, list(keys), "left_semi"), budget, *keys))


def lenient(encoder):
    """An encoder that gives nulls where the model raises or returns another number of vectors."""

    def run(texts: list[str]):
        try:
            out = list(encoder(texts))
        except Exception:
            out = []
        return out if len(out) == len(texts) else [None] * len(texts)

    return run


# ── staged analysis ──

#: Stages of the analysis after the snapshot: their dimensions, the category of their cards, and how many.
STAGES = [("takeaways", list(KEYWORDS), "Operations", 7), ("revenue", ["revenue"], "Revenue", 3), ("margins", ["margins"], "Margins", 3), ("cashflow", ["cashflow", "balancesheet"], "Cash Flow", 4), ("shares", ["shares"], "Shares", 3), ("risks", ["risk"], "Risk", 5), ("narrative", ["management"], "Management Commentary", 4)]
CARD = "struct<title:string,summary:string,why:string,meaning:string,label:string,severity:string,confidence:string,evidence:string>"
SEVERITIES, CONFIDENCES = ["Low", "Medium", "High"], ["Low", "Medium", "High"]
BUDGET = 2_800


def model_cards(answers: DataFrame, *keys: str) -> DataFrame:
    """(keys, stage, pos, the fields of a card): what models answered, coerced; answers that are no JSON give none."""
    body = models.json_body(F.col("answer"))
    items = F.when(F.startswith(body, F.lit("{")), F.from_json(body, f"struct<items:array<{CARD}>>")["items"]).otherwise(F.from_json(body, f"array<{CARD}>"))
    rows = answers.where("answer is not null").select(*keys, "stage", "category", "most", F.posexplode(items).alias("pos", "c")).where(F.col("pos") < F.col("most"))
    text = lambda c: F.coalesce(F.trim(F.col(f"c.{c}")), F.lit(""))
    return rows.select(
        *keys, "stage", (F.col("pos") + 1).alias("pos"), "category", *[text(c).alias(c) for c in ("title", "summary", "why", "meaning")], insights.coerce(F.col("c.label"), insights.LABELS, "Neutral").alias("label"),
        insights.coerce(F.col("c.severity"), SEVERITIES, "Medium").alias("severity"), insights.coerce(F.col("c.confidence"), CONFIDENCES, "Medium").alias("confidence"), F.nullif(text("evidence"), F.lit("")).alias("evidence"),
    )


def staged_analysis(rows: DataFrame, floor: DataFrame, *keys: str, model=None) -> tuple[DataFrame, DataFrame]:
    """The analysis by a model above a deterministic floor: (cards, documents).

    rows: sentences as of ``relevance.scored``.  floor: cards as of ``analysis.dimension_cards`` (keys, dim, pos, category,
    title, summary, severity).  The model is asked for a snapshot first; where it has no answer the other stages are
    not tried, the floor stands and the document is ``degraded``.  A stage's answer replaces the floor of its
    dimensions if a card of it passes the guards.
    """
    # each dimension is looked for once in a sentence, below the window, and all stages are scored from that
    reading = Window.partitionBy(*keys).orderBy(relevance.priority(F.col("section_id")), "section_order", "sent_idx")
    stages = [("snapshot", list(KEYWORDS), "", 0), *STAGES]
    hits, more = relevance.hits(F.col("sentence"), F.col("section_id"), list(KEYWORDS))
    # stages of the same dimensions have the same excerpt, which is packed once
    alike = {}
    for n, dims, c, m in stages:
        alike.setdefault(tuple(dims), []).append(F.struct(F.lit(n).alias("stage"), F.lit(c).alias("category"), F.lit(m).alias("most")))
    scores = F.array(*[F.struct(F.lit(k).alias("dims"), relevance.score_of("_hits", "_more", dims).alias("score")) for k, dims in enumerate(alike)])
    ordered = rows.select(*keys, "section_id", "section_order", "sent_idx", "sentence", hits.alias("_hits"), more.alias("_more")).withColumn("reading", F.row_number().over(reading))
    scored = ordered.select(*keys, "sentence", "reading", F.explode(F.filter(scores, lambda x: x["score"] > 0)).alias("s")).select(*keys, "sentence", "reading", "s.*")
    packed = relevance.pack(scored, BUDGET, *keys, "dims")
    named = F.element_at(F.array(*[F.array(*of) for of in alike.values()]), F.col("dims") + 1)
    asked = packed.select(*keys, "excerpt", F.explode(named).alias("of")).select(*keys, "of.*", "excerpt").withColumn("prompt", F.concat("stage", F.lit("\n"), "excerpt"))
    asked = written(asked.select(*keys, "stage", "category", "most", "prompt"), "prompts")
    told = models.generate(asked.where("stage = 'snapshot'"), "prompt", model).select(*keys, F.col("answer").alias("snapshot"), "degraded")
    docs = written(rows.select(*keys).distinct().join(told, list(keys), "left").withColumn("degraded", F.coalesce("degraded", F.lit(True))), "snapshots")
    able = asked.where("stage <> 'snapshot'").join(docs.where(~F.col("degraded")).select(*keys), list(keys), "left_semi")
    cards = model_cards(written(models.generate(able, "prompt", model), "answers"), *keys)
    sources = rows.select(*keys, F.col("sent_idx").alias("ord"), F.col("sentence").alias("text"))
    sure = written(evidence.finalise(cards, sources, *keys, quote="evidence", within=("stage", "pos")), "cards")
    answered = sure.select(*keys, "stage").distinct()
    dim_stage = F.coalesce(*[F.when(F.col("dim").isin(*dims), F.lit(stage)) for stage, dims, _, _ in STAGES[1:]])
    kept = floor.withColumn("stage", dim_stage).join(answered, [*keys, "stage"], "left_anti")
    shown = ["stage", "pos", "category", "title", "summary", "severity"]
    out = sure.select(*keys, *shown, "confidence", F.lit("model").alias("source")).unionByName(kept.select(*keys, *shown, F.lit("Medium").alias("confidence"), F.lit("floor").alias("source")))
    return out, docs


# ── summaries of sections ──


def extractive_summaries(sections: DataFrame, *keys: str, encoder=vectors.hashed_vectors) -> DataFrame:
    """(keys, summary, anchors): the most central sentences in reading order; without sentences, how the section begins."""
    found = sentences.sentences(sections, *keys)
    named = found.withColumn("_id", F.xxhash64(*keys, "sent_idx"))
    central = vectors.centrality(vectors.encode(named, encoder=encoder), *keys, id_col="_id").withColumn("score", F.round("score", 9))
    sized = named.join(central.select("_id", "score"), "_id").join(sections.select(*keys, F.length("text").alias("_size")), list(keys))
    top = vectors.select_top(sized, vectors.target_count(F.col("_size")), *keys, order="start")
    made = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "sentence"))).alias("s"))  # nine at most
    spans = "array<struct<start:int,end:int>>"
    whole = F.trim("text")
    short = F.when(whole == "", "(empty section)").otherwise(F.concat(F.substring(whole, 1, 200), F.when(F.length(whole) > 200, "…").otherwise("")))
    out = sections.join(made, list(keys), "left")
    summary = F.coalesce(F.array_join(F.transform("s", lambda x: x["sentence"]), " "), short)
    anchors = F.coalesce(F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).cast(spans), F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"))).cast(spans))
    return out.select(*keys, summary.alias("summary"), anchors.alias("anchors"))


def summarise(sections: DataFrame, store: DataFrame, tier: str, *keys: str, model=None, encoder=vectors.hashed_vectors) -> tuple[DataFrame, DataFrame]:
    """(summaries, store): keys, register, summary, anchors, from_cache of each section, and the store with what is new.

    sections: keys, text.  store: keys, register, summary, anchors, ts.  A cached summary of the tier, for ``builtin`` else
    of ``extractive``, is taken as it is.  Others are made: by the model where the tier is ``builtin``, else, and where it
    has no answer, by extraction; a record is kept under the register that made it, never under the one asked for.
    """
    text = sections.select(*keys, F.coalesce("text", F.lit("")).alias("text"))
    registers = ("builtin", "extractive") if tier == "builtin" else ("extractive",)
    known = cache.prefer_register(store, *keys, registers=registers).select(*keys, "register", "summary", "anchors")
    hits = known.join(text.select(*keys), list(keys), "left_semi").withColumn("from_cache", F.lit(True))
    todo = text.join(known.select(*keys), list(keys), "left_anti")
    asked = models.generate(todo.withColumn("prompt", F.concat(F.lit("summary\n"), F.col("text"))), "prompt", model if tier == "builtin" else None)
    noted = asked.where(~F.col("degraded") & (F.trim("answer") != ""))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
    noted = written(noted, "notes")
    by_model = noted.select(*keys, F.lit("builtin").alias("register"), F.trim("answer").alias("summary"), whole.alias("anchors"))
    rest = todo.join(noted.select(*keys), list(keys), "left_anti")
    by_hand = extractive_summaries(rest, *keys, encoder=encoder).select(*keys, F.lit("extractive").alias("register"), "summary", "anchors")
    made = by_model.unionByName(by_hand)
    new = made.withColumn("ts", F.current_timestamp().cast(store.schema["ts"].dataType))
    return hits.unionByName(made.withColumn("from_cache", F.lit(False))), cache.upsert(store, new.select(*store.columns), *keys, "register")
