"""The sentiment pass over whole documents: stored results first, then a model over what is left, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.models import lexicon_scorer
from quire.operators.relevance import priority
from quire.operators.sentences import outside_tables, sentences
from quire.operators.sentiment import calibrate

#: Texts that a model gets in one call.
BATCH = 16
Scorer = Callable[[list[str]], list[tuple[str, float]]]


def score_texts(texts: DataFrame, load: Callable[[], Scorer], text: str = "sentence", batch: int = BATCH) -> DataFrame:
    """texts with ``raw``, ``score`` and ``degraded``; ``load`` gives the model and runs once a task.

    Texts of an Arrow batch go to the model by length, so that a call has texts of about one length and little is
    padded.  A call that fails, or that gives another number of answers, leaves its own texts neutral, with a score of 0, and degraded;
    the others stand.  A null text is not given to the model.
    """
    from pyspark.sql.functions import arrow_udf

    kind = pa.struct([("raw", pa.string()), ("score", pa.float64()), ("degraded", pa.bool_())])

    @arrow_udf("struct<raw:string,score:double,degraded:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = None
        for part in batches:
            values = part.to_pylist()
            out = [{"raw": "neutral", "score": 0.0, "degraded": True}] * len(values)
            order = sorted((i for i, v in enumerate(values) if v is not None), key=lambda i: len(values[i]))
            for s in range(0, len(order), batch):
                own = order[s : s + batch]
                try:
                    model = model or load()
                    answers = model([values[i] for i in own])
                    if len(answers) != len(own):
                        raise ValueError("a model that lost texts")
                except Exception:  # these texts are left to the deterministic tier, and say so
                    continue
                for i, (raw, score) in zip(own, answers, strict=True):
                    out[i] = {"raw": raw, "score": float(score), "degraded": False}
            yield pa.array(out, kind)

    return texts.withColumn("_m", run(F.col(text))).select(*[F.col(f"`{c}`") for c in texts.columns], "_m.raw", "_m.score", "_m.degraded")


def sentiment_pass(sections: DataFrame, store: DataFrame, *keys: str, model: str, load: Callable[[], Scorer] = lambda: lexicon_scorer, text: str = "text", tables: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, records): sentiments of all sentences of documents, and what is new in the store.

    sections: keys, text_hash (of the document), section_id, section_order, start (of the section), text; tables as
    array<struct<s, e>> in the document's characters.  store: text_hash, model, results: array of what ``results``
    has of a document.  results: keys, place (of the section, the most wanted first), section_id, sent_idx, label,
    score, start, end, degraded, cached.

    A document whose text was scored by this model is taken from the store and never reaches the model.  Of the others, sentences
    in tables are left out and keep their numbers; each distinct sentence is scored once, wherever it stands, and what is
    scored is written out, so that reading results and records runs the model once.  Degraded documents are not stored.
    """
    from quire.session import written

    spells = "array<struct<place:int,section_id:string,sent_idx:int,label:string,score:double,start:int,end:int>>"
    known = store.where(F.col("model") == model).groupBy("text_hash").agg(F.first("results").cast(spells).alias("_r"))
    hashed = sections.select(*keys, "text_hash").distinct().join(known, "text_hash")
    cached = hashed.select(*keys, F.inline("_r")).withColumn("degraded", F.lit(False)).withColumn("cached", F.lit(True))

    left = sections.join(known.select("text_hash"), "text_hash", "left_anti")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(priority(F.col("section_id")), "section_order"))  # of one document
    ranked = left.withColumn("place", place).withColumnRenamed("start", "_from")
    more = [] if tables is None else [tables]
    said = sentences(ranked, *keys, "text_hash", "section_id", "place", "_from", *more, text=text)
    said = said.withColumn("start", F.col("_from") + F.col("start")).withColumn("end", F.col("_from") + F.col("end"))
    if tables is not None:
        said = said.where(outside_tables(F.col("start"), F.col("end"), F.col(tables)))
    said = written(said, "sentences")  # texts are split once
    once = score_texts(said.select("sentence").distinct(), load)
    scored = said.join(once, "sentence").withColumn("label", calibrate(F.lower("raw"), F.col("score")))
    new = written(scored.select(*keys, "text_hash", "place", "section_id", "sent_idx", "label", "score", "start", "end", "degraded"), "sentiments")
    order = ["place", "section_id", "sent_idx", "label", "score", "start", "end"]
    whole = new.groupBy("text_hash").agg(F.array_sort(F.array_distinct(F.collect_list(F.struct(*order)))).alias("results"), F.bool_or("degraded").alias("_d"))  # of one document's text
    records = whole.where(~F.col("_d")).select("text_hash", F.lit(model).alias("model"), "results")
    results = cached.unionByName(new.drop("text_hash").withColumn("cached", F.lit(False)))
    return results, records
