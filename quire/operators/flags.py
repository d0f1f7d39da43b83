"""Language flags from a lexicon table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import sentence_spans
from quire.operators.sentences import inside_table
from quire.plans.registry import LEXICON, PHRASES, layered
from quire.session import few_at_a_time

# Fixed value: language of safe harbours.
BOILERPLATE = r"(?i)(forward[- ]looking statements?|private securities litigation reform act|safe[- ]harbor|within the meaning of section 27a|undertake no (?:obligation|duty) to (?:update|revise)|actual results (?:could|may|might) differ materially|these forward-looking statements)"
#: Terms of a lexicon at most: they go to every task.
MAX_TERMS = 50_000


def lexicon(spark: SparkSession, overrides: list[tuple] = (), words: bool = True) -> DataFrame:
    """(type, term, note, case_sensitive): phrases, below them single words unless they are not wanted, and the user's own on top of both."""
    return spark.createDataFrame([*(LEXICON if words else layered(PHRASES)), *overrides], "type string, term string, note string, case_sensitive boolean")


_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def _lower(s: str) -> str:
    """A-Z in lower case; no other character changes, so that none changes its place."""
    low = s.lower()
    return low if s.isascii() or len(low) == len(s) else re.sub("[A-Z]+", lambda m: m[0].lower(), s)


class Automaton:
    """All terms of a lexicon in one automaton: a text is gone through once, however many terms there are."""

    def __init__(self, terms: list[tuple[str, bool]]):
        import ahocorasick

        held: dict[str, list[int]] = {}
        for k, (term, _) in enumerate(terms):
            if term:
                held.setdefault(_lower(term), []).append(k)
        self.terms, self.of = terms, ahocorasick.Automaton()
        for low, numbers in held.items():
            self.of.add_word(low, (low, numbers))
        if held:
            self.of.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(term, start, end) of every hit between borders of words; hits of one term don't overlap, the first counts."""
        out, free = [], {}
        if not len(self.of):
            return out
        for last, (low, numbers) in self.of.iter(_lower(text)):
            start, end = last + 1 - len(low), last + 1
            if start and text[start - 1] in _WORD or end < len(text) and text[end] in _WORD:
                continue
            said = text[start:end]
            if not said.isascii() and _lower(said) != low:  # a letter whose lower case is another's
                continue
            for k in numbers:
                if start >= free.get(k, 0) and (not self.terms[k][1] or said == self.terms[k][0]):
                    free[k] = end
                    out.append((k, start, end))
        return out


def term_hits(text, terms: list[tuple[str, bool]]):
    """array<struct<k, start, end, term>> of the hits of (term, case counts) rows in a text column."""
    from pyspark.sql.functions import arrow_udf

    kind = pa.struct([("k", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("term", pa.string())])

    @arrow_udf("array<struct<k:int,start:int,end:int,term:string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = Automaton(terms)
        for texts in few_at_a_time(batches):
            found, said, ends = [], [], [0]
            for t in texts.to_pylist():
                hits = automaton.hits(t) if t else []
                found += hits
                said += [t[s:e] for _, s, e in hits]
                ends.append(len(found))
            k, start, end = np.array(found, np.int32).reshape(-1, 3).T
            rows = pa.StructArray.from_arrays([pa.array(k), pa.array(start), pa.array(end), pa.array(said, pa.string())], fields=list(kind))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return run(text)


def flag(sections: DataFrame, terms: DataFrame, *keys: str, text: str = "text", offset: str | None = None, tables: str | None = None) -> DataFrame:
    """(keys, type, term, note, start, end, boilerplate): every whole-word hit of every term, overlaps of terms included.

    Ranges are lifted by ``offset``; hits within a range of ``tables`` are left out; one that starts in a sentence of
    safe-harbour language is boilerplate.  Each text is gone through once and stays where it is; the terms, bounded in
    number, go to the tasks.  A null text has no hits.
    """
    rows = terms.select("type", "term", "note", "case_sensitive").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a lexicon of over {MAX_TERMS} terms")
    at = F.lit(0) if offset is None else F.col(offset)
    safe = F.filter(sentence_spans(F.when(F.col(text).rlike(BOILERPLATE), F.col(text)).otherwise("")), lambda s: s["text"].rlike(BOILERPLATE))
    # plain ranges, as a struct that holds a text would be copied with every hit
    safe = F.transform(safe, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    within = F.lit(None).cast("array<struct<s:int,e:int>>") if tables is None else F.col(tables)
    hit = term_hits(F.col(text), [(r.term or "", bool(r.case_sensitive)) for r in rows])
    told = sections.select(*keys, at.alias("_at"), within.alias("_tables"), safe.alias("_safe"), hit.alias("_h")).where(F.size("_h") > 0)
    hits = told.select(*keys, "_at", "_tables", "_safe", F.explode("_h").alias("h"))
    start, end = F.col("_at") + F.col("h.start"), F.col("_at") + F.col("h.end")
    boilerplate = F.exists("_safe", lambda s: (F.col("h.start") >= s["start"]) & (F.col("h.start") < s["end"]))
    kept = hits.where(~inside_table(start, end, F.col("_tables"))).select(*keys, F.col("h.k").alias("_k"), F.col("h.term").alias("term"), start.alias("start"), end.alias("end"), boilerplate.alias("boilerplate"))
    named = sections.sparkSession.createDataFrame([(k, r.type, r.note) for k, r in enumerate(rows)], "_k int, type string, note string")
    return kept.join(F.broadcast(named), "_k").select(*keys, "type", "term", "note", "start", "end", "boilerplate")


def visible(flags: DataFrame, types: dict[str, bool], boilerplate: bool) -> DataFrame:
    """Flags of the types switched on; boilerplate only if asked for."""
    on = F.col("type").isin(*[t for t, x in types.items() if x])
    return flags.where(on if boilerplate else on & ~F.col("boilerplate"))


def density(flags: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, heavy, parts): documents with 8 flags and more; parts counts each type, the most frequent first."""
    by_type = flags.groupBy(*keys, "type").agg(F.count("*").alias("k"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("a"), "type"))), lambda x: F.concat(F.replace(x["type"], F.lit("_"), F.lit(" ")), F.lit(" ×"), (-x["a"]).cast("string"))), ", ")
    out = by_type.groupBy(*keys).agg(F.sum("k").alias("n"), parts.alias("parts"))
    return out.where("n >= 8").select(*keys, "n", (F.col("n") > 40).alias("heavy"), "parts")
