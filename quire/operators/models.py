"""Pluggable models: classify sentences, generate constrained JSON, coerce what comes back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.sentiment import POSITIVE, calibrate
from quire.session import few_at_a_time

#: Texts that a scorer gets in one call.
CALL_ROWS = 1_024


_RUNS, _UP = re.compile(r"\w+"), re.compile(POSITIVE)
_DOWN = re.compile(r"(?i)\b(?:loss(?:es)?|declin\w+|decreas\w+|weak\w*|threat\w*|adverse\w*|worthless|impair\w+|litigation)\b")


#: The first letters of all words of tone.  In a run of plain characters a hit begins where the run does.
_STEMS = frozenset(re.findall("[(|:]([a-z]{3})", POSITIVE + _DOWN.pattern))
_LIKELY = re.compile(rf"\b(?:{'|'.join(sorted(_STEMS))})\w*")


class _Tones(dict):
    """Hits in a run of word characters: those of positive tone, and those of loss times 1 << 32."""

    def __missing__(self, run: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        hits = self[run] = len(_UP.findall(run)) + (len(_DOWN.findall(run)) << 32)
        return hits


_TONES = _Tones()


def lexicon_scorer(texts: list[str]) -> list[tuple[str, float]]:
    """The stand-in classifier: words of positive tone against words of loss."""
    out = []
    for t in texts:
        # no hit goes beyond a run of word characters, so each such run that may hold one is looked through once
        t = t or ""
        runs = _LIKELY.findall(t.lower()) if t.isascii() else [x for x in _RUNS.findall(t) if x[:3].lower() in _STEMS or not x.isascii()]
        n, p = divmod(sum(map(_TONES.__getitem__, runs)), 1 << 32) if runs else (0, 0)
        out.append(("neutral", 1.0) if p == n else ("positive" if p > n else "negative", max(p, n) / (p + n)))
    return out


def classify(sentences: DataFrame, text: str = "sentence", scorer=lexicon_scorer) -> DataFrame:
    """sentences with ``label`` and ``score``; the scorer takes a list of texts, CALL_ROWS at most."""
    from pyspark.sql.functions import arrow_udf

    kind = pa.struct([("raw", pa.string()), ("score", pa.float64())])

    @arrow_udf("raw string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in few_at_a_time(batches, CALL_ROWS):
            raw, score = zip(*told, strict=True) if (told := scorer(part.to_pylist())) else ((), ())
            yield pa.StructArray.from_arrays([pa.array(raw, pa.string()), pa.array(score, pa.float64())], fields=list(kind))

    out = sentences.withColumn("_m", run(F.col(text)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_m.score")))
    return out.withColumn("score", score).withColumn("label", calibrate(F.lower(F.col("_m.raw")), F.col("score"))).drop("_m")


def json_body(text: Column) -> Column:
    """A model's answer without code fences and what precedes the first bracket."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*|\s*```$", "")
    return F.regexp_extract(bare, r"(?s)([{\[].*)", 1)


def score_1_to_5(value: Column) -> Column:
    n = value.try_cast("double")
    return F.when(n.between(1, 5), F.floor(n + 0.5)).otherwise(3).cast("int")


def generate(rows: DataFrame, prompt: str, model=None) -> DataFrame:
    """rows with ``answer`` (null without a model, or where it fails) and ``degraded``."""
    if model is None:
        return rows.withColumn("answer", F.lit(None).cast("string")).withColumn("degraded", F.lit(True))
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def run(prompts):
        out = []
        for p in prompts:
            try:
                out.append(model(p))
            except Exception:  # a model that fails leaves the row to the deterministic tier
                out.append(None)
        return pd.Series(out, dtype="object")

    return rows.withColumn("answer", run(F.col(prompt))).withColumn("degraded", F.col("answer").isNull())
