"""What a report costs: short lists by rows of bits, runs of words looked through once, no tables of vectors."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import sequences
from quire.functions import text as T
from quire.operators import models, redline, vectors


def test_rows_of_bits_match_as_fronts_do(monkeypatch):
    r = random.Random(7)
    pairs = []
    for k in range(400):
        a = [r.randrange(1 + k % 9) for _ in range(r.randrange(0, 40))]
        pairs.append((a, [x for x in a if r.random() < 0.7] if k % 2 else [r.randrange(1 + k % 7) for _ in range(r.randrange(0, 30))]))
    short = [sequences.matched_flags(a, b) for a, b in pairs]
    monkeypatch.setattr(sequences, "Fronts", None)  # not needed for short lists
    assert [sequences.matched_flags(a, b) for a, b in pairs] == short
    monkeypatch.undo()
    monkeypatch.setattr(sequences, "BIT_PAIRS", -1)
    assert [sequences.matched_flags(a, b) for a, b in pairs] == short


def test_plain_last_words_are_looked_up(monkeypatch):
    text = 'One firm, Acme Inc. Limited, grew. Mr. Smith said so (see no. 5). It fell in the U.S. Then Corp. X rose. End'
    want = redline.split_sentences(text, 1)

    class Never:
        def search(self, before):
            assert not before[before.rfind(" ") + 1 :].replace(".", "").isalpha()

    monkeypatch.setattr(redline, "_GUARD", Never())
    assert redline.split_sentences(text, 1) == want
    assert [text[s:e] for s, e in want] == ["One firm, Acme Inc. Limited, grew.", "Mr. Smith said so (see no. 5).", "It fell in the U.S. Then Corp. X rose.", "End"]


def test_runs_of_word_characters_are_scored_once(monkeypatch):
    texts = ["Growth was strong and strong", "égrew, growthé: a re-strengthened LOSS; loss_es", "weaknesses", "", None, "Increaſed record-high"]
    plain = [(len(models._UP.findall(t or "")), len(models._DOWN.findall(t or ""))) for t in texts]
    want = [("neutral", 1.0) if p == n else ("positive" if p > n else "negative", max(p, n) / (p + n)) for p, n in plain]
    assert models.lexicon_scorer(texts) == want and want[0][0] == "positive" and want[2][0] == "negative"
    monkeypatch.setattr(models, "_UP", None)  # all runs are known by now
    assert models.lexicon_scorer(texts) == want


@pytest.mark.parametrize("small", [3, 64])
def test_texts_are_encoded_where_they_are_compared(spark, monkeypatch, small):
    rows = [(k % 4, k, " ".join(f"w{(k * j) % 7}" for j in range(k % 5))) for k in range(40)]
    df = spark.createDataFrame(rows, "g int, i int, sentence string")
    monkeypatch.setattr(vectors, "SMALL", small)
    want = {r.i: r.s for r in vectors.centrality(vectors.encode(df), "g", id_col="i").select("i", F.round("score", 9).alias("s")).collect()}
    monkeypatch.setattr(vectors, "written", None)  # no table of vectors
    got = vectors.centrality(df, "g", id_col="i", vector="sentence", encoder=vectors.hashed_vectors)
    assert {r.i: r.s for r in got.select("i", F.round("score", 9).alias("s")).collect()} == want and len(want) == 40


def test_texts_go_through_a_comparison(spark):
    """No join is needed to cut out what ranges say, and repeated documents keep their own texts."""
    df = spark.createDataFrame([(1, "A first sentence stands here. A new one follows it.", "A first sentence stands here."), (1, "Quite another sentence is here.", None)], "d int, current_text string, prior_text string")
    told = redline.redline(df, "d", "current_text").collect()
    assert sorted(r.current_text[x.start : x.end] for r in told for x in r.added) == ["A new one follows it.", "Quite another sentence is here."]


def test_most_ends_need_no_guard(spark):
    """Two plain letters before a full stop are enough; what the whole guard says stays, and marks in texts turn into blanks."""
    import re

    assert re.search(T._PLAIN.replace("[A-Za-z]{2}", "[A-Za-z][A-Za-z]") + "$", "statement") and not re.search(T._PLAIN + "$", "Corp") and not re.search(T._PLAIN + "$", "U.S")
    texts = ["Approx. The sum is here now. It grew (see No. 5). Mr. X left! The U.S. Then came é. The end of it.", "a\u0001b\u0002c statement. The next one stands here.", None, ""]
    whole = T.SENTENCE_END.replace(T._PLAIN + "|", "")
    assert whole != T.SENTENCE_END
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    plain = F.translate(F.coalesce("text", F.lit("")), "\u0001\u0002", "  ")
    said = df.select(T.clean(F.col("text")) == plain, F.regexp_replace(plain, whole, "$1|") == F.regexp_replace(plain, T.SENTENCE_END, "$1|"), F.regexp_replace(plain, T.SENTENCE_END, "$1|")).collect()
    assert all(r[0] and r[1] for r in said)
    assert said[0][2] == "Approx. The sum is here now.| It grew (see No. 5).| Mr. X left!| The U.S. Then came é.| The end of it."
    # words that hold no tone are not looked through at all
    models._TONES.clear()
    assert models.lexicon_scorer(["Nothing of the kind was said about the weather."])[0][0] == "neutral" and "Nothing" not in models._TONES and "the" not in models._TONES
