"""Stages that ask for the same dimensions share their excerpt."""

import pytest

from quire.operators import composites, relevance


class Seen(Exception):
    pass


def test_a_sentence_is_packed_once_for_stages_of_equal_dimensions(spark, monkeypatch):
    def stop(rows, *rest):
        raise Seen(rows.count())

    monkeypatch.setattr(relevance, "pack", stop)
    rows = spark.createDataFrame([(1, "item_7", 1, 0, "Revenue of 12.")], "doc int, section_id string, section_order int, sent_idx int, sentence string")
    with pytest.raises(Seen) as told:
        composites.staged_analysis(rows, None, "doc")
    assert told.value.args == (2,)  # for the snapshot and the takeaways, and for revenue
