"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import re
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from quire import queries as own
from quire.session import prepare

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks".split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "~"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (float, np.floating)):
            return f"{float(v):.5f}" if v != int(v) else str(int(v))
        return str(int(v)) if isinstance(v, (int, np.integer)) else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(own.ORACLES))
def test_same_rows(spark, duck, name):
    got = own.QUERIES[name](prepare(spark), FOLDER).toPandas()
    want = duck.execute(own.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in own.QUERIES if n not in own.ORACLES])
def test_runs(spark, name):
    found = own.QUERIES[name](prepare(spark), FOLDER)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_constants_that_both_engines_share():
    """The SQL is made of the same lists as the operators; what these lists must say is stated here."""
    from quire.functions import text as T
    from quire.operators import relevance, segment
    from quire.plans import registry as R

    assert {"inc", "corp", "no", "mr", "etc", "jan", "us"} <= set(T.ABBREVIATIONS) and "item" not in T.ABBREVIATIONS
    ten_k = {k: (i, o) for k, i, o in segment.items("10-K")}
    assert ten_k["1a"][0] == "item_1a_risk_factors" and ten_k["7"][0] == "item_7_mdna" and ten_k["1"][0] == "item_1_business" and ten_k["8"][0].startswith("item_8")
    assert [k for k, _ in sorted(ten_k.items(), key=lambda x: x[1][1])][:4] == ["1", "1a", "1b", "1c"]
    assert list(R.KEYWORDS) == ["revenue", "margins", "cashflow", "balancesheet", "shares", "risk", "management"]
    for dim, said in (("revenue", "net sales"), ("margins", "gross margin"), ("cashflow", "free cash flow"), ("balancesheet", "covenants"), ("shares", "dividends"), ("risk", "litigation"), ("management", "we expect")):
        assert re.search(f"(?i)(?:{R.KEYWORDS[dim]})", said), dim
    assert relevance.PRIORITY[0].startswith("item_7") and len({s for s, _ in R.TITLES["S-1"]}) == len(R.TITLES["S-1"])
    assert {k for k, *_ in R.LEXICON} == {"uncertainty", "litigious", "negative", "constraining", "weak_modal"} and len({(k, t) for k, t, *_ in R.LEXICON}) == len(R.LEXICON)


def test_llm_can_be_taken_away(tmp_path):
    """Without the subpackage the rest imports and has its queries; a library that lacks is told."""
    import shutil
    import subprocess
    import sys

    root = Path(own.__file__).resolve().parent.parent
    shutil.copytree(root / "quire", tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"})
    assert told.stdout.split() == [str(len(own.QUERIES)), "False"]
    if (root / "quire" / "llm").exists():
        shutil.copytree(root / "quire" / "llm", tmp_path / "quire" / "llm")
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
        code = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__"
        told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
        assert told.returncode and "xxhash" in told.stderr
