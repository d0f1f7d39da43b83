"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: The folder that holds the package.
ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let the session's Python workers import this package wherever the driver was started."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, *paths) if x)
    return spark


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); in our own only where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="quire-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        root = _OWN[app]
    return f"{root.rstrip('/')}/quire-{uuid.uuid4().hex}/{name}"


def written(df, name: str):
    """The rows as a table in the shared folder: what a model or a fold made is not made again by later actions."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that are Python objects at a time.
FRAME_ROWS = 128


def give_back() -> None:
    """Let a worker, which stays alive between tasks, return the memory that it no longer needs."""
    import ctypes
    from contextlib import suppress

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def few_at_a_time(parts, rows: int = FRAME_ROWS):
    """The Arrow columns of an iterator in slices of so many rows; memory is given back behind the last."""
    for part in parts:
        for at in range(0, len(part), rows):
            yield part.slice(at, rows)
    give_back()


def map_in_frames(df, run, fields: str, rows: int = FRAME_ROWS):
    """``mapInPandas`` by frames of so many rows, whatever an Arrow batch holds: what a worker keeps does not grow with its input."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(fields))

    def through(batches):
        for f in run(b.slice(at, rows).to_pandas() for b in batches for at in range(0, b.num_rows, rows)):
            yield pa.RecordBatch.from_pandas(f, schema, preserve_index=False)
        give_back()

    return df.mapInArrow(through, fields)


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quire")
    settings = {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return prepare(builder.getOrCreate())
