"""Helpers shared by the operators of this subpackage.

Everything here works against the session it is given: scratch tables go to the
folder named by ``spark.checkpoint.dir`` (shared by driver and executors); only
where that setting is absent, as in local tests, is a folder of our own set.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import threading
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII-only lower-casing for UTF-8 bytes; the other bytes stay as they are.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_OWN_ROOT: dict[str, str] = {}
#: Paths of the scratch tables that a thread has made within ``passing_tables``.
_MADE = threading.local()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables: spark.checkpoint.dir, or our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _OWN_ROOT:
            _OWN_ROOT[app] = tempfile.mkdtemp(prefix="quire-scratch-")
            atexit.register(_drop_tree, _OWN_ROOT[app])
        root = _OWN_ROOT[app]
    return root.rstrip("/")


def _drop_tree(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/quire-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the rereading of files, never the
    recomputation of what made them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    getattr(_MADE, "paths", []).append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing_tables(spark: SparkSession):
    """Scratch tables made within (by this thread) are deleted at its end; what is given out must not read them."""
    before, _MADE.paths = getattr(_MADE, "paths", None), []
    try:
        yield
    finally:
        conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
        for path in _MADE.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        _MADE.paths = before if before is not None else []


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of tables that are written out by now.

    They go when the driver collects its garbage, which a driver with little to do may not come to.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return what this worker has freed to the system: it stays alive between tasks, beside its executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def sparing(run):
    """A function over Arrow batches that gives back its memory when it is through."""

    @functools.wraps(run)
    def through(batches):
        yield from run(batches)
        give_back()

    return through


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8 bytes."""
    return utf8(text).translate(LOWER_ASCII).split()


def slices_by_size(sizes: list[int], most: int):
    """Ranges (start, end) of consecutive rows holding at most ``most`` in total (one row at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column is called so, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def wrapped(docs: DataFrame, **keys) -> DataFrame:
    """Rows as a struct ``doc`` beside key columns, so that joins meet no other names; ``doc.*`` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[v.alias(k) for k, v in keys.items()])
