"""The folder that all executors share, and scratch paths in it."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few columns that joins may send to every task, at most.
SMALL_ROWS = 1 << 18

_own: dict[str, str] = {}
_scratch: dict[str, list[tuple[SparkSession, str]]] = {}
_scope = "session"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where it is set; else, in local mode only, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="gleanery-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; ``release`` of its scope deletes it."""
    path = f"{shared_dir(spark)}/gleanery-{label}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(lambda: [release(s) for s in list(_scratch)])
    _scratch.setdefault(_scope, []).append((spark, path))
    return path


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read again."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once, and sent to every task of a join where its rows are few."""
    table = shared_table(df, label)
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


@contextlib.contextmanager
def scratch_scope(name: str) -> Iterator[None]:
    """Scratch tables made inside belong to ``name`` and can be released with it."""
    global _scope
    before, _scope = _scope, name
    try:
        yield
    finally:
        _scope = before


def release(scope: str) -> None:
    """Delete a scope's scratch tables; nothing may still read them."""
    for spark, path in _scratch.pop(scope, []):
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
