"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BATCH = "8m"
_BATCH_BYTES, _DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_FALLBACK: list[tempfile.TemporaryDirectory] = []


def free_name(wanted: str, taken: list[str]) -> str:
    """A column name that isn't among those taken, whatever their case."""
    known = {c.lower() for c in taken}
    while wanted.lower() in known:
        wanted += "_"
    return wanted


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def plainly_named(df: DataFrame, names: list[str]) -> DataFrame:
    """These columns, but for ``text`` and ``doc_id`` under names that nothing trips over."""
    return df.select(*(quoted(c).alias(c if c in ("text", "doc_id") else f"c{k}") for k, c in enumerate(names)))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session that names none (tests) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.TemporaryDirectory(prefix="prosewell-"))
    return f"file://{_FALLBACK[0].name}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that their Python finds it wherever the driver was started.

    Unless the session says otherwise, rows go to Python in batches of BATCH bytes: a batch is held several times, in the JVM and in Python.
    """
    if spark.conf.get(_BATCH_BYTES, _DEFAULT_BATCH) == _DEFAULT_BATCH:
        spark.conf.set(_BATCH_BYTES, BATCH)
    context = spark.sparkContext
    if getattr(context, "_prosewell_shipped", False):
        return
    package = Path(__file__).parents[1]
    archive = Path(tempfile.mkdtemp(prefix="prosewell-code-")) / "prosewell-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._prosewell_shipped = True


#: Shuffle files are deleted when the query that made them has ended, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _files_go_with_the_query(spark: SparkSession):
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


class Scratch:
    """Parquet tables under one folder of the shared store.

    A written table cuts the lineage and survives lost executors, which a local checkpoint does not.  ``drop`` removes tables
    as soon as nothing reads them any more; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/prosewell-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, by: tuple[str, ...] = (), **options: str) -> DataFrame:
        """by: columns whose values lie in folders of their own."""
        with _files_go_with_the_query(self.spark):
            df.write.options(**{"compression": "zstd"} | options).partitionBy(*by).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            for target in [self.path(n) for n in names] or [self.root]:
                path = jvm.org.apache.hadoop.fs.Path(target)
                path.getFileSystem(conf).delete(path, True)
        except Exception:  # the session may have ended before the interpreter does
            if names:
                raise
