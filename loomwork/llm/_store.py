"""Tables written to the folder that all executors share.

They cut lineage: a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return _qualified(spark, folder.rstrip("/"))
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _FALLBACK:
        keeper = tempfile.TemporaryDirectory(prefix="loomwork-")
        atexit.register(keeper.cleanup)
        _FALLBACK["dir"] = "file://" + keeper.name
    return _FALLBACK["dir"]


def _qualified(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme, as ``scheme://``: one without is on Hadoop's default file system, for Arrow too."""
    head, colon, rest = folder.partition(":/")
    if not colon or "/" in head:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        folder = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
        head, _, rest = folder.partition(":/")
    return folder if rest.startswith("/") else f"{head}:///{rest}"


#: Texts are long, so Arrow batches smaller than Spark's default of 10,000 rows bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most BATCH_ROWS rows and BATCH_BYTES (or one row); smaller settings stay."""
    for name, most in ((_ROWS, BATCH_ROWS), (_BYTES, BATCH_BYTES)):
        now = spark.conf.get(name).lower().rstrip("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def lean(run):
    """``run`` for ``mapInArrow``; when a partition is done, the worker, which lives on, gives its freed memory back."""

    def through(batches):
        yield from run(batches)
        give_back()

    return through


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Schemes that Arrow's file systems read and write. Files that aren't Parquet go through them.
DIRECT = {"file", "hdfs", "viewfs", "s3", "gs", "gcs", "abfs", "abfss"}


def direct(spark: SparkSession) -> None:
    """ValueError at once if the shared folder is on a file system that tasks can't write files to."""
    scheme, colon, _ = shared_dir(spark).partition("://")
    if colon and scheme not in DIRECT:
        raise ValueError(f"spark.checkpoint.dir is on {scheme}; this operator writes files of its own and needs one of {', '.join(sorted(DIRECT))}")


def opened(path: str):
    """Arrow's file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def put(folder: str, name: str, write) -> None:
    """Has ``write`` fill a file of this attempt's own, which then gets its name: attempts of one task don't
    mix, and a file under its name is whole."""
    where, path = opened(folder)
    where.create_dir(path, recursive=True)
    mine = f"{path}/{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(mine) as f:
        write(f)
    where.move(mine, f"{path}/{name}")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet and read again, with its path. Its shuffle files go when it is written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_LATER: list[str] = []


def later(*paths: str) -> None:
    """Has tables that lazy results still read deleted when this Python process ends."""
    if not _LATER:
        atexit.register(_delete)
    _LATER.extend(paths)


def _delete() -> None:
    for path in _LATER:
        try:
            where, name = opened(path)
            where.delete_dir(name)
        except (OSError, ValueError):  # gone already, or not reachable without the session
            pass
