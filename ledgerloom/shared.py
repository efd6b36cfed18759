"""Tables in the folder that driver and executors share: they cut a lineage, so that a lost executor costs no recomputing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_kept: dict[tuple, tuple[str, object]] = {}


def folder(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir; of this machine only where that is unset, as in tests."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        folder.own = getattr(folder, "own", None) or "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        conf = folder.own
    return f"{conf.rstrip('/')}/ledgerloom/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stamp(spark: SparkSession, table: str) -> tuple:
    """Names, sizes and times of a table's files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in sorted(spark.read.parquet(table).inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(out)


def once(spark: SparkSession, what: str, table: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes of the files of ``table``, written once a session and read from then on; changed files are a new table."""
    key = (spark.sparkContext.applicationId, what, _stamp(spark, table))
    if key not in _kept:
        made, path = build(), folder(spark, what)
        made.write.parquet(path)
        _kept[key] = (path, made.schema)
    path, schema = _kept[key]
    return spark.read.schema(schema).parquet(path)
