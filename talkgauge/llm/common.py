"""What several operators share: cut lineage, tables in the shared folder, columns of the input.

Arrow batches are bounded by Spark's own settings (10,000 rows and 64 MB unless the session says otherwise), which no operator changes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of a batch that are Python objects at a time.
TEXTS = 500
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; a cluster has no such folder, so
    there the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="talkgauge-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/talkgauge/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back, which cuts lineage.

    Unlike a cached or locally checkpointed frame, the table outlives the executors that wrote it. The shuffles that made it
    are deleted as soon as it is written: a job of many tables would keep them all until the driver collects garbage.
    """
    spark, schema = df.sparkSession, df.schema
    path, before = shared_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:  # the setting holds for frames that are made under it
        df.select("*").write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that materialize() made and nothing reads any more."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for table in tables:
        folders = {file.rpartition("/")[0] for file in table.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def each_text(column: pa.Array, rows: int = TEXTS) -> Iterator[str | None]:
    """The texts of a batch's column, of which some rows are Python objects at a time."""
    for start in range(0, len(column), rows):
        yield from column.slice(start, rows).to_pylist()


def lower_ascii(column):
    """A-Z in lower case and nothing else changed, whatever the locale."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
