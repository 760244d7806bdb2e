"""Where intermediate tables live, and how they are written and removed.

Intermediate results go to the shared folder named by ``spark.checkpoint.dir``, so
a lost executor never loses them; without that setting they go under the warehouse,
which a cluster's machines share as well.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Compressed bytes of input aimed at per range partition and staged file.
PARTITION_BYTES = 128 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/martlib/{app}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written yet, so no job ever overwrites what it reads."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, cutting lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(table: DataFrame) -> int | None:
    """Partitions a full copy of a table scan needs, from the size of its files.

    None when the size is unknown; the session's shuffle settings apply then.
    """
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 2**63 - 1:
        return None
    return max(1, math.ceil(size / PARTITION_BYTES))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table this package wrote itself."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
