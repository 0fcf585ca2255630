"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys of a window of running sums.
GROUP = 1024
#: For split(): the separators between words.
NOT_WORD = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, spark.checkpoint.dir. Unset, it is a temporary one if driver and executors are one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="forumlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._table_path = path
    return found


def discard(df: DataFrame) -> None:
    """Delete a table that cut() wrote and that no later plan reads."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._table_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_earlier(counts: DataFrame, key: str, levels: int = 3) -> DataFrame:
    """counts (key, n) with earlier, what the smaller keys count; keys are whole numbers, one row each.

    Sums go over GROUP keys, then over GROUP such sums, and so on, so that no window holds all rows."""
    if not levels:
        return counts.withColumn("earlier", F.sum("n").over(W.orderBy(key)) - F.col("n"))
    group = f"_group{levels}"
    own = counts.withColumn(group, F.floor(F.col(key) / GROUP))
    own = own.withColumn("_within", F.sum("n").over(W.partitionBy(group).orderBy(key)) - F.col("n"))
    groups = with_earlier(own.groupBy(group).agg(F.sum("n").alias("n")), group, levels - 1)
    found = own.join(groups.select(group, "earlier"), group)
    return found.select(key, "n", (F.col("earlier") + F.col("_within")).alias("earlier"))


def words(text):
    """Words of a text column; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
