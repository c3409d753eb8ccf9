"""Tables that cut a plan's lineage: written to the shared folder and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run in one process."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may have ended before the interpreter
        pass


def together(tables: list[DataFrame]) -> DataFrame:
    """Settled tables of one schema, read as one."""
    folders = {f.rsplit("/", 1)[0] for table in tables for f in table.inputFiles()}
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*sorted(folders)) if folders else tables[0]


def spread(df: DataFrame, key: str | list[str], rows: int | None = None, each: int = 500_000) -> DataFrame:
    """``df`` dealt by ``key`` over as many tasks as its rows ask for, however few shuffle partitions the session has.

    Later groupings by the key and more columns stay in these tasks."""
    n = df.count() if rows is None else rows
    return df.repartition(-(-n // each) or 1, *([key] if isinstance(key, str) else key))


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that no later plan reads, so that scratch space doesn't add up."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _remove(table.sparkSession, path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    Unlike a local checkpoint the files survive a lost executor. They go when the driver's process ends."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(schema).parquet(path)
