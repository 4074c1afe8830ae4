"""Helpers shared by the training-data operators: table access, shared storage, tokenizer files."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table; other columns never reach the operators."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees. Where it is unset and the master
    is local (tests, a single machine) a temporary folder is made and set; on a cluster that is an
    error, as no folder of one machine would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="freshet-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut, and a
    lost executor costs no more than rereading the table. The table goes when the session ends, or
    by release()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/freshet-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(discard, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._freshet_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove the table behind a frame of materialize() that nothing reads any more."""
    path = getattr(df, "_freshet_path", None)
    if path:
        discard(df.sparkSession, path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that materialize() wrote; a stopped session leaves it to the folder's owner."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's vocabulary, the default of the operators' path parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)
