"""Scans and sinks; every schema is given, none is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The existing ones of a list of Parquet paths, each once, as one table."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in dict.fromkeys(paths) if (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)]
    if not there:
        raise FileNotFoundError("none of the listed files exists")
    return spark.read.parquet(*there)


def read_listed(spark: SparkSession, path: str) -> DataFrame:
    """The tables whose paths stand in a text file, line by line. A list of files is small; only its lines come to the driver."""
    return read_files(spark, [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()])


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True, corrupt: str | None = None, first: int | None = None) -> DataFrame:
    """JSON Lines: strict fails on a malformed line; otherwise such lines go, or stand in the column `corrupt`. `first` takes so many lines from the start."""
    mode = "FAILFAST" if strict else "DROPMALFORMED" if corrupt is None else "PERMISSIVE"
    reader = spark.read.schema(schema if strict or corrupt is None else f"{schema}, {corrupt} string").option("mode", mode)
    if corrupt is not None:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    if first is None:
        return reader.json(path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    head = [r["value"] for r in lines.orderBy("f", "b", "i").limit(first).collect()]  # as many lines as were asked for
    if corrupt is not None:
        schema, options = f"{schema}, {corrupt} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    else:
        options = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    found = spark.createDataFrame([(v,) for v in head], "value string").select("value", F.from_json("value", schema, options).alias("r"))
    return (found if strict or corrupt is not None else found.where(F.get_json_object("value", "$").isNotNull())).select("r.*")


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_json_document(df: DataFrame, path: str) -> None:
    """A nested table as files of one JSON array each."""
    rows = df.select(F.to_json(F.struct("*")).alias("j")).withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value"))
    rows.select("value").repartition("value").write.mode("overwrite").option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def write_with_errors(df: DataFrame, good, path: str, error_path: str) -> None:
    """Rows that are good to one sink, all others, and those of which it is not known, to another."""
    df.where(F.coalesce(good, F.lit(False))).write.mode("overwrite").json(path)
    df.where(~F.coalesce(good, F.lit(False))).write.mode("overwrite").json(error_path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Appends the rows whose keys are not written yet; running it again adds nothing."""
    spark = df.sparkSession
    q = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if q.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(q):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")
    df.write.mode("append").parquet(path)


def publish_shuffled(df: DataFrame, path: str, seed: int = 42) -> None:
    """A seeded shuffle written out: range-partitioned by a random key, so no single task holds it."""
    df.orderBy(F.rand(seed)).write.mode("overwrite").parquet(path)
