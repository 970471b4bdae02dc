"""Chunk tables on storage: a Parquet table partitioned by ranges of chunk ids, with its parameters beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.container import offsets

#: Chunks of one directory; a range read opens the directories it meets only.
SPAN = 64


def write_chunks(chunks: DataFrame, path: str, params: dict[str, str] | None = None, layers: DataFrame | None = None) -> None:
    """Fails if the table exists.  params: name -> value; layers: (name, content) metadata."""
    spark = chunks.sparkSession
    spread = chunks.withColumn("span", F.floor(F.col("chunk_id") / SPAN).cast("long"))
    spread.repartition("span").sortWithinPartitions("chunk_id").write.partitionBy("span").parquet(f"{path}/chunks")
    rows = spark.createDataFrame(sorted((params or {}).items()), "name string, value string")
    rows.coalesce(1).write.parquet(f"{path}/params")
    (layers if layers is not None else spark.createDataFrame([], "name string, content binary")).write.parquet(f"{path}/layers")


def read_chunks(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """All chunks, or those with ids first..last; directories and row groups beyond are not read."""
    chunks = spark.read.parquet(f"{path}/chunks")
    if first is not None:
        chunks = chunks.where((F.col("span") >= first // SPAN) & (F.col("chunk_id") >= first))
    if last is not None:
        chunks = chunks.where((F.col("span") <= last // SPAN) & (F.col("chunk_id") <= last))
    return chunks.drop("span")


def read_params(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/params").collect()}


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/layers")


def chunk_refs(spark: SparkSession, path: str) -> DataFrame:
    """Of each chunk its items, sizes and offset among the packed ones, without payloads: column pruning keeps those unread."""
    refs = read_chunks(spark, path).select("chunk_id", "n", "nbytes", "cbytes")
    return refs.join(offsets(refs, "cbytes").select("chunk_id", "start"), "chunk_id")
