"""Container algebra on (chunk_id, pos, value) rows: chunk ids are dense from 0, pos counts within the chunk.

Every change is a projection, filter, union or join; nothing is rewritten that the change does not touch once the table is
partitioned by chunk_id.  Prefix sums run over one row per chunk, never over items, in groups of OFFSET_GROUP chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import div

#: Chunks whose offsets one task sums up; the sums of whole groups, one row each, are broadcast.
OFFSET_GROUP = 65_536


def chunks_of(rows: DataFrame, size: int, pos: str = "pos", value: str = "value") -> DataFrame:
    return rows.select(div(F.col(pos), size).alias("chunk_id"), (F.col(pos) % size).alias("pos"), F.col(value).alias("value"))


def append(rows: DataFrame, more: DataFrame) -> DataFrame:
    """more's chunks behind those of rows."""
    base = rows.agg(F.coalesce(F.max("chunk_id"), F.lit(-1)) + 1).scalar()
    return rows.unionByName(more.select((F.col("chunk_id") + base).alias("chunk_id"), "pos", "value"))


def insert(rows: DataFrame, at: int, chunk: DataFrame) -> DataFrame:
    """A chunk (pos, value) before chunk `at`."""
    moved = rows.withColumn("chunk_id", F.when(F.col("chunk_id") >= at, F.col("chunk_id") + 1).otherwise(F.col("chunk_id")))
    return moved.unionByName(chunk.select(F.lit(at).cast("long").alias("chunk_id"), "pos", "value"))


def delete(rows: DataFrame, at: int) -> DataFrame:
    return rows.where(F.col("chunk_id") != at).withColumn("chunk_id", F.when(F.col("chunk_id") > at, F.col("chunk_id") - 1).otherwise(F.col("chunk_id")))


def update(rows: DataFrame, at: int, chunk: DataFrame) -> DataFrame:
    """Another content for chunk `at`, of any size."""
    return rows.where(F.col("chunk_id") != at).unionByName(chunk.select(F.lit(at).cast("long").alias("chunk_id"), "pos", "value"))


def reorder(rows: DataFrame, order: DataFrame) -> DataFrame:
    """order: (new_id, old_id), a permutation of the chunk ids."""
    return rows.join(order, rows["chunk_id"] == order["old_id"]).select(F.col("new_id").alias("chunk_id"), "pos", "value")


def set_slice(rows: DataFrame, patch: DataFrame) -> DataFrame:
    """Values of patch (chunk_id, pos, new) in place of those at its positions."""
    return rows.join(patch, ["chunk_id", "pos"], "left").select("chunk_id", "pos", F.coalesce("new", "value").alias("value"))


def offsets(sizes: DataFrame, size: str = "nbytes") -> DataFrame:
    """(chunk_id, nbytes or cbytes) -> with the sum of the sizes before each chunk."""
    rows = sizes.select("chunk_id", size, div(F.col("chunk_id"), OFFSET_GROUP).alias("g"))
    before = lambda w: F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = rows.groupBy("g").agg(F.sum(size).alias(size)).select("g", before(Window.orderBy("g")).alias("base"))
    inner = rows.withColumn("at", before(Window.partitionBy("g").orderBy("chunk_id")))
    return inner.join(groups, "g").select("chunk_id", size, (F.col("base") + F.col("at")).cast("long").alias("start"))


def chunk_range(sizes: DataFrame, start: int, length: int) -> DataFrame:
    """Half-open range of the chunks that a byte slice meets, as one row (first_chunk, end_chunk)."""
    placed = offsets(sizes)
    if length == 0:
        first = placed.agg(F.coalesce(F.min(F.when(F.col("start") >= start, F.col("chunk_id"))), F.max("chunk_id") + 1).alias("first_chunk"))
        return first.select("first_chunk", F.col("first_chunk").alias("end_chunk"))
    met = placed.where((F.col("start") < start + length) & (F.col("start") + F.col("nbytes") > start))
    return met.agg(F.min("chunk_id").alias("first_chunk"), (F.max("chunk_id") + 1).alias("end_chunk"))


def totals(sizes: DataFrame) -> DataFrame:
    """Chunks, bytes (packed ones too where sizes has cbytes), and whether the chunks differ in size (the last one may be short)."""
    last = sizes.agg(F.max("chunk_id")).scalar()
    rows = sizes.withColumn("last", last)
    packed = [F.sum("cbytes").alias("cbytes")] if "cbytes" in sizes.columns else []
    return rows.agg(F.count("*").alias("nchunks"), F.sum("nbytes").alias("nbytes"), *packed, (F.count_distinct(F.when(F.col("chunk_id") < F.col("last"), F.col("nbytes"))) > 1).alias("variable"))


def byte_slice(blobs: DataFrame, start: int, length: int) -> DataFrame:
    """(chunk_id, nbytes, data) -> (chunk_id, part): the bytes of a slice, from the chunks it meets only."""
    placed = offsets(blobs.select("chunk_id", "nbytes"))
    met = placed.where((F.col("start") < start + length) & (F.col("start") + F.col("nbytes") > start))
    low = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    high = F.least(F.lit(start + length) - F.col("start"), F.col("nbytes"))
    return blobs.select("chunk_id", "data").join(met, "chunk_id").select("chunk_id", F.substring("data", (low + 1).cast("int"), (high - low).cast("int")).alias("part"))


LAYER_KINDS = ("fixed", "vl")
#: Bytes of a layer's name.
LONGEST_NAME = 31


def layer(spark: SparkSession, kind: str, name: str, content: bytes) -> DataFrame:
    """One row of named metadata (kind, name, content); bad names and kinds raise."""
    if kind not in LAYER_KINDS:
        raise ValueError(f"unknown kind of layer: {kind}")
    if not 1 <= len(name.encode()) <= LONGEST_NAME:
        raise ValueError("a layer's name has 1 to 31 bytes")
    return spark.createDataFrame([(kind, name, bytearray(content))], "kind string, name string, content binary")


def upsert_layers(layers: DataFrame, more: DataFrame) -> DataFrame:
    """more's rows replace those of the same kind and name; tables without a kind have one kind."""
    return layers.join(more, [c for c in ("kind", "name") if c in layers.columns], "left_anti").unionByName(more)


def read_layer(layers: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """The content of a layer as one row, or none."""
    found = layers.where(F.col("name") == name)
    return (found.where(F.col("kind") == kind) if kind else found).select("content")


def remove_layer(layers: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    same = (F.col("name") == name) & (F.col("kind") == kind) if kind else F.col("name") == name
    return layers.where(~same)
