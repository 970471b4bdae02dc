"""Grids, deltas and runs as relations of (pos, bits): positions and blocks are columns, Catalyst plans the rest.

Input columns are pos (dense from 0) and bits (a 64-bit word as long).  Nulls are not part of a word sequence: filter or
fill them first.  Windows are partitioned by chunk.  Transposes, and deltas of other widths, are in filters, on binary blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import div


def gridded(words: DataFrame, chunk: int, block: int) -> DataFrame:
    """words with chunk_id, block_id (over all blocks) and the place in the block."""
    return words.withColumn("chunk_id", div(F.col("pos"), chunk)).withColumn("block_id", div(F.col("pos"), block)).withColumn("item", F.col("pos") % block)


def delta_encoded(words: DataFrame, chunk: int, block: int) -> DataFrame:
    """XOR delta: in a chunk's first block against the word before, elsewhere against the first block: (pos, d)."""
    rows = gridded(words, chunk, block)
    place = F.col("pos") % chunk
    first = F.col("bits").bitwiseXOR(F.coalesce(F.lag("bits").over(Window.partitionBy("chunk_id").orderBy("pos")), F.lit(0).cast("long")))
    head = F.max(F.when(place < block, F.col("bits"))).over(Window.partitionBy("chunk_id", "item"))
    return rows.select("pos", F.when(place < block, first).otherwise(F.col("bits").bitwiseXOR(head)).alias("d"))


def delta_decoded(deltas: DataFrame, chunk: int, block: int) -> DataFrame:
    """Inverse of delta_encoded(): a running XOR over the first block, then XOR with it: (pos, bits)."""
    rows = gridded(deltas.withColumnRenamed("d", "bits"), chunk, block)
    place = F.col("pos") % chunk
    running = F.bit_xor("bits").over(Window.partitionBy("chunk_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("head", F.when(place < block, running))
    head = F.max("head").over(Window.partitionBy("chunk_id", "item"))
    return rows.select("pos", F.when(place < block, F.col("head")).otherwise(F.col("bits").bitwiseXOR(head)).alias("bits"))


def runs(words: DataFrame, block: int, value: str = "bits") -> DataFrame:
    """Blocks whose items are all equal: (block_id, is_run, low)."""
    g = words.groupBy(div(F.col("pos"), block).alias("block_id")).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return g.select("block_id", (F.col("low") == F.col("high")).alias("is_run"), "low")
