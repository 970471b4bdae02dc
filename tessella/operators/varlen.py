"""Chunks of variable-length blocks: (block_id, data) rows, plain or compressed block by block."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import zstd_level_of
from tessella.operators.chunks import pack, unpack
from tessella.operators.filters import pieces

COMPRESSED = "chunk_id long, codec string, dictionary binary, blocks array<struct<block_id:long,nbytes:int,packed:binary>>"
#: A chunk's dictionary has one part in DICTIONARY_SHARE of its bytes, and is left out if that is too small to help.
MOST_DICTIONARY, LEAST_DICTIONARY, DICTIONARY_SHARE = 32_768, 256, 20


def packed(blocks: DataFrame, per_chunk: int) -> DataFrame:
    """(chunk_id, blocks): the chunk's blocks in order, empty or null ones as empty."""
    g = blocks.groupBy(F.floor(F.col("block_id") / per_chunk).cast("long").alias("chunk_id"))
    return g.agg(F.array_sort(F.collect_list(F.struct("block_id", F.coalesce("data", F.lit(b"")).alias("data")))).alias("blocks"))


def append(chunks: DataFrame, more: DataFrame) -> DataFrame:
    """more's chunks behind those of chunks, both packed() or both compressed(); block ids go on behind the last one.

    A ValueError if the two are of different kinds, as plain and compressed chunks do not mix.
    """
    if chunks.columns != more.columns:
        raise ValueError("chunks of different kinds do not mix")
    last = chunks.agg(F.max("chunk_id").alias("c"), F.max(F.transform("blocks", lambda b: b["block_id"])[F.size("blocks") - 1]).alias("b"))
    after = lambda c: F.coalesce(last.select(c).scalar(), F.lit(-1)) + 1
    moved = more.withColumn("chunk_id", F.col("chunk_id") + after("c")).withColumn("by", after("b"))
    shifted = F.expr("transform(blocks, b -> struct(b.block_id + by AS block_id, " + ", ".join(f"b.{f} AS {f}" for f in chunks.schema["blocks"].dataType.elementType.names[1:]) + "))")
    return chunks.unionByName(moved.withColumn("blocks", shifted).drop("by"))


def unpacked(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.explode("blocks").alias("b")).select("b.block_id", "b.data")


def block(chunks: DataFrame, per_chunk: int, number: int) -> DataFrame:
    """One block; only its chunk is read."""
    return chunks.where(F.col("chunk_id") == number // per_chunk).select(F.expr(f"filter(blocks, b -> b.block_id = {number})[0]").alias("b")).select("b.block_id", "b.data")


def byte_slices(chunks: DataFrame, start: int, length: int) -> DataFrame:
    """Of each chunk the bytes [start, start + length) of its joined blocks: (chunk_id, block_id, part)."""
    rows = chunks.select("chunk_id", F.explode("blocks").alias("b")).select("chunk_id", "b.block_id", "b.data", F.octet_length("b.data").cast("long").alias("n"))
    before = Window.partitionBy("chunk_id").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    low, high = F.greatest(F.lit(start) - F.col("at"), F.lit(0)), F.least(F.lit(start + length) - F.col("at"), F.col("n"))
    return rows.where(high > low).select("chunk_id", "block_id", F.substring("data", (low + 1).cast("int"), (high - low).cast("int")).alias("part"))


def _dictionary(blocks: list[bytes]) -> bytes:
    """A dictionary trained on the blocks of one chunk; empty if they are too few or too small for one."""
    size = min(MOST_DICTIONARY, sum(map(len, blocks)) // DICTIONARY_SHARE)
    if size < LEAST_DICTIONARY:
        return b""
    try:
        return zstandard.train_dictionary(size, [b for b in blocks if b]).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b""


def compressed(chunks: DataFrame, codec: str = "zstd", level: int = 5, dictionary: bool = False) -> DataFrame:
    """packed() chunks with every block compressed on its own; dictionary (zstd only): one per chunk, stored with it."""
    if dictionary and codec != "zstd":
        raise ValueError("dictionaries are for zstd only")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in pieces(batches):
            for chunk, blocks in zip(batch.column("chunk_id").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                known = _dictionary([b["data"] for b in blocks]) if dictionary else b""
                with_it = zstandard.ZstdCompressor(level=zstd_level_of(level), dict_data=zstandard.ZstdCompressionDict(known)) if known else None
                done = [{"block_id": b["block_id"], "nbytes": len(b["data"]), "packed": with_it.compress(b["data"]) if with_it else pack(codec, level, b["data"])} for b in blocks]
                schema = schema or pa.schema([("chunk_id", pa.int64()), ("codec", pa.string()), ("dictionary", pa.binary()), ("blocks", pa.list_(pa.struct([("block_id", pa.int64()), ("nbytes", pa.int32()), ("packed", pa.binary())])))])
                yield pa.RecordBatch.from_pylist([{"chunk_id": chunk, "codec": codec, "dictionary": known, "blocks": done}], schema=schema)

    return chunks.select("chunk_id", "blocks").mapInArrow(run, COMPRESSED)


def decompressed(chunks: DataFrame, number: int | None = None, per_chunk: int | None = None) -> DataFrame:
    """(block_id, data) of compressed() chunks; with number and per_chunk only that block is decoded."""
    if number is not None:
        chunks = chunks.where(F.col("chunk_id") == number // per_chunk).withColumn("blocks", F.expr(f"filter(blocks, b -> b.block_id = {number})"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for codec, known, blocks in zip(*(batch.column(c).to_pylist() for c in ("codec", "dictionary", "blocks")), strict=True):
                with_it = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known)) if known else None
                data = [with_it.decompress(b["packed"], max_output_size=b["nbytes"]) if with_it else unpack(codec, b["packed"], b["nbytes"]) for b in blocks]
                yield pa.RecordBatch.from_arrays([pa.array([b["block_id"] for b in blocks], pa.int64()), pa.array(data, pa.binary())], names=["block_id", "data"])

    return chunks.mapInArrow(run, "block_id long, data binary")
