"""Compressed chunks: one row per chunk, with its sizes and parameters beside the blocks.

A chunk is a few MiB at most.  Its items are cut into blocks, each block goes through the filters, and each of its streams
(one, or one for each byte of the item) is compressed on its own, so that a slice decodes only the blocks it meets.  A
stream that does not shrink is kept as it is, one of equal bytes is that byte.  A chunk of equal items is kept as one item
("run"), a chunk that does not shrink as its plain bytes ("stored").  Codecs are those of public libraries (zlib,
zstandard, Arrow's LZ4 block); Spark deals chunks out, small helpers turn one stream into another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import FORMATS, CODECS, ITEMS, zstd_level_of
from tessella.operators import filters
from tessella.params import ChunkParams

CHUNKS = "chunk_id long, n int, typesize int, nbytes long, cbytes long, blocksize long, codec string, level int, filters array<string>, meta array<int>, kind string, blocks array<array<binary>>"
ARROW = pa.schema([("chunk_id", pa.int64()), ("n", pa.int32()), ("typesize", pa.int32()), ("nbytes", pa.int64()), ("cbytes", pa.int64()), ("blocksize", pa.int64()), ("codec", pa.string()), ("level", pa.int32()), ("filters", pa.list_(pa.string())), ("meta", pa.list_(pa.int32())), ("kind", pa.string()), ("blocks", pa.list_(pa.list_(pa.binary())))])


def pack(codec: str, level: int, data: bytes) -> bytes:
    if codec == "zlib":
        return zlib.compress(data, level)
    if codec == "zstd":
        return zstandard.ZstdCompressor(level=zstd_level_of(level)).compress(data)
    if codec in ("lz4", "lz4hc"):
        return pa.Codec("lz4_raw", compression_level=max(3, level) if codec == "lz4hc" else None).compress(data, asbytes=True)
    raise ValueError(f"unknown codec: {codec}")


def unpack(codec: str, data: bytes, size: int) -> bytes:
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "zstd":
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    return pa.Codec("lz4_raw").decompress(data, size, asbytes=True)


def _stream(codec: str, level: int, data: bytes) -> bytes:
    """A stream as kept: one byte for equal ones, packed if that is shorter, else as it is."""
    if len(data) > 1 and data == data[:1] * len(data):
        return data[:1]
    out = pack(codec, level, data) if level and data else data
    return out if len(out) < len(data) and len(out) > 1 else data


def _plain(codec: str, kept: bytes, size: int) -> bytes:
    return kept if len(kept) == size else kept * size if len(kept) == 1 else unpack(codec, kept, size)


def encode_chunk(chunk: int, data: bytes, width: int, params: ChunkParams, blocksize: int, split: bool, old: list | None = None, touched: frozenset[int] = frozenset()) -> dict:
    """A row of CHUNKS from a chunk's bytes; with old, blocks that are not touched are taken from there."""
    row = {"chunk_id": chunk, "n": len(data) // width, "typesize": width, "nbytes": len(data), "blocksize": blocksize, "codec": params.codec, "level": params.level, "filters": list(params.filters), "meta": [m for _, m in params.stack]}
    stack = filters.checked(params.stack)
    for name, bits in stack:  # what truncation drops is dropped in every kind of chunk
        if name.startswith("trunc"):
            data = filters.truncated(data, width, bits)
    if len(data) > width and data == data[:width] * (len(data) // width):
        return row | {"kind": "run", "blocks": [[data[:width]]], "cbytes": width}
    blocks = []
    for k, a in enumerate(range(0, len(data), blocksize)):
        if old and k not in touched:
            blocks.append(old[k])
            continue
        raw = data[a : a + blocksize]
        done = filters.forward(raw, stack, width, data[:blocksize], a == 0)
        streams = width if split and len(raw) == blocksize else 1  # a short last block is never split
        size = len(done) // streams
        blocks.append([_stream(params.codec, params.level, done[i * size : (i + 1) * size]) for i in range(streams)])
    total = sum(len(s) for b in blocks for s in b)
    if total < len(data):
        return row | {"kind": "packed", "blocks": blocks, "cbytes": total}
    return row | {"kind": "stored", "blocks": [[data[a : a + blocksize]] for a in range(0, len(data), blocksize)], "cbytes": len(data)}


def decode_chunk(row: dict, first: int = 0, last: int | None = None) -> tuple[int, bytes]:
    """The bytes of a chunk from the block that holds byte `first` to the one that holds the byte before `last`, and where they begin.

    Only those blocks are decoded, and the chunk's first block where a delta refers to it.
    """
    size, step = row["nbytes"], row["blocksize"]
    last = size if last is None else min(last, size)
    if row["kind"] == "run":
        a = first // row["typesize"] * row["typesize"]
        return a, row["blocks"][0][0] * (-(-(last - a) // row["typesize"]))
    low, high = first // step, -(-last // step)
    if row["kind"] == "stored":
        return low * step, b"".join(b[0] for b in row["blocks"][low:high])
    stack = filters.checked(list(zip(row["filters"], row["meta"], strict=True)))

    def block(k: int, reference: bytes) -> bytes:
        n = min(step, size - k * step)
        streams = row["blocks"][k]
        return filters.backward(b"".join(_plain(row["codec"], s, n // len(streams)) for s in streams), stack, row["typesize"], reference, k == 0)

    reference = block(0, b"") if low and stack and stack[0][0] == "delta" else b""
    out = []
    for k in range(low, high):
        out.append(block(k, reference))
        if k == 0:
            reference = out[0]
    return low * step, b"".join(out)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ARROW)


def encode(values: DataFrame, size: int, params: ChunkParams | None = None, pos: str = "pos", value: str = "value", item: str = "double") -> DataFrame:
    """(pos, value) -> CHUNKS of `size` items; item: a SQL type of ITEMS.  Positions are dense, values not null.

    Without params those of the session count.
    """
    params = params or ChunkParams.from_conf(values.sparkSession)
    width = np.dtype(ITEMS[item]).itemsize
    blocksize, split = params.layout(values.sparkSession, width, size * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filters.joined(batches, size, size):  # one chunk
            yield _rows([encode_chunk(c, d, width, params, blocksize, split) for c, d in zip(batch.column("chunk_id").to_pylist(), batch.column("data").to_pylist(), strict=True)])

    return filters.fragments(values, size, item, pos, value).mapInArrow(run, CHUNKS)


def decode(chunks: DataFrame, size: int, first: int | None = None, count: int | None = None, item: str = "double") -> DataFrame:
    """(pos, value) of chunks of the item type they were encoded with; with first and count only the blocks that the item range meets are decoded."""
    kind = np.dtype(ITEMS[item])
    width = kind.itemsize
    if first is not None:
        chunks = chunks.where((F.col("chunk_id") >= first // size) & (F.col("chunk_id") <= (first + count - 1) // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filters.pieces(batches):
            for row in batch.to_pylist():
                base = row["chunk_id"] * size
                low, high = (0, row["n"]) if first is None else (max(0, first - base), min(row["n"], first + count - base))
                at, raw = decode_chunk(row, low * width, high * width)
                x = np.frombuffer(raw, kind)[low - at // width : high - at // width]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, low + len(x)) + base, pa.int64()), pa.array(x)], names=["pos", "value"])

    return chunks.mapInArrow(run, f"pos long, value {item}")


def update_items(chunks: DataFrame, patch: DataFrame, size: int, item: str = "double") -> DataFrame:
    """CHUNKS with the values of patch (pos, new) in place: of chunks that it meets only the blocks with changed items are
    encoded again, all of them where the first block of a delta changes; other chunks pass as they are."""
    kind = np.dtype(ITEMS[item])
    width = kind.itemsize
    changes = patch.selectExpr(f"pos div {size} AS chunk_id", f"pos % {size} AS place", f"CAST(new AS {item}) AS new")
    met = changes.select("chunk_id").distinct()

    def change(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return ARROW.empty_table()
        row = left.to_pylist()[0]
        at = right.column("place").to_numpy()
        x = np.frombuffer(decode_chunk(row)[1], kind).copy()
        real = at < len(x)
        x[at[real]] = right.column("new").to_numpy()[real].astype(kind)
        touched = frozenset((at[real] * width // row["blocksize"]).tolist())
        params = ChunkParams(row["codec"], row["level"], row["blocksize"], filters=tuple(row["filters"]), meta=tuple(row["meta"]))
        stack = filters.checked(params.stack)
        alone = row["kind"] == "packed" and not (stack and stack[0][0] == "delta" and 0 in touched)
        again = encode_chunk(row["chunk_id"], x.tobytes(), width, params, row["blocksize"], any(len(b) > 1 for b in row["blocks"]), row["blocks"] if alone else None, touched)
        return pa.Table.from_batches([_rows([again])])

    inside = chunks.join(met, "chunk_id", "left_semi").groupBy("chunk_id").cogroup(changes.groupBy("chunk_id")).applyInArrow(change, CHUNKS)
    return chunks.join(met, "chunk_id", "left_anti").unionByName(inside)


def recoded(chunks: DataFrame, params: ChunkParams, size: int) -> DataFrame:
    """CHUNKS under other parameters; level 0 without filters gives stored chunks (and runs)."""
    widths = [r["typesize"] for r in chunks.select("typesize").distinct().limit(256).collect()]
    layouts = {w: params.layout(chunks.sparkSession, w, size * w) for w in widths}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filters.pieces(batches):
            yield _rows([encode_chunk(r["chunk_id"], decode_chunk(r)[1], r["typesize"], params, *layouts[r["typesize"]]) for r in batch.to_pylist()])

    return chunks.mapInArrow(run, CHUNKS)


def headers(chunks: DataFrame) -> DataFrame:
    """What each chunk says of itself, without its payload: sizes, blocks, codec and format, filters, kind."""
    blocks = F.ceil(F.col("nbytes") / F.col("blocksize")).cast("long")
    pairs = [F.lit(x) for name, code in CODECS.items() for x in (name, FORMATS[code])]
    return chunks.select("chunk_id", "nbytes", "cbytes", "typesize", "blocksize", blocks.alias("nblocks"), (F.col("nbytes") - (blocks - 1) * F.col("blocksize")).alias("leftover"), "codec", F.create_map(*pairs)[F.col("codec")].alias("format"), "filters", "kind")


def ratio(chunks: DataFrame) -> DataFrame:
    """One row: nbytes, cbytes and their ratio, 0.0 where nothing is kept."""
    total = chunks.agg(F.coalesce(F.sum("nbytes"), F.lit(0)).alias("nbytes"), F.coalesce(F.sum("cbytes"), F.lit(0)).alias("cbytes"))
    return total.withColumn("ratio", F.when(F.col("cbytes") == 0, 0.0).otherwise(F.col("nbytes") / F.col("cbytes")))


def expand_special(chunks: DataFrame) -> DataFrame:
    """(chunk_id, kind zero|nan|value|uninit, n, item) -> (chunk_id, pos, value)."""
    value = F.when(F.col("kind") == "nan", F.lit(float("nan"))).when(F.col("kind") == "value", F.col("item")).otherwise(F.lit(0.0))
    return chunks.where("n > 0").select("chunk_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos"), value.alias("value"))
