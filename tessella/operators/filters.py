"""Filters of binary blocks: byte and bit transpose, XOR delta and precision truncation, and stacks of up to six of them.

A stack is a list of (name, meta): shuffle and bitshuffle take an item width as meta (0: the blocks' own), truncprec the
number of mantissa bits (negative: how many to drop), delta none.  Stacks run in order, and in reverse order backwards;
truncation has no inverse.  Items have 1 to 255 bytes; a ragged tail is copied.

Spark deals blocks out and keeps those of a chunk together where a delta needs the chunk's first block; the functions on
bytes are NumPy views and copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.functions import FILTERS, ITEMS, parse_name, truncation_mask

Stack = list[tuple[str, int]]
MOST_FILTERS = 6
#: Bytes of rows that Python handles at once, about; Spark's own batches may be of 10,000 rows and 64 MB.
PIECE_BYTES = 2 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of about PIECE_BYTES, of one row at least: what Python makes of a piece does not grow with the table."""
    for batch in batches:
        rows = max(1, PIECE_BYTES * batch.num_rows // max(1, batch.nbytes))
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
        del batch


def shuffled(data: bytes, width: int, back: bool = False) -> bytes:
    """Byte transpose of whole items."""
    n = len(data) // width
    x = np.frombuffer(data, np.uint8, n * width)
    x = x.reshape(width, n) if back else x.reshape(n, width)
    return x.T.tobytes() + data[n * width :]


def bitshuffled(data: bytes, width: int, back: bool = False) -> bytes:
    """Bit transpose of the first n - n % 8 items; the others are copied."""
    m = len(data) // width // 8 * 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, m * width), bitorder="little")
    bits = bits.reshape(8 * width, m) if back else bits.reshape(m, 8 * width)
    return np.packbits(bits.T, bitorder="little").tobytes() + data[m * width :]


def delta_width(width: int) -> int:
    """Bytes that a delta treats as one word."""
    return width if width in (1, 2, 4, 8) else 8 if width % 8 == 0 else 1


def deltaed(data: bytes, width: int, reference: bytes, first: bool, back: bool = False) -> bytes:
    """XOR with the word before in a chunk's first block, elsewhere with that block (the reference)."""
    w = delta_width(width)
    x = np.frombuffer(data, np.uint8)
    if not first:
        n = min(len(x), len(reference))
        return (x[:n] ^ np.frombuffer(reference, np.uint8, n)).tobytes() + data[n:]
    n = len(x) // w * w
    words = x[:n].reshape(-1, w)
    if back:
        return np.bitwise_xor.accumulate(words, axis=0).tobytes() + data[n:]
    return np.concatenate([words[:1], words[1:] ^ words[:-1]]).tobytes() + data[n:]


def truncated(data: bytes, width: int, bits: int) -> bytes:
    """Low mantissa bits of floats and doubles set to zero; other widths pass through."""
    mask = truncation_mask(bits, {4: 23, 8: 52}[width]) if width in (4, 8) else None
    if mask is None:
        return data
    n = len(data) // width * width
    kind = np.dtype(f"<u{width}")
    return (np.frombuffer(data, kind, n // width) & np.array(mask & (256**width - 1), kind)).tobytes() + data[n:]


def checked(stack: Stack) -> Stack:
    """The stack's active filters; ValueError for one that could not be undone."""
    if len(stack) > MOST_FILTERS:
        raise ValueError("at most six filters")
    active = [(name.lower(), meta) for name, meta in stack if parse_name(name, FILTERS)]
    if any(FILTERS[name] == FILTERS["delta"] for name, _ in active[1:]):
        raise ValueError("delta must be the first active filter")
    return active


def forward(data: bytes, stack: Stack, width: int, reference: bytes, first: bool) -> bytes:
    """One block through a checked stack; reference: the chunk's first block as it came."""
    for name, meta in stack:
        if name == "shuffle":
            data = shuffled(data, meta or width)
        elif name == "bitshuffle":
            data = bitshuffled(data, meta or width)
        elif name == "delta":
            data = deltaed(data, width, reference, first)
        else:
            data = truncated(data, width, meta)
    return data


def backward(data: bytes, stack: Stack, width: int, reference: bytes, first: bool) -> bytes:
    """Inverse of forward(), but for truncation; reference: the chunk's first block, decoded."""
    for name, meta in reversed(stack):
        if name == "shuffle":
            data = shuffled(data, meta or width, True)
        elif name == "bitshuffle":
            data = bitshuffled(data, meta or width, True)
        elif name == "delta":
            data = deltaed(data, width, reference, first, True)
    return data


def filtered(blocks: DataFrame, stack: Stack, width: int, back: bool = False) -> DataFrame:
    """(chunk_id, block_id, data) with every block through the stack; only a delta brings the blocks of a chunk together."""
    stack = checked(stack)
    step = backward if back else forward
    if any(name == "delta" for name, _ in stack):
        blocks = blocks.repartition("chunk_id").sortWithinPartitions("chunk_id", "block_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, reference = None, b""
        for batch in pieces(batches):
            out = []
            for c, data in zip(batch.column("chunk_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                first = c != chunk
                if first:
                    chunk, reference = c, data
                out.append(step(data, stack, width, reference, first))
                if first and back:
                    reference = out[-1]
            yield batch.set_column(batch.schema.get_field_index("data"), "data", pa.array(out, pa.binary()))

    return blocks.select("chunk_id", "block_id", "data").mapInArrow(run, "chunk_id long, block_id long, data binary")


def packed(values: DataFrame, chunk: int, block: int, item: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """(pos, value) -> (chunk_id, block_id, data): the items of each block as bytes; block ids count over all chunks.

    item: a SQL type of ITEMS, or "binary" for items that are binaries of one width.  Positions are dense, values not null;
    the block size divides the chunk size.
    """
    if chunk % block:
        raise ValueError("the block size must divide the chunk size")
    return fragments(values, chunk, item, pos, value).mapInArrow(lambda batches: joined(batches, chunk, block), "chunk_id long, block_id long, data binary")


def fragments(values: DataFrame, chunk: int, item: str, pos: str = "pos", value: str = "value") -> DataFrame:
    """(chunk_id, pos, n, data): items of neighbouring positions as one binary, those of a chunk together and in order.  What is shuffled is a row for each stretch, not for each item."""
    kind = None if item == "binary" else np.dtype(ITEMS[item])
    rows = values.selectExpr(f"{pos} AS pos", f"CAST({value} AS {item}) AS v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            at = batch.column("pos").to_numpy()
            raw = np.array(batch.column("v").to_pylist(), object) if kind is None else batch.column("v").to_numpy().astype(kind)
            if not (at[1:] > at[:-1]).all():
                order = np.argsort(at, kind="stable")
                at, raw = at[order], raw[order]
            cut = [0, *(np.flatnonzero((at[1:] != at[:-1] + 1) | (at[1:] % chunk == 0)) + 1).tolist(), len(at)] if len(at) else [0]
            first = at[cut[:-1]]
            data = [b"".join(raw[i:j]) if kind is None else raw[i:j].tobytes() for i, j in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(first // chunk), pa.array(first), pa.array(np.diff(cut)), pa.array(data, pa.binary())], names=["chunk_id", "pos", "n", "data"])

    return rows.mapInArrow(run, "chunk_id long, pos long, n long, data binary").repartition("chunk_id").sortWithinPartitions("chunk_id", "pos")


def joined(batches: Iterator[pa.RecordBatch], chunk: int, block: int) -> Iterator[pa.RecordBatch]:
    """The blocks of one chunk after the other from its fragments()."""
    now, held, items = None, [], 0

    def close() -> pa.RecordBatch:
        data = b"".join(held)
        step = block * (len(data) // items)
        out = [data[a : a + step] for a in range(0, len(data), step)]
        return pa.RecordBatch.from_arrays([pa.array([now] * len(out), pa.int64()), pa.array([now * (chunk // block) + k for k in range(len(out))], pa.int64()), pa.array(out, pa.binary())], names=["chunk_id", "block_id", "data"])

    for batch in pieces(batches):
        for c, n, data in zip(*(batch.column(k).to_pylist() for k in ("chunk_id", "n", "data")), strict=True):
            if c != now:
                if held:
                    yield close()
                now, held, items = c, [], 0
            held.append(data)
            items += n
    if held:
        yield close()


def unpacked(blocks: DataFrame, block: int, item: str, width: int = 0) -> DataFrame:
    """Inverse of packed(): (pos, value); width: of binary items."""
    kind = None if item == "binary" else np.dtype(ITEMS[item])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data = batch.column("data").to_pylist()
            if kind is None:
                values = pa.array([d[i : i + width] for d in data for i in range(0, len(d), width)], pa.binary())
            else:
                values = pa.array(np.frombuffer(b"".join(data), kind))
            size = [len(d) // (width or kind.itemsize) for d in data]
            first = np.repeat(batch.column("block_id").to_numpy() * block - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if data else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(values)), pa.int64()), values], names=["pos", "value"])

    return blocks.select("block_id", "data").mapInArrow(run, f"pos long, value {item}")


def bytes_of(blocks: DataFrame) -> DataFrame:
    """(block_id, out_pos, v): a row for each byte of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for b, d in zip(batch.column("block_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), b), pa.int64()), pa.array(np.arange(len(d)), pa.int64()), pa.array(np.frombuffer(d, np.uint8).astype(np.int64))], names=["block_id", "out_pos", "v"])

    return blocks.select("block_id", "data").mapInArrow(run, "block_id long, out_pos long, v long")
