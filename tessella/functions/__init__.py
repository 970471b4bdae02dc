"""Column expressions: grids, block sizes, bit fields, coordinates."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

# Codec codes and formats, split modes, filter codes.
CODECS = {"lz4": 1, "lz4hc": 2, "zlib": 4, "zstd": 5}
FORMATS = {1: 1, 2: 1, 4: 3, 5: 4}
SPLIT_MODES = {"always": 1, "never": 2, "auto": 3, "forward": 4}
FILTERS = {"nofilter": 0, "none": 0, "shuffle": 1, "bitshuffle": 2, "delta": 3, "truncprec": 4, "trunc_prec": 4}
#: Item types by their SQL names, as NumPy's.
ITEMS = {"tinyint": "<i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8"}


def parse_name(name: str, table: dict[str, int]) -> int:
    """A code by its name, in any case."""
    try:
        return table[name.lower()]
    except KeyError:
        raise ValueError(f"unknown name: {name}") from None


@F.pandas_udf(LongType())
def double_bits(x: pd.Series) -> pd.Series:
    """IEEE bits of doubles as longs."""
    return pd.Series(x.to_numpy("float64").view("int64"))


@F.pandas_udf(DoubleType())
def bits_double(x: pd.Series) -> pd.Series:
    return pd.Series(x.to_numpy("int64").view("float64"))


@F.pandas_udf(LongType())
def float_bits(x: pd.Series) -> pd.Series:
    """IEEE bits of floats as non-negative longs."""
    return pd.Series(x.to_numpy("float32").view("uint32").astype("int64"))


@F.pandas_udf(DoubleType())
def bits_float(x: pd.Series) -> pd.Series:
    return pd.Series(x.to_numpy("int64").astype("uint32").view("float32").astype("float64"))


def div(a: Column, n: int | Column) -> Column:
    """Integer quotient of non-negative longs, exact for all of them."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.call_function("div", a.cast("long"), n.cast("long"))


def byte_of(bits: Column, j: Column) -> Column:
    return F.call_function("shiftright", bits, (8 * j).cast("int")).bitwiseAND(255)


def truncation_mask(prec_bits: int, mantissa: int) -> int | None:
    """Mask that keeps prec_bits mantissa bits (negative: drops as many); None: values pass through."""
    zeroed = mantissa - prec_bits if prec_bits >= 0 else -prec_bits
    return None if abs(prec_bits) > mantissa or zeroed >= mantissa else ~((1 << zeroed) - 1)


def should_split(codec: Column, level: Column, mode: Column, typesize: Column, blocksize: Column, shuffled: Column) -> Column:
    """Whether a block's bytes go into one stream per byte of the item."""
    fits = codec.isin(0, 1) | ((codec == 5) & (level <= 5))
    auto = fits & shuffled & (typesize <= 128) & (div(blocksize, typesize) >= 128)
    return F.when(mode == 1, True).when(mode == 2, False).otherwise(auto)


def automatic_blocksize(codec: Column, level: Column, mode: Column, typesize: Column, nbytes: Column, shuffled: Column) -> Column:
    """Block size for a chunk when none is asked for."""
    high = codec.isin(2, 4, 5)
    base = F.when(high, 65536).otherwise(32768)
    by_level = F.when(level == 0, base / 4).when(level == 1, base / 2).when(level == 2, base).when(level == 3, base * 2).when(level.isin(4, 5), base * 4).when(level.isin(6, 7, 8), base * 8).otherwise(base * F.when(high, 16).otherwise(8))
    plain = F.when(nbytes >= 32768, by_level).otherwise(nbytes)
    wide = F.when(level <= 3, 32).when(level <= 6, 64).when(level == 7, 128).when(level == 8, 256).otherwise(512) * 1024 * typesize
    split = F.least(F.greatest(wide, F.lit(32768)), F.lit(4 << 20))
    chosen = F.least(F.when((level > 0) & should_split(codec, level, mode, typesize, nbytes, shuffled), split).otherwise(plain), nbytes).cast("long")
    return F.when(nbytes < typesize, F.lit(1).cast("long")).otherwise(F.when(chosen > typesize, div(chosen, typesize) * typesize).otherwise(chosen))


def zstd_level_of(level: int) -> int:
    """zstd_level() of a number."""
    return 2 * level - 1 if level < 9 else 22


def zstd_level(level: Column) -> Column:
    """The library's level for a level 0..9; 0 becomes its fast level -1."""
    return F.when(level < 9, 2 * level - 1).otherwise(22)


def stream_count(split: Column, leftover: Column, typesize: Column) -> Column:
    """Streams of a block; the short last block is never split."""
    return F.when(split & ~leftover, typesize).otherwise(1)


def ravel(index: list[Column], shape: list[int]) -> Column:
    """Row-major position of an index."""
    return reduce(lambda acc, x: acc * x[1] + x[0], zip(index, shape, strict=True), F.lit(0).cast("long"))


def unravel(position: Column, shape: list[int]) -> list[Column]:
    out: list[Column] = []
    for size in reversed(shape):
        out.insert(0, position % size)
        position = div(position, size)
    return out


def extended(chunk: list[int], block: list[int]) -> list[int]:
    """Chunk shape rounded up to whole blocks."""
    return [-(-c // b) * b for c, b in zip(chunk, block, strict=True)]


def chunk_and_offset(index: list[Column], shape: list[int], chunk: list[int], block: list[int]) -> tuple[Column, Column]:
    """Chunk number of a cell and its block-major place in the chunk."""
    grid = [-(-s // c) for s, c in zip(shape, chunk, strict=True)]
    blocks = [e // b for e, b in zip(extended(chunk, block), block, strict=True)]
    within = [i % c for i, c in zip(index, chunk, strict=True)]
    number = ravel([div(i, c) for i, c in zip(index, chunk, strict=True)], grid)
    size = reduce(lambda a, b: a * b, block, 1)
    return number, ravel([div(w, b) for w, b in zip(within, block, strict=True)], blocks) * size + ravel([w % b for w, b in zip(within, block, strict=True)], block)
