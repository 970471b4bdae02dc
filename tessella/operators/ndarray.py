"""N-dimensional arrays as cells (i0, i1, ..., value), with their shapes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import chunk_and_offset, extended, ravel, unravel
from tessella.operators import container

MOST_AXES = 15
#: The layer that holds an array's shapes.
LAYER = "ndarray"


@dataclass(frozen=True)
class ArrayMeta:
    """Shapes and item type of an array; bad ones raise."""

    shape: tuple[int, ...]
    chunkshape: tuple[int, ...]
    blockshape: tuple[int, ...]
    dtype: str = "<f8"

    def __post_init__(self) -> None:
        if not 1 <= len(self.shape) <= MOST_AXES:
            raise ValueError(f"an array has 1 to {MOST_AXES} axes")
        if not len(self.shape) == len(self.chunkshape) == len(self.blockshape):
            raise ValueError("shape, chunk shape and block shape differ in rank")
        if min(*self.shape, *self.chunkshape, *self.blockshape) < 1:
            raise ValueError("every axis has at least one item")
        if any(b > c for b, c in zip(self.blockshape, self.chunkshape, strict=True)):
            raise ValueError("a block is larger than its chunk")

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def nitems(self) -> int:
        return prod(self.shape)

    @property
    def chunk_nitems(self) -> int:
        """Items of a chunk with the padding to whole blocks."""
        return prod(extended(list(self.chunkshape), list(self.blockshape)))

    @property
    def nchunks(self) -> int:
        return prod(-(-s // c) for s, c in zip(self.shape, self.chunkshape, strict=True))

    def check_box(self, start: list[int], stop: list[int]) -> None:
        """A ValueError unless start and stop are a box, not empty, within the array."""
        if not len(start) == len(stop) == self.rank:
            raise ValueError("the box differs in rank from the array")
        if any(not 0 <= a < b <= s for a, b, s in zip(start, stop, self.shape, strict=True)):
            raise ValueError("the box is empty or beyond the array")

    def row(self, spark: SparkSession) -> DataFrame:
        """One row with the shapes and the counts that follow from them."""
        out = asdict(self) | {"rank": self.rank, "nitems": self.nitems, "chunk_nitems": self.chunk_nitems, "nchunks": self.nchunks}
        return spark.createDataFrame([{k: list(v) if isinstance(v, tuple) else v for k, v in out.items()}], "shape array<long>, chunkshape array<long>, blockshape array<long>, dtype string, rank int, nitems long, chunk_nitems long, nchunks long")

    def layer(self, spark: SparkSession) -> DataFrame:
        return container.layer(spark, "fixed", LAYER, json.dumps(asdict(self)).encode())


def wrapped(chunks: DataFrame, layers: DataFrame) -> ArrayMeta:
    """The shapes of a container that holds an array; a ValueError if it has none or another number of chunks."""
    found = container.read_layer(layers, LAYER, "fixed").first()
    if not found:
        raise ValueError("the container has no array layer")
    known = json.loads(bytes(found["content"]))
    meta = ArrayMeta(tuple(known["shape"]), tuple(known["chunkshape"]), tuple(known["blockshape"]), known["dtype"])
    if chunks.select("chunk_id").distinct().count() != meta.nchunks:
        raise ValueError("the container has another number of chunks than the array")
    return meta


def axes(rank: int) -> list[str]:
    return [f"i{d}" for d in range(rank)]


def layout(cells: DataFrame, shape: list[int], chunk: list[int], block: list[int]) -> DataFrame:
    """Each cell's chunk and its block-major place there."""
    number, place = chunk_and_offset([F.col(a) for a in axes(len(shape))], shape, chunk, block)
    return cells.select(number.alias("chunk_id"), place.alias("place"), "value")


def box(cells: DataFrame, start: list[int], stop: list[int], meta: ArrayMeta | None = None) -> DataFrame:
    """The half-open box, counted from its own corner; the filter reaches the scan.  With meta, the box must lie within the array."""
    if meta:
        meta.check_box(start, stop)
    if any(a >= b for a, b in zip(start, stop, strict=True)):
        raise ValueError("the box is empty")
    names = axes(len(start))
    for n, a, b in zip(names, start, stop, strict=True):
        cells = cells.where((F.col(n) >= a) & (F.col(n) < b))
    return cells.select(*[(F.col(n) - a).alias(n) for n, a in zip(names, start, strict=True)], "value")


def set_box(cells: DataFrame, patch: DataFrame) -> DataFrame:
    """Values of patch (i0, ..., new) in place of those of its cells."""
    names = [c for c in patch.columns if c != "new"]
    return cells.join(patch, names, "left").select(*names, F.coalesce("new", "value").alias("value"))


def resize(cells: DataFrame, shape: list[int]) -> DataFrame:
    """The overlap with the new shape; new cells are zero."""
    names = axes(len(shape))
    grid = cells.sparkSession.range(prod(shape)).select(*[c.alias(n) for c, n in zip(unravel(F.col("id"), shape), names, strict=True)])
    return grid.join(cells, names, "left").select(*names, F.coalesce("value", F.lit(0)).alias("value"))


def dense(cells: DataFrame, shape: list[int]) -> DataFrame:
    """(position, value) in row-major order of the whole array."""
    return cells.select(ravel([F.col(a) for a in axes(len(shape))], shape).alias("position"), "value")
