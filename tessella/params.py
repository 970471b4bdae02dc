"""Compression parameters with validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessella.functions import CODECS, FILTERS, SPLIT_MODES, automatic_blocksize, parse_name, should_split
from tessella.operators.filters import Stack, checked


@dataclass(frozen=True)
class ChunkParams:
    """How chunks are encoded; operators take these from their caller or, by from_conf(), from the session."""

    codec: str = "zstd"
    level: int = 5
    blocksize: int = 0
    splitmode: str = "forward"
    filters: tuple[str, ...] = ("shuffle",)
    #: Meta values of the filters, zeros where left out.
    meta: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        parse_name(self.codec, CODECS)
        parse_name(self.splitmode, SPLIT_MODES)
        if not 0 <= self.level <= 9:
            raise ValueError("level must be within 0..9")
        if self.blocksize < 0:
            raise ValueError("blocksize must not be negative")
        if len(self.meta) > len(self.filters):
            raise ValueError("more meta values than filters")
        checked(self.stack)

    @property
    def stack(self) -> Stack:
        return list(zip(self.filters, (*self.meta, *[0] * (len(self.filters) - len(self.meta))), strict=True))

    def layout(self, spark: SparkSession, typesize: int, nbytes: int) -> tuple[int, bool]:
        """Block size in bytes, a multiple of the item width, and whether a block's bytes go into one stream per byte of the item."""
        if not 1 <= typesize <= 255:
            raise ValueError("typesize must be within 1..255")
        fixed = [F.lit(parse_name(self.codec, CODECS)), F.lit(self.level), F.lit(parse_name(self.splitmode, SPLIT_MODES)), F.lit(typesize)]
        shuffled = F.lit("shuffle" in [f.lower() for f in self.filters])
        size = F.lit(min(self.blocksize, nbytes) // typesize * typesize or typesize) if self.blocksize else automatic_blocksize(*fixed, F.lit(nbytes), shuffled)
        row = spark.range(1).select(size.cast("long").alias("b")).select("b", should_split(*fixed, F.col("b"), shuffled).alias("s")).first()
        return max(typesize, row["b"]), row["s"]

    @classmethod
    def from_conf(cls, spark: SparkSession) -> ChunkParams:
        """Defaults of a session: spark.conf keys tessella.codec, tessella.level and so on; bad values raise."""
        get = lambda k, d: spark.conf.get(f"tessella.{k}", str(d))
        d = cls()
        return cls(get("codec", d.codec), int(get("level", d.level)), int(get("blocksize", d.blocksize)), get("splitmode", d.splitmode), tuple(x for x in get("filters", ",".join(d.filters)).split(",") if x), tuple(int(x) for x in get("meta", "").split(",") if x))
