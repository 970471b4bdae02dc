"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn exactly: the matrix with the partitions' row counts as
row sums and the shard sizes as column sums is drawn row by row from the multivariate hypergeometric law.  Each partition
then deals its own rows at random, as many to each shard as its matrix row says; the rows are exchanged and permuted
again inside each shard.  Any assignment with these sizes is equally likely.

The partition number of each row and its place there are written with it, so that a later pass, a repeated task or a
cluster of another size deals every row alike, however the files are split.  Whole rows, texts included, move to their
shards and are written there, one folder a shard; sizes and checksums of texts are those of the written shards.

The inner permutation is itself parallel: each shard's rows fall at random into cells of about CELL_ROWS rows, cells
are counted, and a row's slot is its cell's offset plus its rank in the cell by a random key.  The driver holds one count
per partition and shard.

Cases: null ids and texts are rows like any other (a null text has size 1); repeated rows each get a slot; an empty table
gives no rows; with fewer rows than shards some shards are empty; columns of df named as the two new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessella.llm._common import drop, pinned, shared_dir

CELL_ROWS = 10_000
#: Bits of Spark's row numbers that count rows of one partition.
PLACE_BITS = 33


def matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows to send from each partition to each shard; shard sizes differ by at most one."""
    rng = np.random.default_rng(seed)
    total = sum(rows)
    sizes = np.full(shards, total // shards, np.int64)
    sizes[rng.permutation(shards)[: total % shards]] += 1
    out, left = np.zeros((len(rows), shards), np.int64), sizes
    for i, n in enumerate(rows):
        out[i] = draw(rng, left, n)
        left = left - out[i]
    return out


def draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """n drawn without replacement from colours with counts left, by colour (any counts: numpy's limit is 10^9)."""
    out, rest, total = np.zeros(len(left), np.int64), n, int(left.sum())
    for k, have in enumerate(left.tolist()):
        total -= have
        if total + have < 10**9:
            got = int(rng.hypergeometric(have, total, rest)) if rest and have else 0
        else:
            got = _large(rng, have, total, rest)
        out[k] = got
        rest -= got
    return out


def _large(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw for populations beyond numpy's limit: inversion over all counts within 40 deviations."""
    low, high = max(0, n - bad), min(n, good)
    mean = n * good / (good + bad)
    wide = 40 * (mean * bad / (good + bad)) ** 0.5 + 40
    k = np.arange(max(low, int(mean - wide)), min(high, int(mean + wide)) + 1, dtype=np.float64)
    ratio = np.log((good - k[:-1]) * (n - k[:-1])) - np.log((k[:-1] + 1) * (bad - n + k[:-1] + 1))
    log = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.cumsum(np.exp(log - log.max()))
    return int(k[np.searchsorted(p, rng.random() * p[-1], side="right")])


def shuffle_into_shards(df: DataFrame, shards: int = 16, seed: int = 42, shard_col: str = "shard", slot_col: str = "slot", scratch: list[str] | None = None) -> DataFrame:
    """df's rows with two more columns: shard 0..shards-1 and slot, gapless from 0 in each shard; scratch: as for pinned()."""
    df = df.drop(shard_col, slot_col)
    names = df.columns
    tag = "_".join(["", *names])  # no column of df begins so
    row, cell, key, at, rank = (f"{tag}_{k}" for k in ("row", "cell", "key", "at", "rank"))
    # The upper bits of a row's number are its partition, the lower ones its place there.
    held = pinned(df.withColumn(row, F.monotonically_increasing_id()), scratch, "zstd")
    counts = {r["p"]: r["n"] for r in held.groupBy(F.shiftrightunsigned(row, PLACE_BITS).alias("p")).agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    sent = df.sparkSession.sparkContext.broadcast(dict(zip(parts, matrix([counts[p] for p in parts], shards, seed), strict=True)))
    cells = max(1, -(-sum(counts.values()) // (shards * CELL_ROWS)))
    drawn_fields = [StructField(shard_col, IntegerType()), StructField(cell, IntegerType()), StructField(key, LongType())]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, drawn = -1, []
        for batch in batches:
            number = batch.column(row).to_numpy()
            part, place = number >> PLACE_BITS, number & ((1 << PLACE_BITS) - 1)
            found = [np.empty(len(number), np.int64) for _ in range(3)]
            for p in np.unique(part).tolist():
                if p != known:
                    rng = np.random.default_rng([seed, p])
                    to = rng.permutation(np.repeat(np.arange(shards), sent.value[p]))
                    known, drawn = p, [to, rng.integers(0, cells, len(to)), rng.integers(0, 2**62, len(to))]
                mine = part == p
                for out, all_rows in zip(found, drawn, strict=True):
                    out[mine] = all_rows[place[mine]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (found[0].astype(np.int32), found[1].astype(np.int32), found[2]))], names=[*batch.schema.names, shard_col, cell, key])

    def dealt_out(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(deal, StructType([*rows.schema.fields, *drawn_fields]))

    # What is drawn hangs on the written numbers alone, so cells are counted without the other columns.
    before = Window.partitionBy(shard_col).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt_out(held.select(row)).groupBy(shard_col, cell).agg(F.count("*").alias(rank)).select(shard_col, cell, F.coalesce(F.sum(rank).over(before), F.lit(0)).alias(at))
    ranked = dealt_out(held).withColumn(rank, F.row_number().over(Window.partitionBy(shard_col, cell).orderBy(key)) - 1)
    return ranked.join(offsets, [shard_col, cell]).select(*[F.col(f"`{c}`") for c in names], shard_col, (F.col(at) + F.col(rank)).cast("long").alias(slot_col))


def sized(docs: DataFrame, *others: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), the text's unsigned CRC-32 and other columns of docs."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"), *others)


def write(docs: DataFrame, folder: str, shards: int = 16, seed: int = 42) -> DataFrame:
    """Write whole rows of docs below folder, as shard=0, shard=1 and so on; returns what is read from there: docs' columns, shard and slot."""
    scratch: list[str] = []
    out = shuffle_into_shards(docs, shards, seed, scratch=scratch)
    out.write.partitionBy("shard").parquet(folder, compression="zstd")
    drop(docs.sparkSession, scratch)
    return docs.sparkSession.read.schema(out.schema).parquet(folder)


def placed(docs: DataFrame, shards: int = 16, seed: int = 42, folder: str | None = None) -> DataFrame:
    """Where each document lies, with the size and checksum of its text as the written shards have it."""
    spark = docs.sparkSession
    out = write(docs, folder or shared_dir(spark), shards, seed)
    return sized(out, "shard", "slot").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
