"""Small helpers that all operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows and bytes handed to a function at once, the latter unless one row alone has more.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one where that is unset and everything runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
    return f"{root}/tessella-{uuid.uuid4().hex}"


def pinned(df: DataFrame, scratch: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors, has stable file splits.

    scratch: gets the path, for drop() once nothing reads it any more; codec: Parquet's, if not that of the session.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path, compression=codec)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, scratch: list[str]) -> None:
    """Remove the tables of a list and empty it."""
    while scratch:
        delete_path(spark, scratch.pop())


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def slices(batch: pa.RecordBatch, most_rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most most_rows rows and about most_bytes bytes."""
    rows = max(1, min(most_rows, most_bytes * batch.num_rows // max(1, batch.nbytes)))
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None], schema: str | StructType) -> DataFrame:
    """mapInArrow over bounded pieces of batches; fn returns a batch, a dict of columns or None."""
    arrow = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                if (out := fn(batch)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow) if isinstance(out, dict) else out

    return df.mapInArrow(run, schema)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
