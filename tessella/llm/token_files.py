"""Token ids in Arrow stream files of fixed-size-list batches, for zero-copy random access.

A file is an Arrow IPC stream of record batches (ids: fixed_size_list<uint16 or uint32>[LENGTH], mask: fixed_size_list<bool>
[LENGTH]).  The ids of consecutive documents run on through a file; only its last sequence is padded, with mask false.
All batches but the last have BATCH sequences, so sequence k's batch and row follow by division, and a memory-mapped file
is read without a copy.

Documents are range-partitioned by id into buckets, each bucket is sorted and written by one task as one file, and a
manifest table (doc_id, bucket, file, first id's place in the file, number of ids) is committed by Spark: a file left by
a lost or repeated attempt has a name of its own and is in no manifest.  A bucket's first global place is the sum of the
buckets before it, one row each, summed up in two levels.

Cases: a null or empty text has only the end id; repeated rows each get ids, rows with the same id in any order; rows
with a null id come first; an empty table gives no file.
"""

from __future__ import annotations

import os
import string
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm._common import id_and_text, shared_dir, slices

LENGTH, BATCH, END = 2048, 64, 1
DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Bytes of text of one file, about.
BUCKET_BYTES = 16 << 20
#: Buckets whose first places one task sums up.
SUM_GROUP = 4096
#: Parts of words that are remembered before the older ones are let go, those not seen since, and how many the library gets in one call.
MOST_CACHED, CALL = 150_000, 4000
#: Punctuation that is cut from behind a word of letters.
TAIL = string.punctuation
#: The one letter whose lower case is two characters.
DOTTED = "İ"
#: Rows and bytes of text encoded at once.
PIECE = 10_000, 4 << 20
MANIFEST = "doc_id long, bucket int, file string, place long, n_tokens long"


class WordEncoder:
    """Encodes texts with the tokenizers library; what stands between ASCII white space is encoded once and remembered.

    The tokenizer drops white space and never joins characters across it, so a text's ids are those of its words.  It also
    cuts letters from punctuation and lower-cases them, so a word of letters with punctuation behind has the ids of the
    letters in lower case, then those of the punctuation.  Many such letter sequences are encoded in one call, whose ids
    are cut behind each id that ends a word.

    A batch's distinct words are found, cut and put back in their places by Arrow; Python sees each once.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread memory of its own
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        if len(words) < 2:
            return self._one_by_one(words)
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(words):  # one of them is cut further
            half = len(words) // 2
            return self._together(words[:half]) + self._together(words[half:])
        raw, size = ids.tobytes(), self.dtype.itemsize
        at = [0, *(cut * size).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _ids(self, parts: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of each of some distinct parts of words."""
        keys = parts.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, keys))
        if None in found:
            letters = pc.and_not(pc.utf8_is_alpha(parts), pc.match_substring(parts, DOTTED)).to_numpy(zero_copy_only=False)
            pure, odd = [], []
            for k, alone, ids in zip(keys, letters.tolist(), found, strict=True):
                if ids is None:
                    if (old := self.older.get(k)) is not None:
                        self.known[k] = old
                    else:
                        (pure if alone else odd).append(k)
            for encode, new in ((self._together, pure), (self._one_by_one, odd)):
                for some in (new[i : i + CALL] for i in range(0, len(new), CALL)):
                    self.known.update(zip(some, encode(some), strict=True))
            found = list(map(self.known.__getitem__, keys))
        return pa.array(found, pa.large_binary())

    def _words(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of each of some distinct words."""
        core = pc.utf8_rtrim(words, TAIL)
        plain = pc.and_(pc.utf8_is_alpha(core), pc.and_not(pc.equal(pc.utf8_normalize(core, "NFC"), core), pc.match_substring(core, DOTTED)))
        cut = pc.and_(plain, pc.less(pc.binary_length(core), pc.binary_length(words)))
        behind = [w[n:] for w, n in zip(words.filter(cut).to_numpy(zero_copy_only=False), pc.utf8_length(core.filter(cut)).to_numpy(), strict=True)]
        heads = pc.if_else(plain, pc.utf8_lower(core), words).dictionary_encode()
        tails = pc.replace_with_mask(pa.repeat("", len(words)), cut, pa.array(behind, pa.string())).dictionary_encode()
        return pc.binary_join_element_wise(self._ids(heads.dictionary).take(heads.indices), self._ids(tails.dictionary).take(tails.indices), pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id behind it, and the number of ids of each text."""
        if len(self.known) > MOST_CACHED:
            self.older, self.known = self.known, {}
        split = pc.ascii_split_whitespace(texts.cast(pa.string()))
        words = split.flatten().dictionary_encode()
        ids = pa.concat_arrays([self._words(words.dictionary), pa.array([np.array([END], self.dtype).tobytes()], pa.large_binary())])
        ends = split.offsets.to_numpy()[1:]
        laid = ids.take(pa.array(np.insert(words.indices.to_numpy(), ends, len(words.dictionary))))
        _, offsets, raw = laid.buffers()
        until = np.frombuffer(offsets, np.int64)[ends + np.arange(1, len(ends) + 1)] // self.dtype.itemsize
        return np.frombuffer(raw, self.dtype)[: until[-1]], np.diff(until, prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def file_schema(dtype: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH))])


class SequenceWriter:
    """Appends ids to an Arrow stream of equal-length sequences."""

    def __init__(self, sink: pa.NativeFile, dtype: np.dtype):
        self.dtype, self.schema = dtype, file_schema(dtype)
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.held, self.size, self.place = [np.zeros(0, dtype)], 0, 0

    def append(self, ids: np.ndarray) -> int:
        """The place of the first id in the file."""
        at = self.place
        self.held.append(ids)
        self.size += len(ids)
        self.place += len(ids)
        if self.size >= LENGTH * BATCH:
            self._flush(False)
        return at

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held)
        whole = len(ids) // (LENGTH * BATCH) * LENGTH * BATCH
        for a in range(0, whole, LENGTH * BATCH):
            self._write(ids[a : a + LENGTH * BATCH], LENGTH * BATCH)
        rest = ids[whole:]
        self.held, self.size = [rest.copy()], len(rest)
        if last and len(rest):
            self._write(np.concatenate([rest, np.zeros(-len(rest) % LENGTH, self.dtype)]), len(rest))

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        self.stream.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), LENGTH), pa.FixedSizeListArray.from_arrays(mask, LENGTH)], schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.stream.close()


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a Hadoop path: S3 by any of Hadoop's names for it, HDFS, Azure, Google and local files."""
    kind, colon, rest = uri.partition(":")
    if not colon:
        return pafs.FileSystem.from_uri(f"file://{uri}")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(kind, kind) + ":" + rest)


class SequenceFile:
    """Random access to the ids of a written file; local files are memory-mapped."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        with pa.ipc.open_stream(source) as r:
            self.batches = list(r)
        self.flat = [b.column("ids").values.to_numpy(zero_copy_only=True) for b in self.batches]

    def ids(self, place: int, n: int) -> np.ndarray:
        """n ids from a place on, without a copy if they lie in one batch."""
        per, parts = LENGTH * BATCH, []
        while n > 0:
            k, a = divmod(place, per)
            part = self.flat[k][a : a + n]
            if not len(part):
                raise EOFError("the file ends before the ids asked for")
            parts.append(part)
            place, n = place + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def sequence(self, k: int) -> tuple[pa.Scalar, pa.Scalar]:
        """Ids and mask of sequence k."""
        b = self.batches[k // BATCH]
        return b.column("ids")[k % BATCH], b.column("mask")[k % BATCH]


def bucketed(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """rows in partitions of neighbouring ids (null first), sorted, of about bucket_bytes of text each; rows that share an id are told apart by their texts."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return rows.repartitionByRange(max(1, min(total[1], -(-total[0] // bucket_bytes))), *order).sortWithinPartitions(*order)


def write(docs: DataFrame, folder: str, path: str | None = None, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write docs' ids below folder/files and the manifest to folder/manifest; returns the manifest."""
    path = path or public_tokenizers.path(DEFAULT_TOKENIZER)
    spark = docs.sparkSession
    files = f"{folder}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("bucket", pa.int32()), ("file", pa.string()), ("place", pa.int64()), ("n_tokens", pa.int64())])
        enc, bucket, writer, sink, name = encoder(path), TaskContext.get().partitionId(), None, None, ""
        for batch in (piece for whole in batches for piece in slices(whole, *PIECE)):
            if writer is None:
                name = f"{files}/{bucket:06d}-{uuid.uuid4().hex}.arrow"
                fs, p = _filesystem(name)
                fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
                sink = fs.open_output_stream(p)
                writer = SequenceWriter(sink, enc.dtype)
            ids, n = enc.encode(batch.column("text"))
            place = writer.append(ids) + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.repeat(pa.scalar(bucket, pa.int32()), len(n)), pa.repeat(name, len(n)), pa.array(place, pa.int64()), pa.array(n, pa.int64())], schema=schema)
            del ids
            pa.default_memory_pool().release_unused()
        if writer:
            writer.close()
            sink.close()

    bucketed(id_and_text(docs), bucket_bytes).mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def firsts(manifest: DataFrame) -> DataFrame:
    """(bucket, first): the ids of all buckets before each, summed up in groups of SUM_GROUP buckets, then over the groups."""
    ends = manifest.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).withColumn("g", F.expr(f"bucket div {SUM_GROUP}"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = ends.groupBy("g").agg(F.sum("n").alias("n")).select("g", before(Window.orderBy("g")).alias("base"))
    inner = ends.withColumn("at", before(Window.partitionBy("g").orderBy("bucket")))
    return inner.join(groups, "g").select("bucket", (F.col("base") + F.col("at")).alias("first"))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every row, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            crc = []
            for f, p, n in zip(*(batch.column(k).to_pylist() for k in ("file", "place", "n_tokens")), strict=True):
                if f != name:
                    name, file = f, SequenceFile(f)
                crc.append(zlib.crc32(file.ids(p, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("bucket"), batch.column("place"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "bucket", "place", "n_tokens", "ids_crc32"])

    got = manifest.mapInArrow(run, "doc_id long, bucket int, place long, n_tokens long, ids_crc32 long")
    return got.join(firsts(manifest), "bucket").select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    return read(write(docs, shared_dir(docs.sparkSession), path))
