"""Relational operators against NumPy and plain Python on small inputs."""

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tessella import functions as fn
from tessella.operators import blocks, chunks, container, filters, ndarray, varlen
from tessella.params import ChunkParams
from tessella.sources.chunk_tables import chunk_refs, read_chunks, read_layers, read_params, write_chunks


def words_of(spark, values):
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "pos long, bits long")


@pytest.fixture
def values():
    return np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 53)


WIDTHS = [1, 2, 4, 7, 8, 16, 255]
STACKS = [[("shuffle", 0)], [("bitshuffle", 0)], [("delta", 0)], [("delta", 0), ("shuffle", 0)], [("delta", 0), ("bitshuffle", 0)], [("nofilter", 0), ("shuffle", 0), ("bitshuffle", 1), ("shuffle", 3), ("bitshuffle", 0), ("shuffle", 0)], []]


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("size", [0, 1, 3, 100, 1003])
def test_stacks_invert(width, size):
    data = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8).tobytes()
    ref = np.random.default_rng(7).integers(0, 256, max(0, size - 2)).astype(np.uint8).tobytes()
    for stack in STACKS:
        for first in (True, False):
            known = data if first else ref
            there = filters.forward(data, stack, width, known, first)
            assert len(there) == size
            back = filters.backward(there, stack, width, b"" if first else ref, first)
            assert back == data


def test_transposes_by_their_definition():
    data = bytes(range(1, 92))
    n, width = 13, 7
    assert filters.shuffled(data, width) == bytes(data[i * width + j] for j in range(width) for i in range(n))
    bit = lambda i, k: data[i * width + k // 8] >> (k % 8) & 1
    want = bytes(sum(bit(i, k) << i for i in range(8)) for k in range(8 * width)) + data[8 * width :]
    assert filters.bitshuffled(data, width) == want


def test_delta_of_wide_items_goes_by_words_of_eight():
    data = np.random.default_rng(1).integers(0, 256, 64).astype(np.uint8)
    got = np.frombuffer(filters.deltaed(data.tobytes(), 16, b"", True), np.uint8)
    assert (got[:8] == data[:8]).all() and (got[8:] == data[8:] ^ data[:-8]).all()
    got = np.frombuffer(filters.deltaed(data.tobytes(), 7, b"", True), np.uint8)
    assert (got[1:] == data[1:] ^ data[:-1]).all()


def test_stacks_that_cannot_be_undone_are_errors():
    for bad in ([("shuffle", 0), ("delta", 0)], [("nofilter", 0)] * 7, [("none such", 0)]):
        with pytest.raises(ValueError):
            filters.checked(bad)


@pytest.mark.parametrize("block", [1, 7, 16, 64])
def test_blocks_of_rows_and_back(spark, values, block):
    rows = words_of(spark, values)
    packed = filters.packed(rows, 4 * block, block, "bigint", value="bits")
    assert packed.count() == -(-53 // block)
    stack = [("delta", 0), ("shuffle", 0)]
    there = filters.filtered(packed, stack, 8)
    back = filters.unpacked(filters.filtered(there, stack, 8, back=True), block, "bigint").orderBy("pos").collect()
    assert [(r.pos, r.value) for r in back] == list(enumerate(values.tolist()))


def test_delta_inverts_and_first_block_is_running(spark, values):
    d = blocks.delta_encoded(words_of(spark, values), 32, 8)
    rows = {r.pos: r.d for r in d.collect()}
    assert rows[0] == values[0] and rows[1] == values[1] ^ values[0] and rows[8] == values[8] ^ values[0]
    assert rows[32] == values[32]
    back = blocks.delta_decoded(d, 32, 8).orderBy("pos").collect()
    assert [r.bits for r in back] == values.tolist()


def test_truncation_mask():
    assert fn.truncation_mask(0, 52) is None
    assert fn.truncation_mask(60, 52) is None
    assert fn.truncation_mask(52, 52) == ~0
    assert fn.truncation_mask(-4, 52) == ~15


def test_params_reject_bad_values():
    for bad in ({"codec": "none such"}, {"level": 10}, {"meta": (1, 2)}, {"blocksize": -1}, {"splitmode": "99"}, {"filters": ("shuffle", "delta")}, {"filters": ("nofilter",) * 7}):
        with pytest.raises(ValueError):
            ChunkParams(**bad)
    assert ChunkParams(codec="ZSTD", filters=("delta", "shuffle")).level == 5


def test_layouts(spark):
    assert ChunkParams(blocksize=2048).layout(spark, 8, 8192) == (2048, True)
    assert ChunkParams("zlib", blocksize=1000).layout(spark, 7, 8192) == (994, False)
    assert ChunkParams(blocksize=100).layout(spark, 8, 8192) == (96, False)  # under 128 items
    assert ChunkParams(blocksize=3).layout(spark, 8, 8192)[0] == 8
    for bad in (0, 256):
        with pytest.raises(ValueError):
            ChunkParams().layout(spark, bad, 100)


def test_zstd_levels():
    assert [fn.zstd_level_of(i) for i in range(10)] == [-1, 1, 3, 5, 7, 9, 11, 13, 15, 22]
    r = np.random.default_rng(2)
    lines = [r.integers(0, 256, 20).astype(np.uint8).tobytes() for _ in range(300)]
    data = b"".join(lines[i] for i in r.integers(0, 300, 8000))
    assert [chunks.pack("zstd", level, data) for level in (0, 9)] == [zstandard.ZstdCompressor(level=level).compress(data) for level in (-1, 22)]


@pytest.mark.parametrize("codec", ["zlib", "zstd", "lz4", "lz4hc"])
@pytest.mark.parametrize("delta", [False, True])
def test_chunk_roundtrip_keeps_bits(spark, codec, delta):
    x = [0.0, -0.0, float("nan"), float("inf"), 1e-320, 3.5] * 9
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "pos long, value double")
    params = ChunkParams(codec, blocksize=40, filters=("delta", "shuffle") if delta else ("shuffle",))
    back = chunks.decode(chunks.encode(rows, 16, params), 16).orderBy("pos").collect()
    assert np.array([r.value for r in back]).tobytes() == np.array(x).tobytes()


@pytest.mark.parametrize("item", sorted(fn.ITEMS))
def test_chunk_roundtrip_of_item_types(spark, item):
    x = [0, 1, -1, 127, -128, 5] * 7
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "pos long, value long")
    back = chunks.decode(chunks.encode(rows, 16, ChunkParams(filters=("delta", "shuffle")), item=item), 16, item=item)
    assert back.schema["value"].dataType.simpleString() == item
    assert [r.value for r in back.orderBy("pos").collect()] == x


@pytest.mark.parametrize("filters_", [("shuffle",), ("delta", "bitshuffle"), ("truncprec", "shuffle"), ()])
def test_chunk_kinds_slices_and_updates(spark, filters_):
    r = np.random.default_rng(5)
    x = np.concatenate([np.full(64, 2.5), np.arange(64) // 8, r.random(64), np.arange(20) % 3]).astype(float)
    params = ChunkParams("lz4", blocksize=64, filters=filters_, meta=(20,) if filters_[:1] == ("truncprec",) else ())
    kept = np.frombuffer(filters.truncated(x.tobytes(), 8, 20), float) if params.meta else x
    done = chunks.encode(spark.createDataFrame(list(enumerate(x.tolist())), "pos long, value double"), 64, params)
    kinds = {k.chunk_id: k.kind for k in done.collect()}
    assert kinds[0] == "run" and kinds[1] == "packed" and (kinds[2] == "stored" or params.meta)
    assert [v.value for v in chunks.decode(done, 64).orderBy("pos").collect()] == kept.tolist()
    for first, count in ((0, 5), (60, 80), (130, 1), (190, 40)):
        assert [(v.pos, v.value) for v in chunks.decode(done, 64, first, count).orderBy("pos").collect()] == [(i, kept[i]) for i in range(first, min(first + count, len(x)))]
    patch = {3: 1.0, 70: -4.0, 127: 9.0, 128: 0.5, 211: 7.0, 500: 1.0}
    after = chunks.update_items(done, spark.createDataFrame(list(patch.items()), "pos long, new double"), 64)
    assert [v.value for v in chunks.decode(after, 64).orderBy("pos").collect()] == [patch.get(i, v) for i, v in enumerate(kept.tolist())]
    plain = chunks.recoded(done, ChunkParams("zstd", 0, filters=()), 64)
    assert {k.kind for k in plain.collect()} == {"run", "stored"}
    assert [v.value for v in chunks.decode(plain, 64).orderBy("pos").collect()] == kept.tolist()


def test_slices_decode_only_their_blocks():
    data = np.arange(64).tobytes()
    row = chunks.encode_chunk(0, data, 8, ChunkParams("zlib", filters=("shuffle",)), 64, False)
    row["blocks"][5] = [b"broken"]
    assert chunks.decode_chunk(row, 130, 140) == (128, data[128:192])
    with pytest.raises(Exception):
        chunks.decode_chunk(row)


def test_array_metadata(spark):
    meta = ndarray.ArrayMeta((5, 7), (3, 4), (3, 2), "<u2")
    assert (meta.rank, meta.nitems, meta.chunk_nitems, meta.nchunks) == (2, 35, 12, 4)
    for bad in (((), (), ()), ((5,), (3, 4), (3,)), ((0,), (1,), (1,)), ((5,), (2,), (3,)), ((1,) * 16,) * 3):
        with pytest.raises(ValueError):
            ndarray.ArrayMeta(*bad)
    meta.check_box([1, 2], [4, 6])
    for bad in (([1], [4]), ([1, 2], [1, 6]), ([0, 0], [6, 7]), ([-1, 0], [1, 1])):
        with pytest.raises(ValueError):
            meta.check_box(*bad)
    layers = meta.layer(spark)
    four = spark.range(4).withColumnRenamed("id", "chunk_id")
    assert ndarray.wrapped(four, layers) == meta
    for chunks_, known in ((four.limit(3), layers), (four, layers.limit(0))):
        with pytest.raises(ValueError):
            ndarray.wrapped(chunks_, known)


def test_layers(spark):
    for kind, name in (("fixed", ""), ("fixed", "x" * 32), ("other", "x")):
        with pytest.raises(ValueError):
            container.layer(spark, kind, name, b"")
    layers = container.layer(spark, "fixed", "author", b"a").unionByName(container.layer(spark, "vl", "author", b"b"))
    layers = container.upsert_layers(layers, container.layer(spark, "vl", "author", b"c"))
    assert bytes(container.read_layer(layers, "author", "fixed").first().content) == b"a"
    assert bytes(container.read_layer(layers, "author", "vl").first().content) == b"c"
    assert container.remove_layer(layers, "author", "vl").count() == 1 and container.read_layer(layers, "none").first() is None


def test_appended_blocks(spark):
    one, two = (varlen.packed(spark.createDataFrame(list(enumerate(x)), "block_id long, data binary"), 2) for x in ([b"a", b"bb", b"c"], [b"dd", b"e"]))
    both = varlen.append(one, two)
    assert [(r.block_id, bytes(r.data)) for r in varlen.unpacked(both).orderBy("block_id").collect()] == list(enumerate([b"a", b"bb", b"c", b"dd", b"e"]))
    assert [r.chunk_id for r in both.orderBy("chunk_id").collect()] == [0, 1, 2]
    assert varlen.append(one.limit(0), two).count() == 1
    with pytest.raises(ValueError):
        varlen.append(one, varlen.compressed(two))


@pytest.mark.parametrize("codec", ["zlib", "zstd", "lz4"])
def test_compressed_blocks(spark, codec):
    data = [b"", b"a", b"red " * 50] + [f"line {i} of a long list of lines which are alike; ".encode() * 9 for i in range(60)]
    packed = varlen.packed(spark.createDataFrame([*enumerate(data), (len(data), None)], "block_id long, data binary"), 64)
    for trained in {False, codec == "zstd"}:
        done = varlen.compressed(packed, codec, dictionary=trained)
        assert any(r.dictionary for r in done.collect()) == trained
        assert [bytes(r.data) for r in varlen.decompressed(done).orderBy("block_id").collect()] == [*data, b""]
        assert bytes(varlen.decompressed(done, 7, 64).first().data) == data[7]
    with pytest.raises(ValueError):
        varlen.compressed(packed, "lz4", dictionary=True)


def test_offsets_over_several_groups(spark, monkeypatch):
    monkeypatch.setattr(container, "OFFSET_GROUP", 3)
    sizes = spark.range(10).select(F.col("id").alias("chunk_id"), (F.col("id") + 1).alias("nbytes"))
    assert [r.start for r in container.offsets(sizes).orderBy("chunk_id").collect()] == [i * (i + 1) // 2 for i in range(10)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "pos long, value double")
    assert chunks.decode(chunks.encode(none, 16), 16).count() == 0
    assert chunks.update_items(chunks.encode(none, 16), none.withColumnRenamed("value", "new"), 16).count() == 0
    assert chunks.ratio(chunks.encode(none, 16)).first().ratio == 0.0
    assert filters.filtered(filters.packed(none, 16, 4, "double"), [("delta", 0)], 8).count() == 0
    assert container.totals(spark.createDataFrame([], "chunk_id long, nbytes long")).first().nchunks == 0


def test_container_changes(spark):
    rows = container.chunks_of(spark.range(10).select(F.col("id").alias("pos"), F.col("id").cast("double").alias("value")), 4)
    listed = lambda df: [(r.chunk_id, r.pos, r.value) for r in df.orderBy("chunk_id", "pos").collect()]
    one = spark.createDataFrame([(0, 99.0)], "pos long, value double")
    assert [x[0] for x in listed(container.insert(rows, 1, one))] == [0] * 4 + [1] + [2] * 4 + [3] * 2
    assert [x[2] for x in listed(container.delete(rows, 0))] == [4, 5, 6, 7, 8, 9]
    assert [x[2] for x in listed(container.update(rows, 2, one))][-1] == 99
    order = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "new_id long, old_id long")
    assert [x[2] for x in listed(container.reorder(rows, order))] == [8, 9, 0, 1, 2, 3, 4, 5, 6, 7]
    assert [x[0] for x in listed(container.append(rows, rows))][-2:] == [5, 5]


def test_chunk_ranges(spark):
    sizes = spark.createDataFrame([(0, 4), (1, 6), (2, 2)], "chunk_id long, nbytes long")
    ask = lambda a, n: tuple(container.chunk_range(sizes, a, n).first())
    assert ask(2, 4) == (0, 2)
    assert ask(4, 6) == (1, 2)
    assert ask(12, 0) == (3, 3)
    blobs = spark.createDataFrame([(0, 4, b"aaaa"), (1, 6, b"bbbbbb"), (2, 2, b"cc")], "chunk_id long, nbytes long, data binary")
    assert [bytes(r.part) for r in container.byte_slice(blobs, 3, 8).orderBy("chunk_id").collect()] == [b"a", b"bbbbbb", b"c"]


def test_varlen_slices(spark):
    data = [b"red\0", b"green-green\0", b"blue-blue-blue-blue\0"]
    packed = varlen.packed(spark.createDataFrame(list(enumerate(data)), "block_id long, data binary"), 3)
    parts = varlen.byte_slices(packed, 2, 16).orderBy("block_id").collect()
    assert b"".join(bytes(p.part) for p in parts) == b"".join(data)[2:18]
    assert bytes(varlen.block(packed, 3, 1).first().data) == data[1]


def test_nd_layout_slice_and_resize(spark):
    cells = spark.createDataFrame([(i // 7, i % 7, i) for i in range(35)], "i0 long, i1 long, value long")
    got = {(r.chunk_id, r.place): r.value for r in ndarray.layout(cells, [5, 7], [3, 4], [3, 2]).collect()}
    assert got[0, 0] == 0 and got[0, 6] == 2 and got[1, 0] == 4 and got[2, 0] == 21
    assert ndarray.box(cells, [1, 2], [4, 6]).count() == 12
    with pytest.raises(ValueError):
        ndarray.box(cells, [1, 2], [1, 6])
    grown = {(r.i0, r.i1): r.value for r in ndarray.resize(cells, [6, 4]).collect()}
    assert grown[5, 0] == 0 and grown[4, 3] == 31 and len(grown) == 24


def test_chunk_table_on_storage(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") / 3).alias("value"))
    path = str(tmp_path / "t")
    write_chunks(chunks.encode(rows, 4), path, {"size": "4"}, spark.createDataFrame([("author", b"x")], "name string, content binary"))
    assert read_params(spark, path) == {"size": "4"} and read_layers(spark, path).count() == 1
    assert chunk_refs(spark, path).count() == 250
    part = chunks.decode(read_chunks(spark, path, 10, 20), 4, 42, 30).orderBy("pos").collect()
    assert [r.pos for r in part] == list(range(42, 72))
    with pytest.raises(Exception):
        write_chunks(chunks.encode(rows, 4), path)


def test_python_holds_pieces_of_a_batch(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"chunk_id": list(range(100)), "pos": [16 * i for i in range(100)], "n": [16] * 100, "data": [bytes(128)] * 100})
    monkeypatch.setattr(filters, "PIECE_BYTES", 1000)
    got = list(filters.pieces(iter([batch, batch.slice(0, 0), batch.slice(0, 1)])))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch, batch.slice(0, 1)])) and max(p.nbytes for p in got) <= 1000
    parts = batch.set_column(0, "chunk_id", pa.array([i // 4 for i in range(100)]))
    chunks_of = list(filters.joined(iter([parts]), 64, 32))  # chunks go over the ends of pieces
    assert [b.to_pydict() for b in chunks_of] == [{"chunk_id": [c, c], "block_id": [2 * c, 2 * c + 1], "data": [bytes(256)] * 2} for c in range(25)]
