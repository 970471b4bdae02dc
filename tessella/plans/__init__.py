"""Registered queries over the driver tables and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import functions as fn
from tessella.functions import div
from tessella.operators import blocks, chunks, container, filters, ndarray, varlen
from tessella.params import ChunkParams

CHUNK, BLOCK = 1024, 256
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Parts of the DuckDB side: words and blocks of the event values.
_W = f"w AS (SELECT event_id AS i, CAST(CAST(value AS BIT) AS BIGINT) AS bits, event_id // {BLOCK} AS block_id, event_id % {BLOCK} AS item, event_id // {CHUNK} AS chunk_id FROM events), n AS (SELECT block_id, count(*) AS n FROM w GROUP BY 1)"
_SAME = "SELECT event_id AS pos, value FROM events"
_E = f"e AS (SELECT event_id // {CHUNK} AS chunk_id, event_id % {CHUNK} AS pos, value FROM events)"
_D = "d AS (SELECT doc_id, lang, text, octet_length(encode(coalesce(text, ''))) AS nbytes FROM documents)"


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), "value")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("pos", fn.double_bits("value").alias("bits"))


def _values(words: DataFrame) -> DataFrame:
    return words.select("pos", fn.bits_double("bits").alias("value"))


def _event_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container.chunks_of(_events(spark, sf_dir), CHUNK)


# --- grids and block transforms --------------------------------------------------------------------------------------


@query(f"SELECT event_id // {CHUNK} AS chunk_id, event_id // {BLOCK} AS block_id, count(*) AS n_items, min_by(value, event_id) AS first_value, max_by(value, event_id) AS last_value FROM events GROUP BY 1, 2")
def grid_events(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy(div(F.col("pos"), CHUNK).alias("chunk_id"), div(F.col("pos"), BLOCK).alias("block_id")).agg(F.count("*").alias("n_items"), F.min_by("value", "pos").alias("first_value"), F.max_by("value", "pos").alias("last_value"))


def _source(item: str, value: str, bits: str):
    """Items of the events of one width: (item type, Spark expression, DuckDB query of their bits)."""
    return item, value, f"SELECT event_id AS i, {bits} AS bits FROM events"


_ITEMS = {
    1: _source("tinyint", "user_id % 128", "user_id % 128"),
    2: _source("smallint", "user_id % 32768", "user_id % 32768"),
    4: _source("float", "value", "CAST(CAST(CAST(value AS FLOAT) AS BIT) AS INTEGER)::BIGINT & 4294967295"),
    8: _source("double", "value", "CAST(CAST(value AS BIT) AS BIGINT)"),
}


def _blocks(spark, sf_dir, width: int, block: int = BLOCK) -> DataFrame:
    item, value, _ = _ITEMS[width]
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.expr(value).alias("value"))
    return filters.packed(rows, CHUNK, block, item)


def _filters_sql(width: int, stack: filters.Stack, block: int = BLOCK) -> str:
    """Bytes of each block behind a stack whose transpose comes last, by arithmetic on the items' bits."""
    names, bits = [n for n, _ in stack], "bits"
    parts = [f"w AS (SELECT i, bits, i // {block} AS block_id, i % {block} AS item, i // {CHUNK} AS chunk_id FROM ({_ITEMS[width][2]}))", "n AS (SELECT block_id, count(*) AS n, count(*) - count(*) % 8 AS m FROM w GROUP BY 1)"]
    if "delta" in names:
        bits = f"CASE WHEN i % {CHUNK} < {block} THEN xor(bits, coalesce(lag(bits) OVER (PARTITION BY chunk_id ORDER BY i), 0)) ELSE xor(bits, max(CASE WHEN i % {CHUNK} < {block} THEN bits END) OVER (PARTITION BY chunk_id, item)) END"
    parts.append(f"d AS (SELECT i, block_id, item, {bits} AS bits FROM w)")
    for name, meta in stack:
        if name == "truncprec":
            parts.append(f"t AS (SELECT i, block_id, item, bits & {fn.truncation_mask(meta, {4: 23, 8: 52}[width]) & (-1 if width == 8 else 0xFFFFFFFF)} AS bits FROM d)")
    last = parts[-1][0]
    if "bitshuffle" not in names:
        place = "j * n.n + item" if "shuffle" in names else f"item * {width} + j"
        return f"WITH {', '.join(parts)} SELECT block_id, {place} AS out_pos, (bits >> (8 * j)) & 255 AS v FROM {last} JOIN n USING (block_id), range({width}) t(j)"
    head = f"SELECT block_id, k * (m // 8) + item // 8 AS out_pos, CAST(sum(((bits >> k) & 1) << (item % 8)) AS BIGINT) AS v FROM {last} JOIN n USING (block_id), range({8 * width}) t(k) WHERE item < m GROUP BY 1, 2"
    return f"WITH {', '.join(parts)} {head} UNION ALL SELECT block_id, item * {width} + j AS out_pos, (bits >> (8 * j)) & 255 AS v FROM {last} JOIN n USING (block_id), range({width}) t(j) WHERE item >= m"


def _filtered(name: str, width: int, stack: filters.Stack, block: int = BLOCK) -> None:
    def run(spark, sf_dir):
        return filters.bytes_of(filters.filtered(_blocks(spark, sf_dir, width, block), stack, width))

    run.__name__ = name
    query(_filters_sql(width, stack, block))(run)


for _name, _width, _stack, _block in (
    ("shuffle_events", 8, [("shuffle", 0)], BLOCK),
    ("bitshuffle_events", 8, [("bitshuffle", 0)], BLOCK),
    ("pipeline_delta_shuffle", 8, [("delta", 0), ("shuffle", 0)], BLOCK),
    ("pipeline_delta_bitshuffle", 8, [("delta", 0), ("bitshuffle", 0)], BLOCK),
    ("pipeline_trunc_shuffle", 8, [("truncprec", 20), ("shuffle", 0)], BLOCK),
    ("pipeline_delta_trunc_shuffle", 8, [("delta", 0), ("nofilter", 0), ("truncprec", 20), ("shuffle", 0)], BLOCK),
    ("filters_w1_bitshuffle", 1, [("bitshuffle", 0)], BLOCK),
    ("filters_w1_delta", 1, [("delta", 0)], BLOCK),
    ("filters_w2_shuffle", 2, [("shuffle", 0)], BLOCK),
    ("filters_w2_delta_bitshuffle", 2, [("delta", 0), ("bitshuffle", 0)], BLOCK),
    ("filters_w4_trunc_shuffle", 4, [("truncprec", 10), ("shuffle", 0)], BLOCK),
    ("filters_w4_delta_shuffle", 4, [("delta", 0), ("shuffle", 0)], BLOCK),
    ("filters_w4_bitshuffle_tails", 4, [("bitshuffle", 0)], 128),
):
    _filtered(_name, _width, _stack, _block)


def _ragged(spark, sf_dir) -> DataFrame:
    """Items of seven bytes, in blocks of 100 items, which eight does not divide."""
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.expr("substring(unhex(md5(CAST(event_id AS STRING))), 1, 7)").alias("value"))
    return filters.packed(rows, 1000, 100, "binary")


_HEX = "(strpos('0123456789abcdef', substr(h, {0}, 1)) - 1)"
_BYTE7 = f"16 * {_HEX.format('2 * j + 1')} + {_HEX.format('2 * j + 2')}"
_SEVEN = "h AS (SELECT event_id AS i, event_id // 100 AS block_id, event_id % 100 AS item, md5(CAST(event_id AS VARCHAR)) AS h FROM events), n AS (SELECT block_id, count(*) AS n, count(*) - count(*) % 8 AS m FROM h GROUP BY 1)"


@query(f"WITH {_SEVEN} SELECT block_id, j * n.n + item AS out_pos, CAST({_BYTE7} AS BIGINT) AS v FROM h JOIN n USING (block_id), range(7) t(j)")
def filters_w7_shuffle(spark, sf_dir):
    return filters.bytes_of(filters.filtered(_ragged(spark, sf_dir), [("shuffle", 0)], 7))


@query(f"WITH {_SEVEN}, b AS (SELECT i, block_id, item, n.m, j, CAST({_BYTE7} AS BIGINT) AS v FROM h JOIN n USING (block_id), range(7) t(j)) SELECT block_id, (8 * j + k) * (m // 8) + item // 8 AS out_pos, CAST(sum(((v >> k) & 1) << (item % 8)) AS BIGINT) AS v FROM b, range(8) t(k) WHERE item < m GROUP BY 1, 2 UNION ALL SELECT block_id, item * 7 + j AS out_pos, v FROM b WHERE item >= m")
def filters_w7_bitshuffle(spark, sf_dir):
    return filters.bytes_of(filters.filtered(_ragged(spark, sf_dir), [("bitshuffle", 0)], 7))


@query("SELECT event_id AS pos, substr(md5(CAST(event_id AS VARCHAR)), 1, 14) AS value FROM events")
def filters_w7_back(spark, sf_dir):
    stack = [("delta", 0), ("shuffle", 0), ("bitshuffle", 1)]
    there = filters.filtered(_ragged(spark, sf_dir), stack, 7)
    return filters.unpacked(filters.filtered(there, stack, 7, back=True), 100, "binary", 7).select("pos", F.lower(F.hex("value")).alias("value"))


def _back(stack: filters.Stack):
    def run(spark, sf_dir):
        there = filters.filtered(_blocks(spark, sf_dir, 8), stack, 8)
        return filters.unpacked(filters.filtered(there, stack, 8, back=True), BLOCK, "double")

    return run


@query(_SAME)
def unshuffle_events(spark, sf_dir):
    return _back([("shuffle", 0)])(spark, sf_dir)


@query(_SAME)
def bitunshuffle_events(spark, sf_dir):
    return _back([("bitshuffle", 0)])(spark, sf_dir)


@query(_SAME)
def pipeline_roundtrip(spark, sf_dir):
    return _back([("delta", 0), ("shuffle", 0)])(spark, sf_dir)


_DELTA = f"d AS (SELECT i AS pos, w.block_id, w.item, CASE WHEN i % {CHUNK} < {BLOCK} THEN xor(bits, coalesce(lag(bits) OVER (PARTITION BY chunk_id ORDER BY i), 0)) ELSE xor(bits, max(CASE WHEN i % {CHUNK} < {BLOCK} THEN bits END) OVER (PARTITION BY chunk_id, item)) END AS d FROM w)"


@query(f"WITH {_W}, {_DELTA} SELECT pos, d FROM d")
def delta_events(spark, sf_dir):
    return blocks.delta_encoded(_words(spark, sf_dir), CHUNK, BLOCK)


@query(_SAME)
def delta_roundtrip(spark, sf_dir):
    return _values(blocks.delta_decoded(blocks.delta_encoded(_words(spark, sf_dir), CHUNK, BLOCK), CHUNK, BLOCK))


def _truncated(spark, sf_dir, prec: int) -> DataFrame:
    return _values(_words(spark, sf_dir).select("pos", F.col("bits").bitwiseAND(fn.truncation_mask(prec, 52)).alias("bits")))


def _truncated_sql(prec: int) -> str:
    return f"WITH {_W} SELECT i AS pos, CAST(CAST((bits & {fn.truncation_mask(prec, 52)}) AS BIT) AS DOUBLE) AS value FROM w"


@query(_truncated_sql(20))
def truncprec_f64_keep(spark, sf_dir):
    return _truncated(spark, sf_dir, 20)


@query(_truncated_sql(-20))
def truncprec_f64_drop(spark, sf_dir):
    return _truncated(spark, sf_dir, -20)


_CELLS = "c AS (SELECT vec_id AS i0, unnest(range(64)) AS i1, unnest(embedding) AS value FROM embeddings)"


def _cells(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "value")).select("i0", F.col("i1").cast("long").alias("i1"), "value")


@query(f"WITH {_CELLS} SELECT i0, i1, CAST(CAST(CAST((CAST(CAST(value AS BIT) AS INTEGER) & {fn.truncation_mask(10, 23)}) AS BIT) AS FLOAT) AS DOUBLE) AS value FROM c")
def truncprec_f32(spark, sf_dir):
    cells = _cells(spark, sf_dir).select("i0", "i1", fn.float_bits("value").alias("bits"))
    return cells.select("i0", "i1", fn.bits_float(F.col("bits").bitwiseAND(fn.truncation_mask(10, 23) & 0xFFFFFFFF)).alias("value"))


@query("SELECT event_id AS pos, value * 2.5 AS value FROM events")
def prefilter_scale(spark, sf_dir):
    scaled = _events(spark, sf_dir).withColumn("value", F.col("value") * 2.5)
    return chunks.decode(chunks.encode(scaled, CHUNK), CHUNK)


@query("SELECT event_id AS pos, value + 1.0 AS value FROM events")
def postfilter_offset(spark, sf_dir):
    return chunks.decode(chunks.encode(_events(spark, sf_dir), CHUNK), CHUNK).withColumn("value", F.col("value") + 1.0)


@query("SELECT doc_id // 64 AS block_id, min(toxic) = max(toxic) AS is_run, CAST(min(toxic) AS BIGINT) AS low FROM labels GROUP BY 1")
def run_detect_labels(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), F.col("toxic").cast("long").alias("bits"))
    return blocks.runs(labels, 64)


@query("SELECT CAST(p_size AS BIGINT) AS chunk_id, CAST(unnest(range(p_partkey % 4 + 1)) AS BIGINT) AS pos, CASE WHEN p_partkey % 3 = 0 THEN 0.0 WHEN p_partkey % 3 = 1 THEN p_retailprice ELSE 0.0 END AS value FROM part")
def special_values(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    kind = F.element_at(F.array(F.lit("zero"), F.lit("value"), F.lit("uninit")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return chunks.expand_special(p.select(F.col("p_size").cast("long").alias("chunk_id"), kind.alias("kind"), (F.col("p_partkey") % 4 + 1).alias("n"), F.col("p_retailprice").alias("item")))


# --- parameter grids -------------------------------------------------------------------------------------------------

_GRID_SQL = "g AS (SELECT c.codec, l.level, m.mode, t.typesize, b.nbytes FROM (VALUES (0), (1), (2), (4), (5)) c(codec), range(10) l(level), range(1, 5) m(mode), (VALUES (1), (2), (4), (7), (8), (16), (128), (255)) t(typesize), (VALUES (1), (100), (1000), (32767), (32768), (100000), (1048576), (10485760)) b(nbytes))"
_SPLIT_SQL = "CASE mode WHEN 1 THEN true WHEN 2 THEN false ELSE (codec IN (0, 1) OR (codec = 5 AND level <= 5)) AND typesize <= 128 AND {n} // typesize >= 128 END"
_SIZE_SQL = f"""s AS (SELECT *, CASE WHEN codec IN (2, 4, 5) THEN 65536 ELSE 32768 END AS base, {_SPLIT_SQL.format(n="nbytes")} AS split FROM g),
 t AS (SELECT *, CASE WHEN level > 0 AND split THEN least(greatest(typesize * 1024 * CASE WHEN level <= 3 THEN 32 WHEN level <= 6 THEN 64 WHEN level = 7 THEN 128 WHEN level = 8 THEN 256 ELSE 512 END, 32768), 4194304)
   WHEN nbytes < 32768 THEN nbytes
   ELSE CASE level WHEN 0 THEN base // 4 WHEN 1 THEN base // 2 WHEN 2 THEN base WHEN 3 THEN base * 2 WHEN 4 THEN base * 4 WHEN 5 THEN base * 4 WHEN 9 THEN base * 8 * (CASE WHEN codec IN (2, 4, 5) THEN 2 ELSE 1 END) ELSE base * 8 END END AS raw FROM s),
 u AS (SELECT *, least(raw, nbytes) AS b FROM t),
 z AS (SELECT *, CAST(CASE WHEN nbytes < typesize THEN 1 WHEN b > typesize THEN b // typesize * typesize ELSE b END AS BIGINT) AS blocksize FROM u)"""


def _grid(spark) -> DataFrame:
    values = {"codec": (0, 1, 2, 4, 5), "level": range(10), "mode": range(1, 5), "typesize": (1, 2, 4, 7, 8, 16, 128, 255), "nbytes": (1, 100, 1000, 32767, 32768, 100000, 1048576, 10485760)}
    grid = spark.range(1)
    for name, v in values.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(x).cast("long") for x in v])))
    return grid.drop("id")


def _sized(spark) -> DataFrame:
    return _grid(spark).withColumn("blocksize", fn.automatic_blocksize(*map(F.col, ("codec", "level", "mode", "typesize", "nbytes")), F.lit(True)))


@query(f"WITH {_GRID_SQL}, {_SIZE_SQL} SELECT CAST(codec AS BIGINT) AS codec, CAST(level AS BIGINT) AS level, CAST(mode AS BIGINT) AS mode, CAST(typesize AS BIGINT) AS typesize, CAST(nbytes AS BIGINT) AS nbytes, blocksize FROM z")
def blocksize_table(spark, sf_dir):
    return _sized(spark)


@query(f"WITH {_GRID_SQL}, {_SIZE_SQL}, q AS (SELECT CAST(codec AS BIGINT) AS codec, CAST(level AS BIGINT) AS level, CAST(mode AS BIGINT) AS mode, CAST(typesize AS BIGINT) AS typesize, CAST(nbytes AS BIGINT) AS nbytes, blocksize, {_SPLIT_SQL.format(n='blocksize')} AS split FROM z) SELECT codec, level, mode, typesize, nbytes, split, CAST(CASE WHEN split AND nbytes % blocksize = 0 THEN typesize ELSE 1 END AS BIGINT) AS last_streams FROM q")
def split_decision(spark, sf_dir):
    split = fn.should_split(*map(F.col, ("codec", "level", "mode", "typesize", "blocksize")), F.lit(True))
    rows = _sized(spark).withColumn("split", split)
    streams = fn.stream_count(F.col("split"), F.col("nbytes") % F.col("blocksize") != 0, F.col("typesize"))
    return rows.select("codec", "level", "mode", "typesize", "nbytes", "split", streams.cast("long").alias("last_streams"))


# --- chunks ----------------------------------------------------------------------------------------------------------


def _params(codec: str, level: int = 5, delta: bool = False, blocksize: int = 0) -> ChunkParams:
    return ChunkParams(codec, level, blocksize, filters=("delta", "shuffle") if delta else ("shuffle",))


def _roundtrip(codec: str, level: int, delta: bool = False):
    def run(spark, sf_dir):
        return chunks.decode(chunks.encode(_events(spark, sf_dir), CHUNK, _params(codec, level, delta, 2048)), CHUNK)

    run.__name__ = f"roundtrip_{codec}" + "_delta" * delta
    return query(_SAME)(run)


for _codec in ("zlib", "zstd", "lz4", "lz4hc"):
    _roundtrip(_codec, 5)
_roundtrip("zstd", 9, delta=True)


def _typed_roundtrip(item: str, sql: str, width: str):
    """Items of other widths: user ids cut to the type's range, through delta and byte transpose."""

    def run(spark, sf_dir):
        rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.expr(sql).alias("value"))
        return chunks.decode(chunks.encode(rows, CHUNK, _params("zstd", 5, True), item=item), CHUNK, item=item).withColumn("value", F.col("value").cast(width))

    run.__name__ = f"roundtrip_{item}"
    return query(f"SELECT event_id AS pos, CAST({sql} AS {width}) AS value FROM events")(run)


_typed_roundtrip("tinyint", "user_id % 128", "bigint")
_typed_roundtrip("smallint", "user_id % 32768", "bigint")
_typed_roundtrip("int", "user_id % 2147483648", "bigint")
_typed_roundtrip("bigint", "user_id * 1000003", "bigint")


# Chunks of 1,024 items, every third of which holds one value only; stored ones have sizes that SQL can tell.
_MIXED_SQL = f"m AS (SELECT o_orderkey // {CHUNK} AS chunk_id, o_orderkey AS pos, CASE WHEN (o_orderkey // {CHUNK}) % 3 = 0 THEN 7.5 ELSE o_totalprice END AS value FROM orders), k AS (SELECT chunk_id, CAST(count(*) AS BIGINT) * 8 AS nbytes, min(value) = max(value) AND count(*) > 1 AS run FROM m GROUP BY 1), z AS (SELECT chunk_id, nbytes, CAST(CASE WHEN run THEN 8 ELSE nbytes END AS BIGINT) AS cbytes, CASE WHEN run THEN 'run' ELSE 'stored' END AS kind FROM k)"


def _mixed(spark, sf_dir) -> DataFrame:
    value = F.when(div(F.col("o_orderkey"), CHUNK) % 3 == 0, 7.5).otherwise(F.col("o_totalprice"))
    return chunks.encode(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), value.alias("value")), CHUNK, _params("zstd", 5, True, 2048))


def _stored(spark, sf_dir) -> DataFrame:
    return chunks.recoded(_mixed(spark, sf_dir), ChunkParams("lz4", 0, 2048, filters=()), CHUNK)


@query(f"WITH {_MIXED_SQL} SELECT chunk_id, run AS is_run, nbytes, true AS fits FROM k")
def chunk_kinds(spark, sf_dir):
    return _mixed(spark, sf_dir).select("chunk_id", (F.col("kind") == "run").alias("is_run"), "nbytes", (F.col("cbytes") <= F.col("nbytes")).alias("fits"))


@query(f"WITH {_MIXED_SQL} SELECT chunk_id, nbytes, cbytes, kind FROM z")
def chunk_stored(spark, sf_dir):
    return _stored(spark, sf_dir).select("chunk_id", "nbytes", "cbytes", "kind")


@query(f"WITH {_MIXED_SQL} SELECT pos, value FROM m")
def roundtrip_stored(spark, sf_dir):
    return chunks.decode(_stored(spark, sf_dir), CHUNK)


@query(f"WITH {_MIXED_SQL} SELECT chunk_id, cbytes, CAST(coalesce(sum(cbytes) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM z")
def packed_offsets(spark, sf_dir):
    return container.offsets(_stored(spark, sf_dir), "cbytes")


@query(f"WITH {_MIXED_SQL} SELECT CAST(sum(nbytes) AS BIGINT) AS nbytes, CAST(sum(cbytes) AS BIGINT) AS cbytes, sum(nbytes) / sum(cbytes) AS ratio FROM z")
def packed_ratio(spark, sf_dir):
    return chunks.ratio(_stored(spark, sf_dir))


@query(f"WITH {_MIXED_SQL} SELECT count(*) AS nchunks, CAST(sum(nbytes) AS BIGINT) AS nbytes, CAST(sum(cbytes) AS BIGINT) AS cbytes, count(DISTINCT CASE WHEN chunk_id < (SELECT max(chunk_id) FROM z) THEN nbytes END) > 1 AS variable FROM z")
def packed_totals(spark, sf_dir):
    return container.totals(_stored(spark, sf_dir))


@query(f"WITH {_MIXED_SQL} SELECT pos, CASE WHEN pos BETWEEN 1100 AND 1900 THEN -value WHEN pos = 5 THEN 1.25 ELSE value END AS value FROM m")
def update_items_blocks(spark, sf_dir):
    rows = _mixed(spark, sf_dir)
    patch = chunks.decode(rows, CHUNK, 1100, 801).select("pos", (-F.col("value")).alias("new")).unionByName(spark.range(1).selectExpr("5L AS pos", "1.25D AS new"))
    return chunks.decode(chunks.update_items(rows, patch, CHUNK), CHUNK)


@query(f"SELECT event_id // {CHUNK} AS chunk_id, 'zlib' AS codec, 3 AS format, 'bitshuffle' AS filters, CAST(1024 AS BIGINT) AS blocksize FROM events GROUP BY 1")
def conf_params(spark, sf_dir):
    session = spark.newSession()
    for k, v in (("codec", "zlib"), ("level", "6"), ("blocksize", "1024"), ("filters", "bitshuffle")):
        session.conf.set(f"tessella.{k}", v)
    found = chunks.headers(chunks.encode(_events(session, sf_dir), CHUNK))
    return found.select("chunk_id", "codec", F.col("format").cast("int").alias("format"), F.array_join("filters", ",").alias("filters"), "blocksize")


@query("SELECT * FROM (VALUES ('lz4', 1, 1), ('lz4hc', 2, 1), ('zlib', 4, 3), ('zstd', 5, 4)) t(codec, code, format)")
def codec_formats(spark, sf_dir):
    return spark.createDataFrame([(name, code, fn.FORMATS[code]) for name, code in fn.CODECS.items()], "codec string, code int, format int")


@query("SELECT vec_id * 64 + i AS pos, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(i)")
def roundtrip_float(spark, sf_dir):
    rows = _cells(spark, sf_dir).select((F.col("i0") * 64 + F.col("i1")).alias("pos"), "value")
    return chunks.decode(chunks.encode(rows, 4096, _params("lz4"), item="float"), 4096, item="float").withColumn("value", F.col("value").cast("double"))


@query("SELECT CAST(level AS BIGINT) AS level, CAST(CASE WHEN level < 9 THEN 2 * level - 1 ELSE 22 END AS BIGINT) AS zstd_level FROM range(10) t(level)")
def zstd_level_map(spark, sf_dir):
    return spark.range(10).select(F.col("id").alias("level"), fn.zstd_level(F.col("id")).cast("long").alias("zstd_level"))


@query(f"WITH c AS (SELECT event_id // {CHUNK} AS chunk_id, count(*) * 8 AS nbytes FROM events GROUP BY 1) SELECT chunk_id, nbytes, 8 AS typesize, CAST(2048 AS BIGINT) AS blocksize, (nbytes + 2047) // 2048 AS nblocks, nbytes - ((nbytes + 2047) // 2048 - 1) * 2048 AS leftover, 'zstd' AS codec, 4 AS format, 'delta,shuffle' AS filters, true AS fits FROM c")
def header_fields(spark, sf_dir):
    found = chunks.headers(chunks.encode(_events(spark, sf_dir), CHUNK, _params("zstd", 5, True, 2048)))
    return found.select("chunk_id", "nbytes", "typesize", "blocksize", "nblocks", "leftover", "codec", F.col("format").cast("int").alias("format"), F.array_join("filters", ",").alias("filters"), (F.col("cbytes") <= F.col("nbytes")).alias("fits"))


@query("SELECT event_id AS pos, value FROM events WHERE event_id BETWEEN 500 AND 1799")
def getitem_range(spark, sf_dir):
    return chunks.decode(chunks.encode(_events(spark, sf_dir), CHUNK, _params("zstd", 5, False, 2048)), CHUNK, 500, 1300)


@query("SELECT event_id AS pos, value FROM events WHERE event_id BETWEEN 500 AND 1799")
def getitem_range_delta(spark, sf_dir):
    return chunks.decode(chunks.encode(_events(spark, sf_dir), CHUNK, _params("lz4", 5, True, 1024)), CHUNK, 500, 1300)


@query(_SAME.replace("event_id AS pos, value FROM events", "o_orderkey AS pos, o_totalprice AS value FROM orders"))
def roundtrip_orders(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("value"))
    return chunks.decode(chunks.encode(orders, 4096, _params("zstd", 3)), 4096)


# --- variable-length blocks ------------------------------------------------------------------------------------------


def _doc_chunks(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), F.encode("text", "UTF-8").alias("data"))
    return varlen.packed(docs, 32)


@query("SELECT doc_id AS block_id, coalesce(text, '') AS text FROM documents")
def vl_roundtrip_documents(spark, sf_dir):
    return varlen.unpacked(_doc_chunks(spark, sf_dir)).select("block_id", F.decode("data", "UTF-8").alias("text"))


@query("SELECT doc_id AS block_id, coalesce(text, '') AS text FROM documents")
def vl_compress_documents(spark, sf_dir):
    return varlen.decompressed(varlen.compressed(_doc_chunks(spark, sf_dir), "zlib")).select("block_id", F.decode("data", "UTF-8").alias("text"))


@query("SELECT doc_id AS block_id, text FROM documents WHERE doc_id = 77")
def vl_decompress_block(spark, sf_dir):
    return varlen.decompressed(varlen.compressed(_doc_chunks(spark, sf_dir), "lz4"), 77, 32).select("block_id", F.decode("data", "UTF-8").alias("text"))


@query("SELECT page_id AS block_id, coalesce(html, '') AS html FROM pages")
def roundtrip_dict_zstd(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("block_id"), F.encode("html", "UTF-8").alias("data"))
    return varlen.decompressed(varlen.compressed(varlen.packed(pages, 32), dictionary=True)).select("block_id", F.decode("data", "UTF-8").alias("html"))


@query("SELECT doc_id // 32 AS chunk_id, count(*) AS n_blocks FROM documents GROUP BY 1")
def vl_block_count(spark, sf_dir):
    return _doc_chunks(spark, sf_dir).select("chunk_id", F.size("blocks").cast("long").alias("n_blocks"))


@query("SELECT doc_id AS block_id, text FROM documents WHERE doc_id = 77")
def vl_block_one(spark, sf_dir):
    return varlen.block(_doc_chunks(spark, sf_dir), 32, 77).select("block_id", F.decode("data", "UTF-8").alias("text"))


@query("SELECT doc_id AS block_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT (SELECT max(doc_id) FROM documents) + 1 + page_id, coalesce(html, '') FROM pages")
def vl_append_pages(spark, sf_dir):
    pages = varlen.packed(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("block_id"), F.encode("html", "UTF-8").alias("data")), 32)
    both = varlen.append(varlen.compressed(_doc_chunks(spark, sf_dir), "zlib"), varlen.compressed(pages, "zlib"))
    return varlen.decompressed(both).select("block_id", F.decode("data", "UTF-8").alias("text"))


@query("WITH p AS (SELECT doc_id // 32 AS chunk_id, doc_id AS block_id, lower(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents), q AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY chunk_id ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM p) SELECT chunk_id, block_id, CAST(substr(h, CAST(2 * greatest(1000 - a, 0) + 1 AS BIGINT), CAST(2 * (least(6000 - a, n) - greatest(1000 - a, 0)) AS BIGINT)) AS VARCHAR) AS part FROM q WHERE least(6000 - a, n) > greatest(1000 - a, 0)")
def getitem_vl(spark, sf_dir):
    return varlen.byte_slices(_doc_chunks(spark, sf_dir), 1000, 5000).select("chunk_id", "block_id", F.lower(F.hex("part")).alias("part"))


# --- container algebra -----------------------------------------------------------------------------------------------


@query(f"WITH {_E} SELECT * FROM e UNION ALL SELECT chunk_id + 1 + (SELECT max(chunk_id) FROM e), pos, value FROM (SELECT o_orderkey // {CHUNK} AS chunk_id, o_orderkey % {CHUNK} AS pos, o_totalprice AS value FROM orders)")
def append_chunks(spark, sf_dir):
    orders = container.chunks_of(_table(spark, sf_dir, "orders"), CHUNK, "o_orderkey", "o_totalprice")
    return container.append(_event_chunks(spark, sf_dir), orders)


def _new_chunk(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_acctbal").alias("value"))


_NEW = "SELECT CAST({at} AS BIGINT) AS chunk_id, c_custkey AS pos, c_acctbal AS value FROM customer"


@query(f"WITH {_E} SELECT CASE WHEN chunk_id >= 1 THEN chunk_id + 1 ELSE chunk_id END AS chunk_id, pos, value FROM e UNION ALL {_NEW.format(at=1)}")
def insert_chunk(spark, sf_dir):
    return container.insert(_event_chunks(spark, sf_dir), 1, _new_chunk(spark, sf_dir))


@query(f"WITH {_E} SELECT CASE WHEN chunk_id > 0 THEN chunk_id - 1 ELSE chunk_id END AS chunk_id, pos, value FROM e WHERE chunk_id <> 0")
def delete_chunk(spark, sf_dir):
    return container.delete(_event_chunks(spark, sf_dir), 0)


@query(f"WITH {_E} SELECT * FROM e WHERE chunk_id <> 0 UNION ALL {_NEW.format(at=0)}")
def update_chunk(spark, sf_dir):
    return container.update(_event_chunks(spark, sf_dir), 0, _new_chunk(spark, sf_dir))


@query(f"WITH {_E} SELECT (SELECT max(chunk_id) FROM e) - chunk_id AS chunk_id, pos, value FROM e")
def reorder_chunks(spark, sf_dir):
    rows = _event_chunks(spark, sf_dir)
    ids = rows.select("chunk_id").distinct()
    order = ids.select((rows.agg(F.max("chunk_id")).scalar() - F.col("chunk_id")).alias("new_id"), F.col("chunk_id").alias("old_id"))
    return container.reorder(rows, order)


@query(f"WITH {_E} SELECT * FROM e WHERE chunk_id = 0")
def read_chunk(spark, sf_dir):
    return _event_chunks(spark, sf_dir).where("chunk_id = 0")


@query(f"WITH {_E} SELECT chunk_id, pos, CASE WHEN {CHUNK} * chunk_id + pos BETWEEN 300 AND 899 THEN -value ELSE value END AS value FROM e")
def set_slice_events(spark, sf_dir):
    rows = _event_chunks(spark, sf_dir)
    patch = rows.where((F.col("chunk_id") * CHUNK + F.col("pos")).between(300, 899)).select("chunk_id", "pos", (-F.col("value")).alias("new"))
    return container.set_slice(rows, patch)


def _lang_sizes(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.groupBy(div(F.col("doc_id"), 64).alias("chunk_id")).agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("nbytes"))


_SIZES = f"{_D}, s AS (SELECT doc_id // 64 AS chunk_id, CAST(sum(nbytes) AS BIGINT) AS nbytes FROM d GROUP BY 1), o AS (SELECT *, CAST(coalesce(sum(nbytes) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM s)"


@query(f"WITH {_SIZES} SELECT chunk_id, nbytes, start FROM o")
def chunk_offsets_docs(spark, sf_dir):
    return container.offsets(_lang_sizes(spark, sf_dir))


@query(f"WITH {_SIZES} SELECT min(chunk_id) AS first_chunk, max(chunk_id) + 1 AS end_chunk FROM o WHERE start < 250000 AND start + nbytes > 100000")
def chunk_range_docs(spark, sf_dir):
    return container.chunk_range(_lang_sizes(spark, sf_dir), 100000, 150000)


@query(f"WITH {_SIZES} SELECT count(*) AS nchunks, CAST(sum(nbytes) AS BIGINT) AS nbytes, count(DISTINCT CASE WHEN chunk_id < (SELECT max(chunk_id) FROM s) THEN nbytes END) > 1 AS variable FROM s")
def container_totals(spark, sf_dir):
    return container.totals(_lang_sizes(spark, sf_dir))


@query("WITH p AS (SELECT item_id AS chunk_id, lower(hex(encode(text))) AS h, octet_length(encode(text)) AS n FROM benchmark), q AS (SELECT *, coalesce(sum(n) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM p) SELECT chunk_id, CAST(substr(h, CAST(2 * greatest(700 - a, 0) + 1 AS BIGINT), CAST(2 * (least(3200 - a, n) - greatest(700 - a, 0)) AS BIGINT)) AS VARCHAR) AS part FROM q WHERE a < 3200 AND a + n > 700")
def byte_slice_benchmark(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), F.octet_length("text").cast("long").alias("nbytes"), F.encode("text", "UTF-8").alias("data"))
    return container.byte_slice(b, 700, 2500).select("chunk_id", F.lower(F.hex("part")).alias("part"))


_LAYERS = "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS content FROM nation"


@query(f"SELECT name, content FROM ({_LAYERS}) WHERE name NOT IN (SELECT r_name FROM region) AND name NOT LIKE 'A%' UNION ALL SELECT n_name, 'new' FROM nation WHERE n_name LIKE 'A%' UNION ALL SELECT r_name, CAST(r_regionkey AS VARCHAR) FROM region")
def metalayer_upsert(spark, sf_dir):
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    layers = nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("content"))
    more = nation.where("n_name LIKE 'A%'").select(F.col("n_name").alias("name"), F.lit("new").alias("content")).unionByName(region.select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("content")))
    return container.upsert_layers(layers, more)


def _nation_layers(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, "fixed").otherwise("vl").alias("kind"), F.concat(F.lit("layer"), div(F.col("n_nationkey"), 2).cast("string")).alias("name"), F.col("n_name").alias("content"))


_KINDS = "l AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'fixed' ELSE 'vl' END AS kind, 'layer' || CAST(n_nationkey // 2 AS VARCHAR) AS name, n_name AS content FROM nation)"


@query(f"WITH {_KINDS} SELECT * FROM l WHERE name <> 'layer3'")
def metalayer_remove(spark, sf_dir):
    return container.remove_layer(_nation_layers(spark, sf_dir), "layer3")


@query(f"WITH {_KINDS} SELECT * FROM l WHERE NOT (name = 'layer3' AND kind = 'vl')")
def vl_metalayer_remove(spark, sf_dir):
    return container.remove_layer(_nation_layers(spark, sf_dir), "layer3", "vl")


@query(f"WITH {_KINDS} SELECT content FROM l WHERE name = 'layer3' AND kind = 'fixed'")
def metalayer_read(spark, sf_dir):
    return container.read_layer(_nation_layers(spark, sf_dir), "layer3", "fixed")


@query(f"WITH {_KINDS} SELECT content FROM l WHERE name = 'layer3' AND kind = 'vl'")
def vl_metalayer_read(spark, sf_dir):
    return container.read_layer(_nation_layers(spark, sf_dir), "layer3", "vl")


@query(f"WITH {_KINDS} SELECT kind, name, content FROM l WHERE NOT (name = 'layer3' AND kind = 'vl') UNION ALL SELECT 'vl', 'layer3', 'new' UNION ALL SELECT 'vl', 'another', 'more'")
def vl_metalayer_upsert(spark, sf_dir):
    more = container.layer(spark, "vl", "layer3", b"new").unionByName(container.layer(spark, "vl", "another", b"more"))
    return container.upsert_layers(_nation_layers(spark, sf_dir), more.withColumn("content", F.decode("content", "UTF-8")))


# --- N-dimensional arrays --------------------------------------------------------------------------------------------

_SHAPE = (1 << 31, 64)
_ND_CHUNK, _ND_BLOCK = [100, 24], [32, 8]


@query(f"WITH {_CELLS} SELECT (i0 // 100) * 3 + i1 // 24 AS chunk_id, (((i0 % 100) // 32) * 3 + (i1 % 24) // 8) * 256 + (i0 % 100 % 32) * 8 + (i1 % 24) % 8 AS place, CAST(value AS DOUBLE) AS value FROM c")
def nd_chunk_layout(spark, sf_dir):
    return ndarray.layout(_cells(spark, sf_dir), list(_SHAPE), _ND_CHUNK, _ND_BLOCK).withColumn("value", F.col("value").cast("double"))


@query(f"WITH {_CELLS} SELECT i0 - 10 AS i0, i1 - 5 AS i1, CAST(value AS DOUBLE) AS value FROM c WHERE i0 >= 10 AND i0 < 200 AND i1 >= 5 AND i1 < 60")
def nd_get_slice(spark, sf_dir):
    return ndarray.box(_cells(spark, sf_dir), [10, 5], [200, 60]).withColumn("value", F.col("value").cast("double"))


@query(f"WITH {_CELLS} SELECT i0, i1, CASE WHEN i0 < 50 AND i1 >= 32 THEN 0.5 ELSE CAST(value AS DOUBLE) END AS value FROM c")
def nd_set_slice(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("value", F.col("value").cast("double"))
    patch = cells.where("i0 < 50 AND i1 >= 32").select("i0", "i1", F.lit(0.5).alias("new"))
    return ndarray.set_box(cells, patch)


@query(f"WITH {_CELLS} SELECT r.i0, q.i1, coalesce(CAST(c.value AS DOUBLE), 0) AS value FROM range(600) r(i0) CROSS JOIN range(70) q(i1) LEFT JOIN c ON c.i0 = r.i0 AND c.i1 = q.i1")
def nd_resize(spark, sf_dir):
    return ndarray.resize(_cells(spark, sf_dir).withColumn("value", F.col("value").cast("double")), [600, 70])


@query("SELECT r AS case_no, 2 AS rank, CAST(s0 * s1 AS BIGINT) AS nitems, CAST(((c0 + b0 - 1) // b0) * b0 * ((c1 + b1 - 1) // b1) * b1 AS BIGINT) AS chunk_nitems, CAST(((s0 + c0 - 1) // c0) * ((s1 + c1 - 1) // c1) AS BIGINT) AS nchunks, s0 || 'x' || s1 AS shape, c0 || 'x' || c1 AS chunkshape, b0 || 'x' || b1 AS blockshape FROM (VALUES (0, 10, 20, 4, 5, 2, 5), (1, 5, 7, 3, 4, 3, 2), (2, 500, 64, 100, 24, 32, 8)) t(r, s0, s1, c0, c1, b0, b1)")
def nd_meta(spark, sf_dir):
    metas = [ndarray.ArrayMeta((10, 20), (4, 5), (2, 5)), ndarray.ArrayMeta((5, 7), (3, 4), (3, 2)), ndarray.ArrayMeta((500, 64), (100, 24), (32, 8))]
    rows = reduce(DataFrame.unionByName, [m.row(spark).withColumn("case_no", F.lit(i)) for i, m in enumerate(metas)])
    return rows.select("case_no", "rank", "nitems", "chunk_nitems", "nchunks", *[F.array_join(F.col(c).cast("array<string>"), "x").alias(c) for c in ("shape", "chunkshape", "blockshape")])


@query(f"WITH {_CELLS}, s AS (SELECT max(i0) + 1 AS rows FROM c) SELECT CAST(rows * 64 AS BIGINT) AS nitems, CAST(((rows + 99) // 100) * 3 AS BIGINT) AS nchunks, '<f4' AS dtype FROM s")
def nd_wrap(spark, sf_dir):
    """An array's shapes, read back from its container's layer and held against its chunks."""
    cells = _cells(spark, sf_dir)
    rows = cells.agg(F.max("i0") + 1).first()[0]
    meta = ndarray.ArrayMeta((rows, 64), tuple(_ND_CHUNK), tuple(_ND_BLOCK), "<f4")
    found = ndarray.wrapped(ndarray.layout(cells, list(meta.shape), _ND_CHUNK, _ND_BLOCK), meta.layer(spark))
    return found.row(spark).select("nitems", "nchunks", "dtype")


@query(f"WITH {_CELLS} SELECT i0 * 64 + i1 AS position, CAST(value AS DOUBLE) AS value FROM c")
def nd_roundtrip(spark, sf_dir):
    return ndarray.dense(_cells(spark, sf_dir), list(_SHAPE)).withColumn("value", F.col("value").cast("double"))


@query("SELECT (vec_id * 64 + i) // 1000 AS row, (vec_id * 64 + i) % 1000 AS place, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(i)")
def nd_unravel(spark, sf_dir):
    flat = ndarray.dense(_cells(spark, sf_dir), list(_SHAPE))
    row, place = fn.unravel(F.col("position"), [1 << 40, 1000])
    return flat.select(row.alias("row"), place.alias("place"), F.col("value").cast("double").alias("value"))


# --- storage and streams ---------------------------------------------------------------------------------------------


@query("SELECT event_id AS pos, value FROM events WHERE event_id BETWEEN 200 AND 2499")
def lazy_slice(spark, sf_dir):
    from tessella.sources.chunk_tables import read_chunks, write_chunks
    from tessella.storage import shared_folder

    path = shared_folder(spark)
    write_chunks(chunks.encode(_events(spark, sf_dir), 128), path, {"size": "128"})
    return chunks.decode(read_chunks(spark, path, 200 // 128, 2499 // 128), 128, 200, 2300)


@query(f"WITH {_MIXED_SQL} SELECT chunk_id, nbytes // 8 AS n, nbytes, cbytes, CAST(coalesce(sum(cbytes) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM z")
def lazy_chunk_refs(spark, sf_dir):
    from tessella.sources.chunk_tables import chunk_refs, write_chunks
    from tessella.storage import shared_folder

    path = shared_folder(spark)
    write_chunks(_stored(spark, sf_dir), path)
    return chunk_refs(spark, path).withColumn("n", F.col("n").cast("long"))


@query(f"WITH {_E} SELECT chunk_id, pos, value FROM e")
def stream_append(spark, sf_dir):
    from tessella.storage import shared_folder
    from tessella.streaming.append import append_stream

    path = shared_folder(spark)
    schema = _table(spark, sf_dir, "events").select("event_id", "value").schema
    return append_stream(spark, sf_dir, "events.parquet", schema, f"{path}/table", f"{path}/checkpoint", CHUNK, "event_id", "value")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values through delta, byte transpose and zstd and back; items and value range of each chunk."""
    back = chunks.decode(chunks.encode(_events(spark, sf_dir), CHUNK, _params("zstd", 5, True)), CHUNK)
    return back.groupBy(div(F.col("pos"), CHUNK).alias("chunk_id")).agg(F.count("*").alias("n_items"), F.min("value").alias("low"), F.max("value").alias("high"))
