"""Block signatures and deltas, uploads, and content-addressed archives."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.blocks import rolling_weak, weak_checksum

#: Fixed value: bytes in a block.
BLOCK_SIZE = 4096
#: Bytes of a client file whose windows are searched at a time.
PIECE = 1 << 20


def block_signatures(files: DataFrame, block: int = BLOCK_SIZE, signed: bool = True) -> DataFrame:
    """file_key, block_no, offset, data, strong and weak of every block of ``files`` (file_key, content: binary).

    The last block may be short; an empty or null content has none. Without ``signed`` the checksums are left out.
    """
    n = F.ceil(F.octet_length("content") / block).cast("int")
    cut = lambda i: F.substring(F.col("content"), i * block + 1, F.lit(block))
    rows = files.where(F.octet_length("content") > 0).select("file_key", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), cut)).alias("block_no", "data"))
    rows = rows.withColumn("offset", F.col("block_no").cast("long") * block)
    return rows.withColumns({"strong": F.sha2("data", 256), "weak": weak_checksum("data")}) if signed else rows


def delta_plan(client: DataFrame, base: DataFrame) -> DataFrame:
    """file_key, offset, length, kind, base_offset, data: each client block as a hit in its base file or a miss with data.

    A block that the base holds more than once stands for its last offset. Equal digests have equal checksums, so the digest
    alone is joined on and no checksum is computed here. A client of keys alone (file_key, offset, length, strong) gives a plan without
    data, whose misses ``miss_data`` fetches: where most blocks are hits, far fewer bytes move.
    """
    known = base.groupBy("file_key", "strong").agg(F.max("offset").alias("base_offset"))
    joined = client.join(known, ["file_key", "strong"], "left")
    hit = F.col("base_offset").isNotNull()
    carried = "data" in client.columns
    return joined.select(
        "file_key", "offset", (F.octet_length("data") if carried else F.col("length")).alias("length"), F.when(hit, "hit").otherwise("miss").alias("kind"), "base_offset", *([F.when(~hit, F.col("data")).alias("data")] if carried else [])
    )


def marked_blocks(client: DataFrame, wanted: DataFrame, buckets: int = 2048) -> DataFrame:
    """Rows of ``client`` whose (file_key, offset) may be in ``wanted``: all that are, and few others.

    ``wanted`` sets bits of ``buckets`` maps of 32,768 bits each, made by Spark on the map side and broadcast: 8 MB at most, however many
    blocks are wanted. With many more than a bit each, more of the others stay.
    """
    place = F.pmod(F.xxhash64("file_key", "offset"), F.lit(buckets * 32768))
    maps = wanted.groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__map"))
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__map"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = client.withColumn("__bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "__bucket")
    return met.where(F.getbit(byte, at % 8) == 1).select(*client.columns)


def miss_data(plan: DataFrame, client: DataFrame, buckets: int = 2048) -> DataFrame:
    """file_key, offset, length, data of a plan's misses, from the client's blocks (file_key, offset, data).

    Blocks that are hits stay where they are: ``marked_blocks`` holds them back before the exact join moves data. The plan is read
    twice, so write a costly one first.
    """
    misses = plan.where("kind = 'miss'").select("file_key", "offset", "length")
    return misses.join(marked_blocks(client.select("file_key", "offset", "data"), misses, buckets), ["file_key", "offset"]).select("file_key", "offset", "length", "data")


def delta_chunks(plan: DataFrame, base: DataFrame) -> DataFrame:
    """file_key, offset, data, fault: each block of a plan as its bytes, so a file of any size is as many rows as it has blocks.

    A hit that no base block answers in full is ``out_of_bounds``, a miss without data ``missing_data``; both have no data.
    """
    parts = plan.join(base.select("file_key", F.col("offset").alias("base_offset"), F.col("data").alias("__base")), ["file_key", "base_offset"], "left")
    found = F.when(F.col("kind") == "hit", F.when(F.octet_length("__base") >= F.col("length"), F.substring(F.col("__base"), F.lit(1), F.col("length").cast("int")))).otherwise(F.col("data"))
    fault = F.when((F.col("kind") == "hit") & F.col("__part").isNull(), "out_of_bounds").when((F.col("kind") == "miss") & (F.coalesce(F.octet_length("data"), F.lit(0)) == 0), "missing_data")
    marked = parts.withColumn("__part", found).withColumn("fault", fault)
    return marked.select("file_key", "offset", F.when(F.col("fault").isNull(), F.col("__part")).alias("data"), "fault")


def delta_apply(plan: DataFrame, base: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """file_key, content, error: contents put together again from a plan and the base blocks, for files that fit a row.

    A file with a faulty block (``delta_chunks``) has its first fault as error and no content. ``files`` (file_key) adds those of
    no blocks, whose content is empty. Larger files stay chunks: ``delta_chunks``, and ``chunk_digests`` for their hashes.
    """
    chunks = delta_chunks(plan, base)
    whole = chunks.groupBy("file_key").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY offset)").alias("__content"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("offset"))).alias("error"))
    out = whole.select("file_key", F.when(F.col("error").isNull(), F.col("__content")).alias("content"), "error")
    if files is None:
        return out
    none = files.select("file_key").distinct().join(out.select("file_key"), "file_key", "left_anti")
    return out.unionByName(none.select("file_key", F.lit(bytearray()).alias("content"), F.lit(None).cast("string").alias("error")))


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """file_key, content_hash, size, chunks_ok of each file of ``chunks`` (file_key, offset, data; strong: hex, may be absent).

    A file's chunks stream past in order of offset while its digest goes on from batch to batch, so a file of any size takes one
    batch of memory. ``chunks_ok`` says that every ``strong`` of 64 digits is its chunk's digest. A null chunk is empty.
    """
    strong = F.col("strong") if "strong" in chunks.columns else F.lit(None).cast("string")
    good = F.when(F.length(strong) == 64, F.sha2("data", 256) == F.lower(strong)).otherwise(F.lit(True))
    rows = chunks.select("file_key", "offset", "data", F.coalesce(good, F.lit(True)).alias("good"))
    kind = chunks.schema["file_key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None  # (key, digest, size, good) of the file under way

        def done() -> pa.RecordBatch:
            key, digest, size, ok = now
            return pa.RecordBatch.from_arrays([pa.array([key], to_arrow_type(kind)), pa.array([digest.hexdigest()]), pa.array([size], pa.int64()), pa.array([ok])], ["file_key", "content_hash", "size", "chunks_ok"])

        for batch in batches:
            keys, oks = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for i, key in enumerate(keys):
                if now is None or key != now[0]:
                    if now is not None:
                        yield done()
                    now = (key, hashlib.sha256(), 0, True)
                data = batch.column(2)[i].as_py() or b""
                now[1].update(data)
                now = (key, now[1], now[2] + len(data), now[3] and oks[i])
        if now is not None:
            yield done()

    schema = f"file_key {kind.simpleString()}, content_hash string, size long, chunks_ok boolean"
    return rows.repartition("file_key").sortWithinPartitions("file_key", "offset").mapInArrow(run, schema)


def with_halo(chunks: DataFrame, block: int = BLOCK_SIZE) -> DataFrame:
    """``chunks`` (file_key, offset, data) with the first ``block`` - 1 bytes of what follows, so that no window is cut.

    Chunks of a file follow one another without gaps; each holds ``block`` - 1 bytes or more, but for the last.
    """
    following = F.lead("data").over(Window.partitionBy("file_key").orderBy("offset"))
    return chunks.withColumn("data", F.concat("data", F.coalesce(F.substring(following, F.lit(1), F.lit(block - 1)), F.lit(bytearray()))))


def cut_pieces(files: DataFrame, block: int = BLOCK_SIZE, piece: int = PIECE) -> DataFrame:
    """``files`` (file_key, content) in pieces (file_key, offset, data), each with the first ``block`` - 1 bytes of the next."""
    starts = F.sequence(F.lit(0), F.octet_length("content") - 1, F.lit(piece))
    rows = files.where(F.octet_length("content") > 0).select("file_key", "content", F.explode(starts).alias("__at"))
    return rows.select("file_key", F.col("__at").cast("long").alias("offset"), F.substring(F.col("content"), F.col("__at") + 1, F.lit(piece + block - 1)).alias("data"))


def shifted_matches(client: DataFrame, base: DataFrame, block: int = BLOCK_SIZE) -> DataFrame:
    """file_key, offset, base_offset: every offset of a client file at which a full base block of that file recurs.

    ``client`` is whole files (file_key, content), cut into pieces here, or pieces that overlap by ``block`` - 1 bytes
    (file_key, offset, data: ``with_halo``) for files of any size. A piece meets the checksums of its own file's base blocks (8
    bytes a block); all its windows get a rolling checksum; only those whose checksum the base has are cut out, and
    their digests decide.
    """
    pieces = cut_pieces(client, block) if "content" in client.columns else client.select("file_key", "offset", "data")
    full = base.where(F.octet_length("data") == block)
    sums = full.groupBy("file_key").agg(F.collect_set("weak").alias("__sums"))
    kind = client.schema["file_key"].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, start, piece, known in zip(*(batch.column(i) for i in range(4)), strict=True):
                data, first = piece.as_py() or b"", start.as_py()
                at = np.flatnonzero(np.isin(rolling_weak(data, block), known.values.to_numpy()))
                for part in np.array_split(at, max(1, len(at) // 1000)):
                    rows = part.tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()] * len(rows), batch.schema.field(0).type), pa.array([first + i for i in rows], pa.int64()), pa.array([data[i : i + block] for i in rows], pa.binary())],
                        ["file_key", "offset", "data"],
                    )

    met = pieces.join(sums, "file_key").select("file_key", "offset", "data", "__sums")
    found = met.mapInArrow(windows, f"file_key {kind}, offset long, data binary").withColumn("strong", F.sha2("data", 256)).drop("data")
    last = full.groupBy("file_key", "strong").agg(F.max("offset").alias("base_offset"))
    return found.join(last, ["file_key", "strong"]).select("file_key", "offset", "base_offset")


def verify_upload(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """file_key, status: chunk_integrity, content_mismatch or ok.

    ``chunks`` (file_key, offset, data, strong: hex or empty); ``expected`` (file_key, content_hash, may be empty). A chunk's
    digest counts where it has 64 digits; an empty file hash is not checked. A file may be larger than a row or a task's memory.
    """
    joined = expected.join(chunk_digests(chunks).withColumnRenamed("content_hash", "__hash"), "file_key", "left")
    digest = F.coalesce("__hash", F.sha2(F.lit(bytearray()), 256))
    status = F.when(~F.coalesce("chunks_ok", F.lit(True)), "chunk_integrity").when((F.coalesce("content_hash", F.lit("")) != "") & (F.lower("content_hash") != digest), "content_mismatch").otherwise("ok")
    return joined.select("file_key", status.alias("status"))


def _archived(path: Column) -> Column:
    return (path != "index.json") & ~F.array_contains(F.split(path, "/"), ".disk-archive")


def archive_create(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, slots) of ``files`` (path, content): path, size, digest of each file, and each distinct content once.

    ``archive_write_slots`` writes the slots.
    """
    kept = files.where(_archived(F.col("path"))).select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"), "content")
    slots = kept.select("digest", "content").dropDuplicates(["digest"]).withColumn("hh", F.substring("digest", 1, 2))
    return kept.select("path", "size", "digest"), slots


def archive_write_slots(slots: DataFrame, path: str) -> None:
    """Slots under ``path``, compressed (zstd), a folder for each two first digits of the digest (256 at most)."""
    slots.repartition("hh", F.pmod(F.xxhash64("digest"), F.lit(16))).write.mode("overwrite").partitionBy("hh").option("compression", "zstd").parquet(path)


def archive_read_slots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest string, content binary, hh string").parquet(path)


def archive_restore(index: DataFrame, slots: DataFrame, contents: bool = False) -> DataFrame:
    """``index`` rows with status: unsafe_path, missing, integrity_failed, ok; with ``contents`` also what is to be written (for ok ones).

    Slots are met by folder and digest, so a restore of some entries reads just the folders of those (pruned as it runs).
    """
    wanted = index.withColumn("hh", F.substring("digest", 1, 2))
    joined = wanted.join(slots.select("hh", "digest", "content"), ["hh", "digest"], "left")
    unsafe = F.startswith(F.col("path"), F.lit("/")) | F.array_contains(F.split("path", "/"), "..")
    broken = (F.octet_length("content") != F.col("size")) | (F.sha2("content", 256) != F.col("digest"))
    status = F.when(unsafe, "unsafe_path").when(F.col("content").isNull(), "missing").when(broken, "integrity_failed").otherwise("ok")
    content = [F.when(status == "ok", F.col("content")).alias("content")] if contents else []
    return joined.select(*index.columns, status.alias("status"), *content)
