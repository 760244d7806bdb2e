"""Token counts of flat token files without an index, by a scan for separators.

A flat file is a run of token ids with an end-of-document id after each document and nothing
else: no index, no lengths. It is handled in blocks, rows (file, block, payload) of any size,
payload holding little-endian unsigned ids. Documents run across blocks.

1. Tasks search each block for the separator, vectorised; a block gives its number of ids and
   the places of its separators.
2. A prefix scan over the blocks of a file gives every block its first id's place, the number
   of documents ended before it and where the last of them ended. The scan has two levels, so
   one huge file is no task of its own: groups of ``SPAN`` blocks are summed first, the sums
   are scanned, and then the blocks inside each group.
3. A separator's place minus the end before it is a document's length.

Defined cases: two separators in a row are an empty document; ids after the last separator
are a document with ``ended`` false; null and empty payloads hold no ids; a file without ids
has no documents; empty tables give empty results; extra columns are ignored; repeated
(file, block) rows are an error of the caller and are read one after the other. Writing an id
that does not fit the width, or a text's id that is the separator's, is an error.
"""

from __future__ import annotations

import math
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlib.llm.tokens import encoder_of, shared_tokenizer
from martlib.storage import new_path, write_through

# The tokenizer's own end-of-text id; a text cannot contain it, its marker is ordinary text.
SEPARATOR = 50256
BLOCK_IDS = 256 * 1024
SPAN = 1024
# Blocks of a raw file that a task reads as one range, and the number of such tasks.
RANGE_BLOCKS = 128
MAX_READERS = 20_000
# Files taken as one value where only Spark can read a store.
WHOLE_BYTES = 64 * 1024 * 1024

_FLAT = "kind string, file long, block long, payload binary, doc_id long"


def _writer(shared, width: int):
    kind, limit = f"<u{width}", 1 << 8 * width

    def write(batches):
        encoder, file = encoder_of(shared, literal=True), TaskContext.get().partitionId()
        held, total, block, ordinal = [], 0, 0, 0
        size = BLOCK_IDS * width

        def rows(name, numbers, payloads, ids):
            n = len(numbers)
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * n), pa.array([file] * n, pa.int64()), pa.array(numbers, pa.int64()),
                 pa.array(payloads, pa.binary()), pa.array(ids, pa.int64())],
                ["kind", "file", "block", "payload", "doc_id"],
            )

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            yield rows("order", range(ordinal, ordinal + len(ids)), [None] * len(ids), ids)
            ordinal += len(ids)
            for text in batch.column("text").to_pylist():
                numbers = encoder.document(text, SEPARATOR)
                if numbers.max() >= limit:
                    raise ValueError(f"token id {numbers.max()} does not fit {width} bytes; use a larger width")
                if (numbers[:-1] == SEPARATOR).any():
                    raise ValueError(f"the tokenizer gives a text the separator's id, {SEPARATOR}")
                held.append(numbers.astype(kind).tobytes())
                total += len(held[-1])
                if total >= size:
                    run = b"".join(held)
                    full = len(run) // size
                    yield rows("block", range(block, block + full),
                               [run[i * size : (i + 1) * size] for i in range(full)], [None] * full)
                    block += full
                    held, total = [run[full * size :]], len(run) - full * size
        if total:
            yield rows("block", [block], [b"".join(held)], [None])

    return write


def write_flat(docs: DataFrame, tokenizer: str | None = None, width: int = 2) -> tuple[DataFrame, DataFrame]:
    """Tokenise documents into flat files, one per task.

    Returns the blocks (file, block, payload) and the order of documents (file, ordinal,
    doc_id), both read back from the shared folder.
    """
    spark = docs.sparkSession
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = new_path(spark, "token-files")
    flat = whole.mapInArrow(_writer(shared_tokenizer(spark, tokenizer), width), _FLAT)
    flat.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    stored = spark.read.schema(_FLAT).parquet(path)
    order = stored.where("kind = 'order'").select("file", F.col("block").alias("ordinal"), "doc_id")
    return stored.where("kind = 'block'").select("file", "block", "payload"), order


def _finder(separator: int, width: int):
    def find(batches):
        for batch in batches:
            counts, places = [], []
            for payload in batch.column("payload").to_pylist():
                ids = np.frombuffer(payload or b"", f"<u{width}")
                counts.append(len(ids))
                places.append(np.flatnonzero(ids == separator).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(counts, pa.int64()),
                 pa.array(places, pa.list_(pa.int32()))],
                ["file", "block", "n", "places"],
            )

    return find


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """file, ordinal, start, n_tokens (without the separator) and ended, for each document."""
    found = write_through(
        blocks.select(F.col("file").cast("long").alias("file"), F.col("block").cast("long").alias("block"), "payload")
        .mapInArrow(_finder(separator, width), "file long, block long, n long, places array<int>"),
        "separators",
    )
    found = found.select(
        "*",
        F.floor(F.col("block") / SPAN).alias("span"),
        F.size("places").alias("ends"),
        F.try_element_at("places", F.lit(-1)).alias("last"),
    )

    def scan(rows: DataFrame, keys: list[str], order: str, names: dict[str, str]) -> DataFrame:
        """Sums of all earlier rows: ids, ends, and the place of the last end among them."""
        earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        at = rows.withColumns(
            {
                names["ids"]: F.coalesce(F.sum("n").over(earlier), F.lit(0)),
                names["ends"]: F.coalesce(F.sum("ends").over(earlier), F.lit(0)),
            }
        )
        return at.withColumn(names["end"], F.max(F.col(names["ids"]) + F.col("last")).over(earlier))

    inner = scan(found, ["file", "span"], "block", {"ids": "ids1", "ends": "ends1", "end": "end1"})
    spans = inner.groupBy("file", "span").agg(
        F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.max(F.col("ids1") + F.col("last")).alias("last")
    )
    outer = scan(spans, ["file"], "span", {"ids": "ids0", "ends": "ends0", "end": "end0"})
    placed = inner.join(outer.select("file", "span", "ids0", "ends0", "end0"), ["file", "span"]).select(
        "file",
        (F.col("ids0") + F.col("ids1")).alias("first"),
        (F.col("ends0") + F.col("ends1")).alias("done"),
        # The place after the separator before this block; 0 at the start of a file.
        (F.coalesce(F.col("ids0") + F.col("end1"), "end0", F.lit(-1)) + 1).alias("begin"),
        "places",
    )
    ended = placed.select("file", "first", "done", "begin", "places", F.posexplode("places").alias("i", "place")).select(
        "file",
        (F.col("done") + F.col("i")).alias("ordinal"),
        F.when(F.col("i") == 0, F.col("begin"))
        .otherwise(F.col("first") + F.get("places", F.col("i") - 1) + 1)
        .alias("start"),
        (F.col("first") + F.col("place")).alias("stop"),
        F.lit(True).alias("ended"),
    )
    tail = (
        outer.groupBy("file")
        .agg(
            F.sum("n").alias("stop"),
            F.sum("ends").alias("ordinal"),
            (F.coalesce(F.max(F.col("ids0") + F.col("last")), F.lit(-1)) + 1).alias("start"),
        )
        .where("stop > start")
        .select("file", "ordinal", "start", "stop", F.lit(False).alias("ended"))
    )
    return ended.unionByName(tail).select(
        "file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended"
    )


def _file_system(path: str):
    """A file system that reads places of a file inside a task, and the file's name in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def _ranges(size: int):
    """Blocks of rows (path, file, at, bytes): a range is read block by block."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, name = _file_system(row["path"])
                with system.open_input_file(name) as source:
                    for at in range(row["at"], row["at"] + row["bytes"], size):
                        wanted = min(size, row["at"] + row["bytes"] - at)
                        payload = source.read_at(wanted, at)
                        if len(payload) < wanted:
                            raise OSError(f"{row['path']} ended before place {at + wanted}")
                        yield _block(row["file"], at // size, payload)

    return read


def _whole_files(size: int):
    def cut(batches):
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                for block, at in enumerate(range(0, len(content), size)):
                    yield _block(file, block, content[at : at + size])

    return cut


def record_bytes(length: int, size: int, width: int) -> int:
    """The longest record of whole ids, at most ``size`` bytes, of which a file has a whole number."""
    ids, most = length // width, size // width
    found = max(d for i in range(1, min(most, math.isqrt(ids)) + 1) if ids % i == 0 for d in (i, ids // i) if d <= most)
    return found * width


def _records(spark, path: str, file: int, length: int, size: int, width: int):
    """Blocks of one large file through Hadoop's fixed-length records, whose key is their place."""
    if length % width:
        raise ValueError(f"{path} does not hold whole ids of {width} bytes")
    each = record_bytes(length, size, width)
    records = spark.sparkContext.newAPIHadoopFile(
        path,
        "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat",
        "org.apache.hadoop.io.LongWritable",
        "org.apache.hadoop.io.BytesWritable",
        conf={"fixedlengthinputformat.record.length": str(each)},
    )

    def blocks(rows):
        """Records of a split follow each other; short ones are put together."""
        first, held = None, bytearray()
        for at, payload in rows:
            if held and len(held) + each > size:
                yield file, first // each, bytes(held)
                held = bytearray()
            first = at if not held else first
            held += payload
        if held:
            yield file, first // each, bytes(held)

    return records.mapPartitions(blocks)


def _block(file: int, block: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([payload], pa.binary())],
        ["file", "block", "payload"],
    )


def read_flat(spark, path: str, width: int = 2) -> DataFrame:
    """Blocks of binary token files of any size; a hash of a file's path gives its number.

    Spark lists the files without their content, and tasks read ranges of ``RANGE_BLOCKS``
    blocks, so a large file is shared by many tasks and none holds more than a block of it.
    A store that pyarrow has no reader for is read through Spark: files of up to ``WHOLE_BYTES``
    by content, larger ones as Hadoop's fixed-length records.
    """
    size, schema = BLOCK_IDS * width, "file long, block long, payload binary"
    files = spark.read.format("binaryFile").load(path).withColumn("file", F.xxhash64("path"))
    first = files.select("path").first()
    try:
        if first:
            _file_system(first.path)
    except (OSError, pa.ArrowException, ImportError):
        small = files.where(F.col("length") <= WHOLE_BYTES).select("file", "content")
        out = small.mapInArrow(_whole_files(size), schema)
        for f in files.where(F.col("length") > WHOLE_BYTES).select("path", "file", "length").toLocalIterator():
            out = out.unionByName(spark.createDataFrame(_records(spark, f.path, f.file, f.length, size, width), schema))
        return out
    step = size * RANGE_BLOCKS
    ranges = (
        files.where("length > 0")
        .select("path", "file", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(step))).alias("at"))
        .select("path", "file", "at", F.least(F.col("length") - F.col("at"), F.lit(step)).alias("bytes"))
    )
    # A fixed number: adaptive execution would put these few small rows into one task.
    ranges = ranges.repartition(max(1, min(ranges.count(), MAX_READERS)))
    return ranges.mapInArrow(_ranges(size), schema)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    blocks, order = write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counted = count_tokens(blocks)
    return order.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "start", "file", "ordinal")
