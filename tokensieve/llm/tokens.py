"""Token counts of documents in flat token files, by scanning for the end-of-document id.

A flat file is token ids of one width and nothing else: each document's
ids, then the end id.  A file of any size is cut into runs, byte ranges
that tasks read and search on their own, block by block as arrays, without
knowing what documents they are in.  A prefix scan carries the number of
ends and the place of the last one across blocks within a run, and another
across a file's runs, so documents that cross either are stitched.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytebpe import byte_bpe
from .scratch import drop, new_path, release, small_batches, store

END_ID = 50256
#: 64 KB of 16-bit ids, searched at once; and how many of them are a run.
BLOCK_IDS, RUN_BLOCKS = 1 << 15, 512
_KINDS = {2: "<u2", 4: "<u4"}


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store and the path in it that a URI, as Spark writes them, stands for."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file" or "/" in scheme:
        return pyarrow.fs.LocalFileSystem(), "/" + (rest if scheme == "file" else uri).lstrip("/")
    return pyarrow.fs.FileSystem.from_uri("s3:" + rest if scheme in ("s3a", "s3n") else uri)


def write_flat(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Encode docs (doc_id, text) into flat files in folder, one a task; a stored table (file, ordinal, doc_id) tells whose they are.

    A null text is the end id alone; rows that repeat a doc_id are written
    each; an empty table writes no ids.  Files are named ``<file>.bin`` by
    task attempt, so what a lost attempt left is in no row and is never
    read.  path names the tokenizer's file on the workers.  Raises
    ValueError where an id doesn't fit in width bytes.
    """
    small_batches(docs.sparkSession)
    kind, most = _KINDS[width], (1 << 8 * width) - 1
    if not 0 <= end_id <= most:
        raise ValueError(f"end id {end_id} doesn't fit in {width} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path, specials=False)
        end = np.array([end_id], kind).tobytes()
        file, ordinal = TaskContext.get().taskAttemptId(), 0
        store_, place = _filesystem(f"{folder}/{file}.bin")
        store_.create_dir(os.path.dirname(place))
        with store_.open_output_stream(place) as out:
            for b in batches:
                for text in b.column("text"):
                    ids = np.frombuffer(coder.encode(text.as_py()), "<u4")
                    if len(ids) and int(ids.max()) > most:
                        raise ValueError(f"id {int(ids.max())} doesn't fit in {width} bytes")
                    if (ids == end_id).any():
                        raise ValueError(f"a text holds the end id {end_id}")
                    out.write(ids.astype(kind).tobytes() + end)
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, file)), pa.array(np.arange(ordinal, ordinal + n)), b.column("doc_id")], ["file", "ordinal", "doc_id"])
                ordinal += n

    return store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file long, ordinal long, doc_id long"))


def list_files(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(file, n): URI and number of ids of every flat file (*.bin) at path, as Spark lists them; bytes behind the last whole id are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    return found.select(F.col("path").alias("file"), F.floor(F.col("length") / width).cast("long").alias("n"))


def count_tokens(files: DataFrame, end_id: int = END_ID, width: int = 2, block_ids: int = BLOCK_IDS, run_blocks: int = RUN_BLOCKS) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document of flat files (file, n) of width-byte ids.

    ordinal counts a file's documents from 0, start is the place of the
    document's first id, n_tokens leaves the end id out.  Ids behind a
    file's last end id are a document only once their end is there.  A
    run's bytes are read through Arrow's file systems, so a file may be of
    any size.  Empty files and an empty table give no rows.
    """
    kind, run_ids = _KINDS[width], block_ids * run_blocks
    cut = files.where("n > 0").select("file", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / run_ids).cast("long"))).alias("run"))
    runs = store(cut.select("file", "run", F.least(F.lit(run_ids), F.col("n") - F.col("run") * run_ids).cast("long").alias("size")))
    parts = min(max(runs.count(), 1), 1 << 16)  # a row stands for a run's bytes, which adaptive execution can't know
    schema = pa.schema([("file", pa.string()), ("run", pa.int64()), ("place", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, run, size in zip(*(b.column(c).to_pylist() for c in ("file", "run", "size"))):
                where, path = _filesystem(file)
                first, seen, last = run * run_ids, 0, None
                with where.open_input_file(path) as data:
                    for at in range(first, first + size, block_ids):
                        ids = np.frombuffer(data.read_at(min(block_ids, first + size - at) * width, at * width), kind)
                        if len(ids) < min(block_ids, first + size - at):
                            raise OSError(f"{file} ends before id {first + size}")
                        ends = np.flatnonzero(ids == end_id) + at
                        if not len(ends):
                            continue
                        starts = pa.array([last, *(ends[:-1] + 1).tolist()], pa.int64())  # null: it starts in an earlier run
                        n = len(ends)
                        yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.full(n, run)), pa.array(np.arange(seen, seen + n)), starts, pa.array(ends)], schema=schema)
                        seen, last = seen + n, int(ends[-1]) + 1

    found = store(runs.repartition(parts, "file", "run").mapInArrow(scan, "file string, run long, place long, start long, end long"))
    release(runs)
    before = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = found.groupBy("file", "run").agg(F.count("*").alias("n"), F.max("end").alias("last"))
    carried = store(totals.select("file", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("open")))
    start = F.coalesce("start", "open")
    docs = found.join(carried, ["file", "run"])
    return docs.select("file", (F.col("first") + F.col("place")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def count_documents(docs: DataFrame, path: str, end_id: int = END_ID, **options) -> DataFrame:
    """(doc_id, n_tokens) of every row of docs (doc_id, text): written as flat files, found again in them.

    A null or empty text has no tokens; rows that repeat a doc_id are
    counted each; an empty table gives an empty result.  options are
    count_tokens'.
    """
    spark = docs.sparkSession
    folder = new_path(spark)
    owners = write_flat(docs, path, folder, end_id)
    if owners.isEmpty():
        return owners.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    found = count_tokens(list_files(spark, folder), end_id, **options)
    drop(spark, folder)  # the scan has stored what it found
    number = F.regexp_extract("file", r"(\d+)\.bin$", 1).cast("long").alias("file")
    return owners.join(found.select(number, "ordinal", "n_tokens"), ["file", "ordinal"]).select("doc_id", "n_tokens")
