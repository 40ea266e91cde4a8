"""Document lengths in flat token files, by a scan for the end-of-document identifier.

A flat file is nothing but identifiers, one document after the other, each ended by a separator; there is no index. Files
are cut into blocks, each block is searched for separators in one array operation, and documents that run over block
boundaries are stitched by a prefix scan: a running maximum of the last separator before a block gives the start of its
first document, a running sum of separators the document's number in its file.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colweave.llm import common as c
from colweave.llm.tokens import encoder

BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 25


def _open_output(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def write_flat(docs: DataFrame, folder: str, tokenizer: str, separator: int, doc_id: str = "doc_id", text: str = "text", dtype: str = "<u2", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the texts as flat token files below `folder`, which all executors share; returns (file, number, doc_id).

    Special tokens' strings are ordinary text, so the separator occurs only between documents. Null texts are empty. File
    names hold the task attempt: what a lost or repeated attempt wrote is never listed, and so never read.
    """

    def write(batches):
        encode = encoder(tokenizer, ordinary=True)
        out, name, number, size = None, "", 0, 0
        end = np.array([separator], dtype).tobytes()
        for batch in batches:
            files, numbers = [], []
            for t in batch.column(1).to_pylist():
                if out is None or size >= file_tokens:
                    if out is not None:
                        out.close()
                    name = f"{TaskContext.get().taskAttemptId():08d}-{uuid.uuid4().hex}.tokens"
                    out, number, size = _open_output(f"{folder}/{name}"), 0, 0
                ids = encode(t) if t else np.zeros(0, np.uint32)
                if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
                    raise ValueError(f"token ids of {tokenizer} do not fit {dtype}")
                out.write(ids.astype(dtype).tobytes() + end)
                files.append(name)
                numbers.append(number)
                number, size = number + 1, size + len(ids) + 1
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(numbers, pa.int64()), batch.column(0)], names=["file", "number", "doc_id"])
        if out is not None:
            out.close()

    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(c.quoted(doc_id).alias("doc_id"), c.quoted(text).alias("text"))
    return c.stored(slim.mapInArrow(write, f"file string, number bigint, doc_id {kind}"), "flat-manifest")


def scan(spark: SparkSession, folder: str, separator: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, number, start, n_tokens, ended) of every document in the flat files of a folder.

    n_tokens leaves the separator out; documents may be empty. Tokens after a file's last separator are a document that is
    not ended. An empty file has no documents. A file that does not hold whole identifiers is refused.
    """
    width = np.dtype(dtype).itemsize

    def search(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if len(data.as_buffer()) % width:
                    raise ValueError(f"{path} does not hold whole identifiers of {width} bytes")
                ids = np.frombuffer(data.as_buffer(), dtype)
                starts = np.arange(0, len(ids), block_tokens)
                found = [np.flatnonzero(ids[s : s + block_tokens] == separator) + s for s in starts]
                sizes = [min(block_tokens, len(ids) - s) for s in starts]
                name = path.rpartition("/")[2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(starts), pa.string()), pa.array(starts + np.array(sizes, np.int64), pa.int64()), pa.array([f.tolist() for f in found], pa.list_(pa.int64()))],
                    names=["file", "until", "ends"],
                )

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    blocks = files.mapInArrow(search, "file string, until bigint, ends array<bigint>")
    before = Window.partitionBy("file").orderBy("until").rowsBetween(Window.unboundedPreceding, -1)
    scanned = blocks.select(
        "*",
        F.coalesce(F.max(F.array_max("ends") + 1).over(before), F.lit(0)).alias("open"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("first"),
        (F.row_number().over(Window.partitionBy("file").orderBy(F.desc("until"))) == 1).alias("last"),
    )
    # The last block also holds what no separator ends.
    tail = F.coalesce(F.array_max("ends") + 1, F.col("open"))
    stops = F.when(F.col("last") & (tail < F.col("until")), F.concat("ends", F.array("until"))).otherwise(F.col("ends"))
    each = scanned.withColumn("stops", stops).select("*", F.posexplode("stops").alias("k", "stop"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.element_at("stops", F.greatest(F.col("k"), F.lit(1))) + 1)
    each = each.select("file", (F.col("first") + F.col("k")).cast("bigint").alias("number"), start.alias("start"), "stop", (F.col("k") < F.size("ends")).alias("ended"))
    return each.select("file", "number", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended")


def count_tokens(docs: DataFrame, tokenizer: str, separator: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row: the texts are written as flat files, and the files are scanned."""
    spark = docs.sparkSession
    folder = c.scratch(spark, "flat-tokens")
    manifest = write_flat(docs, folder, tokenizer, separator, doc_id, text)
    if manifest.isEmpty():
        return manifest.select("doc_id", F.lit(0).cast("bigint").alias("n_tokens"))
    counted = scan(spark, folder, separator)
    return manifest.join(counted, ["file", "number"]).select("doc_id", "n_tokens")
