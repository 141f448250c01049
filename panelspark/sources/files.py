"""Whole files from tasks: written by name, and digested by byte ranges whatever their size."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one task reads at a time.
RANGE = 64 << 20


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark names it, and the place in it."""
    if uri.startswith("file:"):
        uri = re.sub("^file:/*", "file:///", uri)
    elif "://" not in uri:
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)


def write_files(rows: DataFrame, folder: str) -> int:
    """One file for each row (name, content) under ``folder``; a task that runs again writes the same file again."""
    base = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                store, place = open_store(f"{base}/{name}")
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(place) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])

    return rows.select("name", "content").mapInArrow(run, "name string").count()


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of every file below ``folder``, without reading any; empty files are not listed by Spark."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def fold(digests: list[bytes]) -> bytes:
    """Root of the tree over range digests: neighbours are digested together, an odd one goes up as it is."""
    while len(digests) > 1:
        pairs = [hashlib.sha256(b"".join(digests[i : i + 2])).digest() if i + 1 < len(digests) else digests[i] for i in range(0, len(digests), 2)]
        digests = pairs
    return digests[0] if digests else hashlib.sha256().digest()


def digest_files(files: DataFrame, size: int = RANGE) -> DataFrame:
    """path, length and ``merkle`` (hexadecimal root) of every file in ``files`` (path, length).

    Each range of ``size`` bytes is a row of its own and read by itself, so that a file of any size is spread over tasks and no
    task holds more than a range. A file of one range has the SHA-256 of its content as its root.
    """
    ends = F.greatest(F.col("length") - 1, F.lit(0).cast("bigint"))
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), ends, F.lit(size).cast("bigint"))).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                store, place = open_store(path)
                with store.open_input_file(place) as file:
                    file.seek(offset)
                    digests.append(hashlib.sha256(file.read(size)).digest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], ["path", "length", "offset", "digest"])

    parts = ranges.repartition("path", "offset").mapInArrow(run, "path string, length bigint, offset bigint, digest binary")
    leaves = parts.groupBy("path", "length").agg(F.transform(F.sort_array(F.collect_list(F.struct("offset", "digest"))), lambda r: r["digest"]).alias("leaves"))
    root = F.pandas_udf(lambda lists: pd.Series([fold(list(one)).hex() for one in lists], dtype="object"), "string")
    return leaves.select("path", "length", root("leaves").alias("merkle"))
