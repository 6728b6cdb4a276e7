"""Token-id output: flat unsigned integer files with 64-bit document offsets, memory-mapped.

A data set is a folder of shards in ascending doc_id order. Shard k has
  ids-*.bin   the ids of its documents, little-endian, 2 bytes each for vocabularies up to 65,536, else 4
  off-*.bin   n + 1 little-endian unsigned 64-bit offsets, counted in ids from the start of the whole data set
  key-*.bin   n little-endian signed 64-bit doc_ids, then n bytes that are 1 where doc_id is null
and the manifest table lists (part, files, n_docs, n_tokens, base). Bases are prefix sums of the shards' n_tokens.

Each attempt of a task writes files of its own names; only those that the finished attempts name are in the manifest,
so retried and speculative attempts leave a right data set.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, shared_dir, table, written
from .tokens import encoder, slices, with_end

MANIFEST = "part long, name string, width long, n_docs long, n_tokens long"


def _opened(root: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(root)


def _mapped(root: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where it is on a mounted file system, else read."""
    from pyarrow.fs import LocalFileSystem

    fs, path = _opened(root)
    path = f"{path}/{name}"
    if not fs.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(fs, LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write(docs: DataFrame, root: str, vocabulary: str, end_id: int) -> list[tuple]:
    """Encode all docs (doc_id, text) into the folder root; returns the manifest's rows, a few numbers for each shard.

    Null text is empty text: the end id alone. Null doc_ids come first. Rows with equal doc_id are all kept, in the
    order of their texts' hashes. An empty table gives no documents.
    """
    _opened(root)[0].create_dir(_opened(root)[1], recursive=True)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _opened(root)
        enc, name = encoder(vocabulary), f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        sizes, keys, nulls = [], [], []
        with fs.open_output_stream(f"{path}/ids-{name}.bin") as out:
            for pdf in batches:
                texts = pdf["text"].tolist()
                for run in slices(texts):
                    ids, n = with_end(*enc.encode([texts[i] for i in run]), end_id)
                    out.write(ids.astype(enc.dtype, copy=False).tobytes())
                    sizes.append(n)
                keys.append(pdf["key"].to_numpy(np.int64))
                nulls.append(pdf["gone"].to_numpy(np.uint8))
        n = np.concatenate([np.zeros(0, np.int64), *sizes])
        with fs.open_output_stream(f"{path}/len-{name}.bin") as out:
            out.write(n.astype("<u8").tobytes())
        with fs.open_output_stream(f"{path}/key-{name}.bin") as out:
            out.write(np.concatenate([np.zeros(0, np.int64), *keys]).astype("<i8").tobytes() + np.concatenate([np.zeros(0, np.uint8), *nulls]).tobytes())
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "name": [name], "width": [enc.dtype.itemsize], "n_docs": [len(n)], "n_tokens": [int(n.sum())]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.withColumn("tie", F.xxhash64("text"))  # short, as the bounds of the ranges go through the driver
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    made = ordered.select(F.coalesce("doc_id", F.lit(0)).alias("key"), F.col("doc_id").isNull().cast("int").alias("gone"), "text").mapInPandas(put, MANIFEST)
    base, rows = 0, []
    for r in sorted(written(made, "shards").collect(), key=lambda r: r.part):  # a row for each task
        if r.n_docs:
            rows.append((len(rows), r.name, r.width, r.n_docs, r.n_tokens, base))
            base += r.n_tokens
    return rows


def manifest(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, MANIFEST + ", base long").repartition(max(1, len(rows)), "part")


def write_offsets(spark: SparkSession, root: str, rows: list[tuple]) -> None:
    """The offsets of each shard from its lengths and its base."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _opened(root)
        for pdf in batches:
            for r in pdf.itertuples():
                off = np.concatenate([np.zeros(1, "<u8"), np.cumsum(_mapped(root, f"len-{r.name}.bin", "<u8"), dtype="<u8")]) + np.uint64(r.base)
                temp = f"{path}/off-{r.name}.{uuid.uuid4().hex}"
                with fs.open_output_stream(temp) as out:
                    out.write(off.astype("<u8").tobytes())
                fs.move(temp, f"{path}/off-{r.name}.bin")
            yield pdf[["part"]]

    if rows:
        manifest(spark, rows).mapInPandas(put, "part long").agg(F.count("*")).collect()


def read(spark: SparkSession, root: str, rows: list[tuple]) -> DataFrame:
    """The documents of the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), part."""

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids, off = _mapped(root, f"ids-{r.name}.bin", f"<u{r.width}"), _mapped(root, f"off-{r.name}.bin", "<u8").astype(np.int64)
                key = _mapped(root, f"key-{r.name}.bin", "u1")
                n = r.n_docs
                doc, gone = np.frombuffer(key[: 8 * n].tobytes(), "<i8"), key[8 * n :].astype(bool)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip((off[:-1] - r.base).tolist(), (off[1:] - r.base).tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": pd.Series(doc).astype("Int64").mask(pd.Series(gone)), "start": off[:-1], "n_tokens": np.diff(off), "ids_crc32": np.array(crc, np.int64), "part": r.part})

    return manifest(spark, rows).mapInPandas(get, "doc_id long, start long, n_tokens long, ids_crc32 long, part long")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, root: str | None = None) -> DataFrame:
    """Write docs as token files below root (the shared folder if None) and return what reading them gives."""
    spark = docs.sparkSession
    shared_dir(spark)
    root = root or scratch(spark, "tokens")
    rows = write(docs, root, vocabulary, end_id)
    write_offsets(spark, root, rows)
    return read(spark, root, rows)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), default_vocabulary())
