"""Objects as stored: compression with a fallback, content-addressed reads that are verified, packs and their index."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels of the strategies. Brotli isn't at hand everywhere: its texts go to Zstandard's highest usual level.
LEVELS = {"zstd-fast": 1, "zstd-default": 3, "zstd-best": 19, "brotli": 19}
#: Fixed value: the byte before content that is stored as it is.
STORED = b"\0"


def _packed(data: bytes, strategy: str) -> bytes:
    import zstandard

    if strategy == "zlib":
        out = zlib.compress(data)
    elif strategy in LEVELS:
        out = zstandard.ZstdCompressor(level=LEVELS[strategy]).compress(data)
    else:
        return STORED + data
    return out if len(out) < len(data) else STORED + data


def _unpacked(data: bytes) -> bytes:
    import zstandard

    if data[:1] == STORED:
        return data[1:]
    if data[:4] == zstandard.FRAME_HEADER:
        return zstandard.ZstdDecompressor().decompress(data)
    if len(data) > 1 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompress(data)
    return data


@F.pandas_udf(T.BinaryType())
def compress(data: pd.Series, strategy: pd.Series) -> pd.Series:
    """Content by its strategy (store, zlib, zstd-*, brotli); as it is, after a zero byte, where that isn't smaller."""
    return pd.Series([None if x is None else _packed(bytes(x), s) for x, s in zip(data, strategy, strict=True)])


@F.pandas_udf(T.BinaryType())
def decompress(data: pd.Series) -> pd.Series:
    """What compress() was given, by the leading bytes; content of no known form as it is."""
    return pd.Series([None if x is None else _unpacked(bytes(x)) for x in data])


def object_id(data: Column) -> Column:
    return F.sha2(data, 256)


def object_kind(data: Column) -> Column:
    """commit, tree or blob, by the form of the first line: `tree <id>` begins a commit, `<mode> <name> <id>` a tree."""
    line = F.split_part(F.decode(F.substring(data, 1, 4096), "ISO-8859-1"), F.lit("\n"), F.lit(1))
    return F.when(line.rlike("^tree [0-9a-f]{64}$"), "commit").when(line.rlike("^[0-7]{5,6} .+ [0-9a-f]{64}$"), "tree").otherwise("blob")


def put(contents: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """contents (data, strategy) -> oid, size, data (compressed) of the objects that a write adds: each content once, and
    none whose id is stored already. Ids are made before the shuffle, and equal content is dropped in each task first."""
    new = contents.where(F.col("data").isNotNull()).select(object_id(F.col("data")).alias("oid"), F.octet_length("data").cast("long").alias("size"), "data", "strategy").dropDuplicates(["oid"])
    if stored is not None:
        new = new.join(stored.select("oid"), "oid", "left_anti")
    return new.select("oid", "size", compress("data", "strategy").alias("data"))


def get(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """stored (oid, data compressed), wanted (oid) -> oid, data, result: ok, missing, or corrupt where the content's hash
    isn't the id; data is null unless ok. Only wanted objects are decompressed."""
    found = wanted.select("oid").distinct().join(stored.select("oid", F.col("data").alias("packed")), "oid", "left")
    read = found.withColumn("content", decompress("packed"))
    result = F.when(F.col("packed").isNull(), "missing").when(object_id(F.col("content")) == F.col("oid"), "ok").otherwise("corrupt")
    return read.select("oid", F.when(result == "ok", F.col("content")).alias("data"), result.alias("result"))


def pack_index(objects: DataFrame, most: int = 64 << 20, shards: int = 256) -> DataFrame:
    """objects (oid, data) -> oid, pack, offset, size: where each object lies. Objects are dealt to shards by id; a shard is
    cut where its running size passes a multiple of `most`, so a pack has at most that and one object."""
    size = F.octet_length("data").cast("long")
    before = W.partitionBy("shard").orderBy("oid").rowsBetween(W.unboundedPreceding, -1)
    at = objects.select("oid", size.alias("size"), F.pmod(F.xxhash64("oid"), F.lit(shards)).alias("shard")).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    at = at.withColumn("part", F.floor(F.col("start") / F.lit(most)))
    first = F.min("start").over(W.partitionBy("shard", "part"))
    return at.select("oid", F.format_string("pack-%03d-%06d", F.col("shard").cast("int"), F.col("part").cast("int")).alias("pack"), (F.col("start") - first).alias("offset"), "size")


def write_packs(objects: DataFrame, index: DataFrame) -> DataFrame:
    """pack, data, checksum: the packs' bytes, objects in the order of their offsets. A pack's size is bounded by its index."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = b"".join(pdf.sort_values("offset")["data"])
        return pd.DataFrame({"pack": [pdf["pack"].iloc[0]], "data": [whole]})

    placed = objects.select("oid", "data").join(index.select("oid", "pack", "offset"), "oid")
    packs = placed.select("pack", "offset", "data").groupBy("pack").applyInPandas(join, "pack string, data binary")
    return packs.select("pack", "data", object_id(F.col("data")).alias("checksum"))


def read_packs(packs: DataFrame, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (oid) -> oid, data, result (ok, missing, corrupt): index entries cut out of their packs and held against their
    ids. Wanted entries of one pack are listed first, so each pack goes through the join once."""
    asked = wanted.select("oid").distinct().join(index, "oid", "left")
    listed = asked.where("pack is not null").groupBy("pack").agg(F.collect_list(F.struct("oid", "offset", "size")).alias("entries"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for entries, data in zip(pdf["entries"], pdf["data"], strict=True):
                yield pd.DataFrame([(e["oid"], None if data is None else data[e["offset"] : e["offset"] + e["size"]]) for e in entries], columns=["oid", "data"])

    found = listed.join(packs.select("pack", "data"), "pack", "left").select("entries", "data").mapInPandas(cut, "oid string, data binary")
    gone = asked.where("pack is null").select("oid", F.lit(None).cast("binary").alias("data"))
    result = F.when(F.col("data").isNull(), "missing").when(object_id(F.col("data")) == F.col("oid"), "ok").otherwise("corrupt")
    return found.unionByName(gone).select("oid", F.when(result == "ok", F.col("data")).alias("data"), result.alias("result"))


def repack_stats(objects: DataFrame, index: DataFrame) -> DataFrame:
    """objects (oid, data), index -> loose, packed, packs, loose_bytes, packed_bytes: what a repack would move."""
    j = objects.select("oid", F.octet_length("data").cast("long").alias("n")).join(index.select("oid", "pack"), "oid", "left")
    loose = F.col("pack").isNull()
    return j.agg(F.count_if(loose).alias("loose"), F.count_if(~loose).alias("packed"), F.countDistinct("pack").alias("packs"), F.coalesce(F.sum(F.when(loose, F.col("n"))), F.lit(0)).alias("loose_bytes"), F.coalesce(F.sum(F.when(~loose, F.col("n"))), F.lit(0)).alias("packed_bytes"))
