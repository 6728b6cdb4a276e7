"""Deltas as stored: a container of sizes and Zstandard data, and reads through chains of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .content import zstd_delta

#: The bytes that a container begins with, and its sizes as 7-bit groups, low ones first, of 32-bit numbers.
MAGIC = "5A44"
_SIZE = "((?:[89A-F][0-9A-F]){0,4}[0-7][0-9A-F])"


def varint(n: Column) -> Column:
    """Hex of a number under 2^32 in groups of 7 bits, the low ones first; all bytes but the last have their top bit set.
    Null for other numbers."""
    n = n.cast("long")
    byte = lambda i: F.shiftrightunsigned(n, 7 * i).bitwiseAND(127) + F.when(n >= 1 << 7 * (i + 1), 128).otherwise(0)
    digits = [F.when(n >= (1 << 7 * i if i else 0), F.lpad(F.hex(byte(i)), 2, "0")) for i in range(5)]
    return F.when((n >= 0) & (n < 1 << 32), F.concat_ws("", *digits))


def from_varint(digits: Column) -> Column:
    high_first = F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1)))
    return F.aggregate(high_first, F.lit(0).cast("long"), lambda n, x: n * 128 + F.conv(x, 16, 10).cast("long").bitwiseAND(127))


def container(data: Column, base: Column) -> Column:
    """The delta of data to its base as it is stored; empty data has no payload."""
    payload = F.when(F.octet_length(data) == 0, F.unhex(F.lit(""))).otherwise(zstd_delta(data, base))
    return F.concat(F.unhex(F.concat(F.lit(MAGIC), varint(F.octet_length(base)), varint(F.octet_length(data)))), payload)


def parsed(delta: Column) -> Column:
    """Struct (base_size, result_size, payload), null for what isn't a container."""
    head = F.hex(F.substring(delta, 1, 12))
    shape = f"^{MAGIC}{_SIZE}{_SIZE}"
    of = lambda i: F.regexp_extract(head, shape, i)
    payload = F.substring(delta, (3 + (F.length(of(1)) + F.length(of(2))) / 2).cast("int"), F.octet_length(delta))
    return F.when(head.rlike(shape), F.struct(from_varint(of(1)).alias("base_size"), from_varint(of(2)).alias("result_size"), payload.alias("payload")))


@F.pandas_udf(T.BinaryType())
def _folded(parts: pd.Series) -> pd.Series:
    """Arrays of structs (base_size, result_size, payload), the whole content first: each delta applied to what came before;
    null where a size isn't as said or the data are broken."""
    import zstandard

    def one(steps):
        data = None
        for x in steps:
            payload = x["payload"]
            if data is None:
                data = payload
                continue
            if not payload:
                data = b""
            else:
                words = zstandard.ZstdCompressionDict(data, zstandard.DICT_TYPE_RAWCONTENT) if data else None
                try:
                    data = zstandard.ZstdDecompressor(dict_data=words).decompress(payload, max_output_size=max(1, int(x["result_size"])))
                except zstandard.ZstdError:
                    return None
            if len(data) != x["result_size"]:
                return None
        return data

    return pd.Series([None if p is None else one(p) for p in parts], dtype=object)


def read_chains(objects: DataFrame, wanted: DataFrame, most: int = 10) -> DataFrame:
    """objects (id, base, data): data is whole where base is null, else a container; wanted (id) -> id, depth, data.

    Chains are followed by ids alone, then all their parts are fetched in one join and folded, at most `most` + 1 an id.
    data is null where a chain is longer, broken, comes back to itself or doesn't give the sizes that it says."""
    links = objects.select("id", "base")
    at = wanted.join(links, "id").select("id", F.lit(0).alias("depth"), F.col("id").alias("node"), "base")
    parts = at
    for n in range(1, most + 1):
        at = at.where("base is not null").select("id", F.col("base").alias("node")).join(links.select(F.col("id").alias("node"), "base"), "node").select("id", F.lit(n).alias("depth"), "node", "base")
        parts = parts.unionByName(at)
    whole = F.struct(F.lit(None).cast("long").alias("base_size"), F.octet_length("data").cast("long").alias("result_size"), F.col("data").alias("payload"))
    fetched = parts.join(objects.select(F.col("id").alias("node"), "data"), "node").withColumn("part", F.when(F.col("base").isNull(), whole).otherwise(parsed(F.col("data"))))
    each = fetched.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("order"), F.col("base").isNull().alias("root"), "part"))).alias("parts"), F.max("depth").cast("long").alias("depth"))
    ok = F.element_at("parts", 1)["root"] & F.forall("parts", lambda x: x["part"].isNotNull())
    return each.select("id", "depth", _folded(F.when(ok, F.transform("parts", lambda x: x["part"]))).alias("data"))
