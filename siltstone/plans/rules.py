"""Queries over the rules that go by names, sizes and content: types, eligibility, strategies, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filetypes as ft
from ..operators import content, storage
from ..operators.media import sign_hash
from ..sources import repository as repo
from .registry import query

#: Every extension of the tables, and some that none has.
KNOWN = sorted({w for t in (*ft.CATEGORIES.values(), *ft.MEDIA_TYPES.values(), *ft.STRATEGIES.values(), ft.CHUNKED_FROM_5MB, ft.NEVER_CHUNKED, ft.ALWAYS_DELTA, ft.DELTA_OVER_1MB, *ft.LEAST_SCORE.values(), *ft.LEAST_RATIO.values()) for w in t.split()} | {"xyz", "tar", "sqlite"})
#: Sizes on both sides of every bound.
SIZES = [0, 1023, 1024, 1025, 102_400, 102_401, 1 << 20, (1 << 20) + 1, (5 << 20) - 1, 5 << 20, 10 << 20, (10 << 20) + 1, 50 << 20, (50 << 20) + 1, 100 << 20, (100 << 20) + 1, (500 << 20) - 1, 500 << 20]

_EXT = f"list_value({', '.join(repr(x) for x in KNOWN)})[1 + p_partkey % {len(KNOWN)}]"
FILES_SQL = f"""files AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN upper(ext) WHEN 1 THEN '' ELSE ext END AS ext,
  CASE p_partkey % 5 WHEN 0 THEN 'a.b/f' || p_partkey || '.' || upper(ext) WHEN 1 THEN 'dir/.' || ext ELSE 'dir/f.' || p_partkey || '.' || ext END AS path, size
  FROM (SELECT p_partkey, {_EXT} AS ext, unnest([{', '.join(map(str, SIZES))}]) AS size FROM part))"""


def files(s, d) -> DataFrame:
    """id, path, size: each extension at each size; some names are in upper case, some begin with their only dot."""
    ext = F.element_at(F.array(*map(F.lit, KNOWN)), (F.col("p_partkey") % len(KNOWN) + 1).cast("int"))
    key = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("a.b/f"), key, F.lit("."), F.upper(ext))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("dir/."), ext)).otherwise(F.concat(F.lit("dir/f."), key, F.lit("."), ext))
    return repo.table(s, d, "part").select(F.col("p_partkey").alias("id"), path.alias("path"), F.explode(F.array(*(F.lit(n).cast("long") for n in SIZES))).alias("size"))


def _in(words: str) -> str:
    return "lower(ext) IN (" + ", ".join(f"'{w}'" for w in words.split()) + ")"


def _case(table: dict, default) -> str:
    of = lambda x: f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE"
    return "CASE " + " ".join(f"WHEN {_in(words)} THEN {of(k)}" for k, words in table.items()) + f" ELSE {of(default)} END"


@query(f"WITH {FILES_SQL} SELECT DISTINCT id, {_case(ft.CATEGORIES, 'other')} AS category, {_case(ft.MEDIA_TYPES, 'unknown')} AS media_type, {_case(ft.FILE_CLASSES, 'other').replace('lower(ext)', "regexp_extract(lower(path), '[.]([^./]*)$', 1)")} AS class FROM files")
def file_types(s, d):
    return files(s, d).select("id", ft.category(F.col("path")).alias("category"), ft.media_type(F.col("path")).alias("media_type"), ft.file_class(F.col("path")).alias("class")).distinct()


@query(
    f"""WITH {FILES_SQL} SELECT id, size,
  size >= 5242880 AND ({_in(ft.CHUNKED_FROM_5MB)} OR (size > 10485760 AND NOT {_in(ft.NEVER_CHUNKED)})) AS chunked,
  NOT {_in(ft.NEVER_DELTA)} AND ({_in(ft.ALWAYS_DELTA)} OR size > CASE WHEN {_in(ft.DELTA_OVER_1MB)} THEN 1048576 WHEN {_in(ft.DELTA_OVER_100MB)} THEN 104857600 ELSE 52428800 END) AS delta,
  id % 7 = 0 OR (size >= 1024 AND NOT {_in(ft.NEVER_PACKED)} AND ({_in(ft.ALWAYS_PACKED)} OR size > CASE WHEN {_in(ft.PACKED_OVER_100KB)} THEN 102400 ELSE 1024 END)) AS packed FROM files"""
)
def storage_eligibility(s, d):
    path, size, kind = F.col("path"), F.col("size"), F.when(F.col("id") % 7 == 0, "tree").otherwise("blob")
    return files(s, d).select("id", "size", ft.chunked(path, size).alias("chunked"), ft.delta_wanted(path, size).alias("delta"), ft.packed(kind, path, size).alias("packed"))


@query(
    f"""WITH {FILES_SQL}, by_name AS (SELECT *, {_case(ft.STRATEGIES, 'zstd-default')} AS s FROM files)
  SELECT id, size, CASE WHEN s = 'brotli' AND size >= 524288000 THEN 'zstd-default' ELSE s END AS strategy, {_case(ft.LEAST_SCORE, 0.3)} AS score, {_case(ft.LEAST_RATIO, 0.8)} AS ratio,
  CASE WHEN size <= 1024 THEN 'tiny' WHEN size <= 102400 THEN 'small' WHEN size <= 10485760 THEN 'medium' WHEN size <= 104857600 THEN 'large' ELSE 'huge' END AS class FROM by_name"""
)
def storage_strategies(s, d):
    f = files(s, d).withColumn("t", ft.base_thresholds(F.col("path")))
    return f.select("id", "size", ft.strategy(F.col("path"), F.col("size")).alias("strategy"), "t.score", "t.ratio", ft.size_class(F.col("size")).alias("class"))


@query(
    """WITH b AS (SELECT doc_id, octet_length(encode(text)) AS n, regexp_extract_all(substr(hex(encode(text)), 1, 8192), '(..)', 1) AS x FROM documents WHERE text IS NOT NULL),
  e AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS bits FROM (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(x) AS c FROM b) GROUP BY ALL) GROUP BY doc_id),
  c AS (SELECT doc_id, CASE WHEN n <= 1024 THEN 'tiny' WHEN n <= 102400 THEN 'small' ELSE 'medium' END AS size, CASE WHEN coalesce(bits, 0) < 4 THEN 'very low' WHEN bits < 6 THEN 'low' WHEN bits < 7.5 THEN 'medium' ELSE 'high' END AS entropy,
    CASE WHEN n = 0 THEN 'binary' WHEN n >= 2 AND x[1] = '78' THEN 'compressed' WHEN n >= 4 AND x[1] = '42' AND x[2] = '4D' THEN 'media'
      WHEN len(list_filter(x, lambda y: y IN ('09', '0A', '0D') OR (y >= '20' AND y < '7F') OR y >= '80')) > 0.85 * least(n, 4096) THEN 'text' ELSE 'binary' END AS pattern FROM b LEFT JOIN e USING (doc_id))
  SELECT *, CASE WHEN pattern IN ('compressed', 'media') OR entropy = 'high' THEN 'store' WHEN size = 'tiny' AND entropy IN ('very low', 'low') THEN 'brotli-best'
    WHEN size = 'small' AND entropy IN ('very low', 'low') THEN CASE pattern WHEN 'text' THEN 'brotli-best' ELSE 'brotli-default' END WHEN size = 'medium' AND entropy = 'very low' THEN 'brotli-default' ELSE 'zstd-default' END AS strategy FROM c"""
)
def content_profiles(s, d):
    docs = repo.table(s, d, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("data"))
    bits = content.byte_entropy(docs, "doc_id", "data")
    c = docs.join(bits, "doc_id", "left").select("doc_id", ft.size_class(F.octet_length("data")).alias("size"), ft.entropy_class(F.coalesce("bits", F.lit(0.0))).alias("entropy"), ft.pattern_class(F.col("data")).alias("pattern"))
    return c.withColumn("strategy", ft.profile_strategy(F.col("size"), F.col("entropy"), F.col("pattern")))


@query(
    """WITH h AS (SELECT vec_id AS id, CAST(array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS BIT) AS x FROM embeddings),
  s AS (SELECT b.id, 1 - bit_count(xor(b.x, o.x)) / 64.0 AS so, 1 - bit_count(xor(b.x, t.x)) / 64.0 AS st, 1 - bit_count(xor(o.x, t.x)) / 64.0 AS m FROM h b JOIN h o ON o.id = b.id + 1 JOIN h t ON t.id = b.id + 2)
  SELECT id, CASE WHEN so > 0.95 AND st > 0.95 THEN CASE WHEN m > 0.95 THEN 'identical' ELSE 'minor' END WHEN so < 0.8 AND st < 0.8 THEN 'conflict' WHEN so < 0.8 OR st < 0.8 THEN 'asymmetric' ELSE 'minor' END AS change FROM s"""
)
def image_changes(s, d):
    """Vectors as an image's versions: each with the two after it as our and their change."""
    from ..functions.scalar import hamming_similarity as like

    h = repo.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), sign_hash(F.col("embedding")).alias("x"))
    j = h.join(h.select((F.col("id") - 1).alias("id"), F.col("x").alias("o")), "id").join(h.select((F.col("id") - 2).alias("id"), F.col("x").alias("t")), "id")
    x, o, t = F.col("x"), F.col("o"), F.col("t")
    return j.select("id", ft.image_change(like(x, o), like(x, t), like(o, t)).alias("change"))


# stored objects


def _contents(s, d) -> DataFrame:
    docs = repo.table(s, d, "documents").where("text is not null")
    plan = F.element_at(F.array(*map(F.lit, ("store", "zlib", "zstd-fast", "zstd-default", "brotli"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select("doc_id", F.col("text").cast("binary").alias("data"), plan.alias("strategy"))


@query("SELECT DISTINCT sha256(text) AS oid, CAST(octet_length(encode(text)) AS BIGINT) AS size, 'ok' AS result FROM documents WHERE text IS NOT NULL UNION ALL SELECT repeat('0', 64), NULL, 'missing'")
def object_reads(s, d):
    """Documents stored by all strategies, read back and held against their ids; one id that isn't there."""
    stored = storage.put(_contents(s, d))
    absent = s.range(1).select(F.lit("0" * 64).alias("oid"))
    return storage.get(stored, stored.select("oid").unionByName(absent)).select("oid", F.octet_length("data").cast("long").alias("size"), "result")


@query("SELECT DISTINCT sha256(text) AS oid FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 1 AND text IS NOT NULL)")
def object_writes(s, d):
    """What writing the even documents adds to a store that has the odd ones."""
    c = _contents(s, d)
    return storage.put(c.where("doc_id % 2 = 0"), storage.put(c.where("doc_id % 2 = 1"))).select("oid")


@query("SELECT DISTINCT sha256(text) AS oid, 'ok' AS result, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0 UNION ALL SELECT repeat('0', 64), 'missing', NULL")
def pack_reads(s, d):
    """Documents written to packs of about 64 KB; a third of them and an unknown id looked up and held against their ids."""
    docs = _contents(s, d).select("doc_id", storage.object_id(F.col("data")).alias("oid"), "data")
    objects = docs.dropDuplicates(["oid"]).select("oid", "data")
    index = storage.pack_index(objects, 64 << 10, 4)
    wanted = docs.where("doc_id % 3 = 0").select("oid").unionByName(s.range(1).select(F.lit("0" * 64).alias("oid")))
    return storage.read_packs(storage.write_packs(objects, index), index, wanted).select("oid", "result", F.octet_length("data").alias("size"))
