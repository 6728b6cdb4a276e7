"""Queries over media content, and decisions about merging it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import compare, media
from ..sources import repository as repo
from ..sources.repository import with_tables
from .registry import query

BOX = "unhex(concat(lpad(hex(octet_length(html) + 8), 8, '0'), hex('{0}'), hex(html)))"


@query("""WITH p AS (SELECT page_id, octet_length(encode(html)) AS n FROM pages)
  SELECT page_id, 0 AS seq, 'ftyp' AS type, 0 AS "offset", 16 AS size FROM p UNION ALL SELECT page_id, 1, 'mdat', 16, n + 8 FROM p UNION ALL SELECT page_id, 2, 'free', n + 24, 8 FROM p""")
def media_segments(s, d):
    """Pages as the media data of small files: a type box, movie data and a free box."""
    raw = F.concat(F.unhex(F.lit("0000001066747970")), F.lit("isom0000").cast("binary"), F.expr(BOX.format("mdat")), F.unhex(F.lit("0000000866726565")))
    return media.segments(repo.table(s, d, "pages").select("page_id", raw.alias("x")), "page_id", "x")


@query("SELECT p_partkey AS id, kind AS type FROM part, (VALUES (0, 'png'), (1, 'jpeg'), (2, 'glb'), (3, 'wav'), (4, 'mp4'), (5, 'text'), (6, 'binary')) v(k, kind) WHERE p_partkey % 7 = k")
def magic_types(s, d):
    heads = ["89504E470D0A1A0A00", "FFD8FFE000", "676C544602000000", "524946461000000057415645", "000000106674797069736F6D", "706C61696E20746578740A", "00FF00FE01"]
    data = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("p_partkey") % 7 + 1).cast("int")))
    return repo.table(s, d, "part").select(F.col("p_partkey").alias("id"), scalar.magic_type(data).alias("type"))


@query("SELECT p_partkey AS id, p_size * 3 AS width, p_partkey % 5000 AS height FROM part")
def image_sizes(s, d):
    four = lambda c: F.lpad(F.hex(c), 8, "0")
    data = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four(F.col("p_size").cast("long") * 3), four(F.col("p_partkey").cast("long") % 5000), F.lit("0806000000")))
    t = repo.table(s, d, "part").select(F.col("p_partkey").alias("id"), media.image_size(data).alias("x"))
    return t.select("id", F.col("x.width").alias("width"), F.col("x.height").alias("height"))


HASHES = "h AS (SELECT p_partkey AS id, p_partkey % 11 <> 0 AS same_size, p_partkey * 40503 AS b, xor(p_partkey * 40503, p_size) AS o, xor(p_partkey * 40503, CAST(p_partkey % 6 AS BIGINT)) AS t FROM part)"


@query(f"WITH {HASHES}, v AS (SELECT id, same_size, 1 - bit_count(xor(b, o)) / 64.0 AS bo, 1 - bit_count(xor(b, t)) / 64.0 AS bt, 1 - bit_count(xor(o, t)) / 64.0 AS \"ot\" FROM h) SELECT id, CASE WHEN NOT same_size THEN 'dimensions' WHEN least(bo, bt, \"ot\") >= 0.95 THEN 'auto' ELSE 'content' END AS decision FROM v")
def image_decisions(s, d):
    b = F.col("p_partkey") * 40503
    o, t = b.bitwiseXOR(F.col("p_size").cast("long")), b.bitwiseXOR((F.col("p_partkey") % 6).cast("long"))
    near = scalar.hamming_similarity
    return repo.table(s, d, "part").select(F.col("p_partkey").alias("id"), media.image_decision(F.col("p_partkey") % 11 != 0, near(b, o), near(b, t), near(o, t)).alias("decision"))


@query("WITH r AS (SELECT l_orderkey AS k, l_linenumber AS id, l_quantity AS x0, l_quantity + 20 AS x1, l_discount * 100 AS y0, l_discount * 100 + 5 AS y1 FROM lineitem) SELECT a.k, a.id AS a, b.id AS b, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 3) AS area FROM r a JOIN r b USING (k) WHERE a.id = 1 AND b.id > 1 AND round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 3) > 0 AND least(a.y1, b.y1) > greatest(a.y0, b.y0) AND least(a.x1, b.x1) > greatest(a.x0, b.x0)")
def layer_conflicts(s, d):
    r = repo.table(s, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 20).alias("x1"), (F.col("l_discount") * 100).alias("y0"), (F.col("l_discount") * 100 + 5).alias("y1"))
    return media.layer_overlaps(r.where("id = 1"), r.where("id > 1"), "k").select("k", "a", "b", F.round("area", 3).alias("area")).where("area > 0")


@query(with_tables("ours theirs", "SELECT path, oid, mode FROM ours UNION ALL SELECT path, oid, mode FROM theirs WHERE path NOT IN (SELECT path FROM ours)"))
def united_tracks(s, d):
    ours, theirs = (repo.tree(s, d, x).select("path", "oid", "mode") for x in ("ours", "theirs"))
    return media.united(ours, theirs, "path")


@query("SELECT o.p_partkey AS id, coalesce(CASE WHEN o.p_partkey % 3 <> 0 THEN o.p_brand END, o.p_type) AS title, array_to_string(list_sort(list_distinct([o.p_brand, o.p_type, o.p_name])), ',') AS keywords, greatest(o.p_size, o.p_partkey % 50) AS rating FROM part o")
def merged_metadata(s, d):
    p = repo.table(s, d, "part")
    ours = F.struct(F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("title"), F.array("p_brand", "p_type").alias("keywords"), F.col("p_size").cast("long").alias("rating"))
    theirs = F.struct(F.col("p_type").alias("title"), F.array("p_type", "p_name").alias("keywords"), (F.col("p_partkey") % 50).alias("rating"))
    t = p.select(F.col("p_partkey").alias("id"), ours.alias("o"), theirs.alias("t")).select("id", *media.metadata_merge("o", "t", ["title"], ["keywords"], ["rating"]))
    return t.withColumn("keywords", F.array_join("keywords", ","))


@query("WITH seg AS (SELECT l_orderkey AS track, l_linenumber AS id, l_linenumber * 10 AS lo, l_linenumber * 10 + l_quantity AS hi FROM lineitem) SELECT x.track, x.id AS id_a, y.id AS id_b, CAST(least(x.hi, y.hi) - greatest(x.lo, y.lo) AS DOUBLE) AS overlap FROM seg x JOIN seg y ON x.track = y.track AND x.id % 2 = 0 AND y.id % 2 = 1 AND x.lo < y.hi AND x.hi > y.lo")
def track_overlaps(s, d):
    seg = repo.table(s, d, "lineitem").select(F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("id"), (F.col("l_linenumber") * 10).alias("lo"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).alias("hi"))
    return compare.overlaps(seg.where("id % 2 = 0"), seg.where("id % 2 = 1"), "track")
