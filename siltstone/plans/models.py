"""Queries over 3-D models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models
from ..sources import repository as repo
from .registry import query

#: Files made from parts: (ending, hex of the content), all by counts that the SQL knows.
FILES = {
    "obj": "concat('# x\\n', repeat(concat('v 1.5 -2 ', p_size, '\\n'), p_partkey % 4), '  v 9 x 9\\nvn 1 1 1\\n', repeat('f 1 2 3\\n', p_size), 'usemtl b\\no one\\ng two\\nusemtl a\\nusemtl b')",
    "stl": "concat('solid s\\n', repeat('facet normal 0 0 1\\nendfacet\\n', p_size))",
    "ply": "concat('ply\\nelement vertex ', p_size, '\\nelement face ', p_partkey, '\\nend_header\\nelement vertex 9\\n')",
    "usda": "concat(repeat('def Xform \"a\"\\n', p_partkey % 3), repeat('def Mesh \"b\"\\n', p_partkey % 5))",
    "usdz": "'PK'",
    "gltf": "concat('{', repeat('\"meshes\":[],', p_partkey % 4), '}')",
    "fbx": "concat('; FBX 7.4.0 project file\\n', repeat('\\tModel: 1\\n\\tVertices: *3\\n', p_partkey % 4), 'Material: 7, \"m', p_partkey % 2, '\", \"\"\\n')",
    "blend": "CASE WHEN p_partkey % 3 = 0 THEN 'BLENDE' ELSE 'BLENDER-v280 data' END",
    "txt": "'v 1 2 3'",
}
#: vertices, faces, objects, materials, animated, rigged of each, in SQL of the other engine.
KNOWN = {
    "obj": ("p_partkey % 4 + 1", "p_size", "2", "'a,b'", "false", "false"),
    "stl": ("p_size * 3", "p_size", "1", "''", "false", "false"),
    "ply": ("p_size", "p_partkey", "1", "''", "false", "false"),
    "usda": ("0", "0", "greatest(1, p_partkey % 3 + p_partkey % 5)", "''", "true", "false"),
    "usdz": ("0", "0", "1", "''", "false", "false"),
    "gltf": ("0", "0", "greatest(1, p_partkey % 4)", "''", "true", "true"),
    "fbx": ("p_partkey % 4", "0", "greatest(1, p_partkey % 4)", "'m' || (p_partkey % 2)", "true", "true"),
    "blend": ("0", "0", "1", "''", "true", "true"),
}
_NAMES = ("vertices", "faces", "objects", "materials", "animated", "rigged")


@query(" UNION ALL ".join(f"""SELECT p_partkey AS id, '{kind}' AS kind, {', '.join(f'CAST({v} AS {"BIGINT" if i < 3 else "VARCHAR" if i == 3 else "BOOLEAN"}) AS {name}' for i, (v, name) in enumerate(zip(known, _NAMES, strict=True)))},
  CAST({"CASE WHEN p_partkey % 4 > 0 THEN p_size END" if kind == "obj" else "NULL"} AS DOUBLE) AS top FROM part{" WHERE p_partkey % 3 <> 0" if kind == "blend" else ""}""" for kind, known in KNOWN.items()))
def model_infos(s, d):
    """Counts, materials and the top of the box of models that part rows describe; what can't be read has no row."""
    made = F.explode(F.map_from_arrays(F.array(*map(F.lit, FILES)), F.array(*map(F.expr, FILES.values()))))
    p = repo.table(s, d, "part").select(F.col("p_partkey").alias("id"), made.alias("kind", "text"))
    info = p.select("id", "kind", models.model_info(F.concat(F.lit("dir/m."), F.col("kind")), F.col("text")).alias("m")).where("m is not null")
    return info.select("id", "kind", "m.vertices", "m.faces", "m.objects", F.array_join("m.materials", ",").alias("materials"), "m.animated", "m.rigged", F.col("m.box.z1").cast("double").alias("top"))
