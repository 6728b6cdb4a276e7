"""Queries that decide merges of media files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filetypes
from ..operators import decisions
from ..sources import repository as repo
from .registry import query
from .rules import FILES_SQL, files

#: Versions of a layer as (side, rows it has, shift, opacity, blend, kind, parent), in terms that both engines read.
VERSIONS = {
    "base": ("(p_partkey + p_size) % 13 <> 1", "0", "100", "'normal'", "CASE WHEN (p_partkey + p_size) % 3 = 0 THEN 'smart_object' ELSE 'pixel' END", "CASE WHEN (p_partkey + p_size) % 2 = 0 THEN 'g1' END"),
    "ours": ("(p_partkey + p_size) % 13 <> 2", "CASE WHEN (p_partkey + p_size) % 5 = 0 THEN 3 ELSE 0 END", "CASE WHEN (p_partkey + p_size) % 15 = 2 THEN 50 ELSE 100 END", "CASE WHEN (p_partkey + p_size) % 15 = 4 THEN 'screen' ELSE 'normal' END", "CASE WHEN (p_partkey + p_size) % 3 = 0 THEN 'smart_object' ELSE 'pixel' END", "CASE WHEN (p_partkey + p_size) % 11 = 0 THEN 'g2' WHEN (p_partkey + p_size) % 2 = 0 THEN 'g1' END"),
    "theirs": ("(p_partkey + p_size) % 13 <> 3", "CASE WHEN (p_partkey + p_size) % 10 = 0 THEN 4 ELSE 0 END", "100", "CASE WHEN (p_partkey + p_size) % 15 IN (4, 7) THEN 'multiply' ELSE 'normal' END", "CASE WHEN (p_partkey + p_size) % 3 = 0 THEN 'smart_object' ELSE 'pixel' END", "CASE WHEN (p_partkey + p_size) % 7 = 0 THEN NULL WHEN (p_partkey + p_size) % 2 = 0 THEN 'g1' END"),
}


def _layers(side: str) -> list[str]:
    _, shift, opacity, blend, kind, parent = VERSIONS[side]
    x0, y0 = f"p_partkey % 6 * 30 + {shift}", "(p_partkey + p_size) % 50"
    fields = {"doc": "p_partkey - p_partkey % 6", "name": "p_partkey % 6", "x0": x0, "y0": y0, "x1": f"{x0} + 40", "y1": f"{y0} + 30", "opacity": opacity, "visible": "(p_partkey + p_size) % 4 <> 0", "blend": blend, "kind": kind, "parent": parent}
    return [f"{v} AS {k}" for k, v in fields.items()]


_DIFFERS = "({0}.x0, {0}.y0, {0}.x1, {0}.y1, {0}.opacity, {0}.visible, {0}.blend, {0}.kind) IS DISTINCT FROM (b.x0, b.y0, b.x1, b.y1, b.opacity, b.visible, b.blend, b.kind)"
_CHANGED = {x: f"SELECT * FROM {x} v WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc = v.doc AND b.name = v.name AND NOT {_DIFFERS.format('v')})" for x in ("ours", "theirs")}
_AREA = "least(o.x1, t.x1) > greatest(o.x0, t.x0) AND least(o.y1, t.y1) > greatest(o.y0, t.y0)"


@query(f"""WITH {', '.join(f"{x} AS (SELECT {', '.join(_layers(x))} FROM part WHERE {VERSIONS[x][0]})" for x in VERSIONS)}, o AS ({_CHANGED['ours']}), t AS ({_CHANGED['theirs']})
  SELECT o.doc, 'both' AS conflict, o.name, t.name AS other FROM o JOIN t ON o.doc = t.doc AND o.name = t.name
  UNION ALL SELECT o.doc, 'overlap', o.name, t.name FROM o JOIN t ON o.doc = t.doc AND o.name <> t.name AND {_AREA}
  UNION ALL SELECT o.doc, 'blend', o.name, t.name FROM o JOIN t ON o.doc = t.doc AND o.name = t.name AND o.blend <> t.blend
  UNION ALL SELECT o.doc, 'smart_object', o.name, t.name FROM o JOIN t ON o.doc = t.doc AND o.name = t.name AND o.kind = 'smart_object' AND t.kind = 'smart_object'
  UNION ALL SELECT b.doc, 'group', b.name, b.name FROM base b JOIN ours x ON b.doc = x.doc AND b.name = x.name JOIN theirs y ON b.doc = y.doc AND b.name = y.name
    WHERE x.parent IS DISTINCT FROM y.parent AND (x.parent IS DISTINCT FROM b.parent OR y.parent IS DISTINCT FROM b.parent)""")
def layer_decisions(s, d):
    p = repo.table(s, d, "part")
    return decisions.layer_conflicts(*(p.where(v[0]).selectExpr(*_layers(x)) for x, v in VERSIONS.items()), "doc")


def _sides(fields: dict[str, tuple[str, str, str]]) -> list[str]:
    """Structs of the three versions, each field as (base, ours, theirs)."""
    return ["named_struct(" + ", ".join(f"'{k}', {v[i]}" for k, v in fields.items()) + f") AS {side}" for i, side in enumerate(("base", "ours", "theirs"))]


_FORMAT = ("'obj'", "CASE WHEN p_partkey % 17 = 0 THEN 'stl' ELSE 'obj' END", "'obj'")
_VERTICES = ("p_size", "p_size + p_partkey % 3", "p_size - p_partkey % 2")
_MATERIALS = ("5", "5 + p_partkey % 4", "5 + p_partkey % 5")
_EDGE = ("p_size", "p_size + p_partkey % 5", "p_size + p_partkey % 7")
_LO = ("0", "0", "p_partkey % 60")


@query(f"""SELECT p_partkey AS id, CASE WHEN {_FORMAT[1]} <> 'obj' THEN 'format' ELSE concat_ws(',', CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 <> 0 THEN 'vertices' END, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 THEN 'materials' END,
  CASE WHEN p_partkey % 8 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND {_LO[2]} <= {_EDGE[1]} THEN 'box' END) END AS reasons FROM part""")
def model_decisions(s, d):
    """Models of which every eighth has no box."""
    box = tuple("CASE WHEN p_partkey % 8 <> 0 THEN named_struct(" + ", ".join(f"'{c}0', {lo}, '{c}1', {lo} + {e}" for c in "xyz") + ") END" for lo, e in zip(_LO, _EDGE, strict=True))
    p = repo.table(s, d, "part").selectExpr("p_partkey AS id", *_sides({"format": _FORMAT, "vertices": _VERTICES, "materials": _MATERIALS, "box": box}))
    return p.select("id", F.array_join(decisions.model_conflicts(F.col("base"), F.col("ours"), F.col("theirs")), ",").alias("reasons"))


_PAGES = ("CASE WHEN p_partkey % 6 <> 0 THEN 10 END", "10 + p_partkey % 2", "10 + p_partkey % 3")
_LAYERS = ("p_size", "p_size + p_partkey % 7", "p_size + p_partkey % 4")
_DURATION = ("30.0D", "30.0D + (p_partkey % 5) * 0.06D", "30.0D - (p_partkey % 4) * 0.04D")
_ASSETS = ("3", "3 + p_partkey % 3", "3 - p_partkey % 2")


@query(f"""SELECT p_partkey AS id, CASE WHEN {_FORMAT[1]} <> 'obj' THEN 'format' ELSE concat_ws(',', CASE WHEN p_partkey % 6 <> 0 AND p_partkey % 2 <> 0 AND p_partkey % 3 <> 0 THEN 'pages' END, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 4 <> 0 THEN 'layers' END,
  CASE WHEN (p_partkey % 5) * 0.06 > 0.1 AND (p_partkey % 4) * 0.04 > 0.1 THEN 'duration' END, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 <> 0 THEN 'assets' END) END AS reasons FROM part""")
def project_decisions(s, d):
    p = repo.table(s, d, "part").selectExpr("p_partkey AS id", *_sides({"format": _FORMAT, "pages": _PAGES, "layers": _LAYERS, "duration": _DURATION, "assets": _ASSETS}))
    return p.select("id", F.array_join(decisions.project_conflicts(F.col("base"), F.col("ours"), F.col("theirs")), ",").alias("reasons"))


_TABLE = " ".join(f"WHEN list_contains({w.split()!r}, lower(regexp_extract(path, '[^/.][^/]*[.]([^./]*)$', 1))) THEN '{k}'" for k, w in filetypes.MEDIA_TYPES.items())


@query(f"WITH {FILES_SQL} SELECT id, CASE {_TABLE} ELSE 'conflict' END AS merge FROM files")
def merge_dispatch(s, d):
    return files(s, d).select("id", decisions.merge_of(filetypes.media_type(F.col("path"))).alias("merge"))
