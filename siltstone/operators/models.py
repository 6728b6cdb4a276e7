"""What the bytes of 3-D models tell: counts, materials and bounds. Built-in expressions over whole files; no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.filetypes import extension

#: Formats by the ending of the name.
FORMATS = {"obj": "obj", "fbx": "fbx", "blend": "blend", "gltf": "gltf", "glb": "glb", "stl": "stl", "usd": "usd usda usdc usdz", "ply": "ply"}
#: What files of a format begin with, in hex; others of the format aren't read.
HEADS = {"fbx": b"Kaydara FBX Binary".hex(), "fbx text": b"; FBX".hex(), "blend": b"BLENDER".hex(), "glb": b"glTF".hex(), "stl text": b"solid".hex()}
#: The least size of a file that is read, in bytes.
LEAST = {"fbx": 23, "blend": 12, "stl": 84}
_LINE = r"(?m)^[^\S\n]*"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _names(text: Column, pattern: str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(_LINE + pattern), F.lit(1))))


def _bounds(text: Column) -> Column:
    """x0, y0, z0, x1, y1, z1 of the vertex lines that have three numbers; null if none has."""
    rows = F.regexp_extract_all(text, F.lit(_LINE + r"v [^\S\n]*(\S+[^\S\n]+\S+[^\S\n]+\S+)"), F.lit(1))
    at = lambda x, i: F.element_at(F.split(x, r"\s+"), i + 1).try_cast("float")
    points = F.filter(F.transform(rows, lambda x: F.struct(*(at(x, i).alias(c) for i, c in enumerate("xyz")))), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["z"].isNotNull())
    side = lambda pick, c: pick(F.transform(points, lambda p: p[c]))
    box = F.struct(*(side(F.array_min, c).alias(c + "0") for c in "xyz"), *(side(F.array_max, c).alias(c + "1") for c in "xyz"))
    return F.when(F.size(points) > 0, box)


def _info(vertices=0, faces=0, objects=1, materials=None, animated=False, rigged=False, box=None) -> Column:
    of = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    box_type = "struct<" + ",".join(f"{c}{i}:float" for i in (0, 1) for c in "xyz") + ">"
    return F.struct(
        of(vertices, "long").alias("vertices"), of(faces, "long").alias("faces"), F.greatest(F.lit(1), of(objects, "long")).cast("long").alias("objects"),
        (F.array().cast("array<string>") if materials is None else materials).alias("materials"), of(animated, "boolean").alias("animated"), of(rigged, "boolean").alias("rigged"), of(box, box_type).alias("box"),
    )


def model_format(path: Column) -> Column:
    ext, out = extension(path), F
    for kind, words in FORMATS.items():
        out = out.when(ext.isin(words.split()), kind)
    return out


def model_info(path: Column, data: Column) -> Column:
    """Struct (vertices, faces, objects, materials, animated, rigged, box) of a model; null for other files and for bytes that
    aren't of the format. Counts are 0 where only a full reader could tell; objects are at least 1. A model without a vertex
    has no box. ASCII FBX counts its vertex lists."""
    data = data.cast("binary")
    size, text, kind, ext = F.octet_length(data), F.make_valid_utf8(data.cast("string")), model_format(path), extension(path)
    begins = lambda name: F.startswith(F.lower(F.hex(F.substring(data, 1, 24))), F.lit(HEADS[name]))
    utf8 = F.is_valid_utf8(data.cast("string"))
    header = F.regexp_extract(text, r"(?s)^(.*?)end_header\r?\n", 1)
    element = lambda name: F.coalesce(F.regexp_extract(header, rf"(?m)^element {name} [^\S\n]*(\d+)", 1).try_cast("long"), F.lit(0))
    le = lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("long")
    little = le(81) + le(82) * 256 + le(83) * 65536 + le(84) * (1 << 24)
    facets, moving = _count(text, "facet normal"), {"animated": True, "rigged": True}
    obj = _info(_count(text, _LINE + r"v [^\n]*\S"), _count(text, _LINE + r"f [^\n]*\S"), _count(text, _LINE + r"[og] [^\n]*\S"), _names(text, r"usemtl [^\S\n]*(\S+)"), box=_bounds(text))
    fbx_text = _info(_count(text, r"(?m)^.*Vertices:"), 0, _count(text, _LINE + "Model:(?!.*Vertices:)"), _names(text, r'Material:[^"\n]*"([^"\n]*)'), **moving)
    usd_objects = F.when(ext == "usda", _count(text, "def Xform") + _count(text, "def Mesh")).otherwise(1)
    return (
        F.when(kind.isNull() | data.isNull(), None)
        .when((kind == "obj") & utf8, obj)
        .when((kind == "fbx") & (size >= LEAST["fbx"]) & begins("fbx"), _info(**moving))
        .when((kind == "fbx") & (size >= LEAST["fbx"]) & begins("fbx text") & utf8, fbx_text)
        .when((kind == "blend") & (size >= LEAST["blend"]) & begins("blend"), _info(**moving))
        .when(kind.isin("gltf", "glb") & begins("glb"), _info(**moving))
        .when(kind.isin("gltf", "glb") & utf8, _info(objects=_count(text, '"meshes"'), **moving))
        .when((kind == "stl") & begins("stl text"), _info(3 * facets, facets))
        .when((kind == "stl") & (size >= LEAST["stl"]), _info(3 * little, little))
        .when(kind == "usd", _info(objects=usd_objects, animated=ext != "usdz"))
        .when((kind == "ply") & F.contains(data, F.lit(b"end_header")) & (F.regexp_count(text, F.lit(r"end_header\r?\n")) > 0), _info(element("vertex"), element("face")))
    )
