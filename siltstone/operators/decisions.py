"""Whether two changed versions of one media file can be merged by themselves: layered images, models, project files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .media import layer_overlaps

#: What a layer's change shows in, its place in the hierarchy apart.
LAYER_FIELDS = ("x0", "y0", "x1", "y1", "opacity", "visible", "blend", "kind")
#: Fixed value: seconds by which durations may differ.
SAME_DURATION = 0.1
#: Types of media that have a merge of their own; any other file is a conflict.
MERGED_TYPES = ("image", "psd", "video", "audio", "model3d", "vfx")


def changed_layers(base: DataFrame, side: DataFrame, doc: str) -> DataFrame:
    """Layers of a side that base lacks by name or has otherwise."""
    old = base.select(doc, "name", *(F.col(c).alias(f"old_{c}") for c in LAYER_FIELDS), F.lit(True).alias("known"))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"old_{c}")), LAYER_FIELDS, F.col("known").isNotNull())
    return side.join(old, [doc, "name"], "left").where(~same).select(*side.columns)


def layer_conflicts(base: DataFrame, ours: DataFrame, theirs: DataFrame, doc: str) -> DataFrame:
    """(doc, name, x0, y0, x1, y1, opacity, visible, blend, kind, parent) three times, names unique in a document ->
    doc, conflict, name, other: `both` (a layer changed by both), `overlap` (two changed layers share an area), `blend`,
    `smart_object` (changed by both) and `group` (moved to unlike groups; null is no group)."""
    a, b = changed_layers(base, ours, doc), changed_layers(base, theirs, doc)
    both = a.alias("a").join(b.alias("b"), [doc, "name"])
    smart = (F.col("a.kind") == "smart_object") & (F.col("b.kind") == "smart_object")
    tests = {"both": F.lit(True), "blend": ~F.col("a.blend").eqNullSafe(F.col("b.blend")), "smart_object": smart}
    found = F.explode(F.filter(F.array(*(F.when(test, F.lit(kind)) for kind, test in tests.items())), lambda x: x.isNotNull()))
    same_layer = both.select(doc, found.alias("conflict"), "name", F.col("name").alias("other"))
    box = lambda t: t.select(doc, F.col("name").alias("id"), "x0", "y0", "x1", "y1")
    apart = layer_overlaps(box(a), box(b), doc).where("a <> b").select(doc, F.lit("overlap").alias("conflict"), F.col("a").alias("name"), F.col("b").alias("other"))
    at = lambda t, side: t.select(doc, "name", F.col("parent").alias(side))
    moved = at(ours, "o").join(at(theirs, "t"), [doc, "name"]).where(~F.col("o").eqNullSafe(F.col("t"))).join(base.select(doc, "name"), [doc, "name"], "left_semi")
    return same_layer.unionByName(apart).unionByName(moved.select(doc, F.lit("group").alias("conflict"), "name", F.col("name").alias("other")))


def _both_changed(base: Column, ours: Column, theirs: Column, field: str) -> Column:
    """Null, so no conflict, where a version doesn't tell."""
    return (ours[field] != base[field]) & (theirs[field] != base[field])


def _reasons(tests: dict[str, Column], other_format: Column) -> Column:
    """Names of the tests that hold; a changed format is the only reason given."""
    return F.when(other_format, F.array(F.lit("format"))).otherwise(F.filter(F.array(*(F.when(t, F.lit(k)) for k, t in tests.items())), lambda x: x.isNotNull()))


def _format_changed(base: Column, ours: Column, theirs: Column) -> Column:
    return ~(ours["format"].eqNullSafe(base["format"]) & theirs["format"].eqNullSafe(base["format"]))


def volume(box: Column) -> Column:
    """Of a box (x0, y0, z0, x1, y1, z1)."""
    return (box["x1"] - box["x0"]) * (box["y1"] - box["y0"]) * (box["z1"] - box["z0"])


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two boxes share a point; touching ones do."""
    return reduce(lambda x, c: x & (a[f"{c}1"] >= b[f"{c}0"]) & (a[f"{c}0"] <= b[f"{c}1"]), "xyz", F.lit(True))


def model_conflicts(base: Column, ours: Column, theirs: Column) -> Column:
    """Structs (format, vertices, materials, box) -> reasons against merging; an empty array lets it merge."""
    boxes = [x["box"] for x in (base, ours, theirs)]
    grown = (volume(boxes[1]) != volume(boxes[0])) & (volume(boxes[2]) != volume(boxes[0])) & boxes_meet(boxes[1], boxes[2])
    tests = {c: _both_changed(base, ours, theirs, c) for c in ("vertices", "materials")} | {"box": grown}
    return _reasons(tests, _format_changed(base, ours, theirs))


def project_conflicts(base: Column, ours: Column, theirs: Column) -> Column:
    """Structs (format, pages, layers, duration, assets) of layout, animation and edit files -> reasons against merging."""
    moved = lambda x: F.abs(x["duration"] - base["duration"]) > SAME_DURATION
    tests = {c: _both_changed(base, ours, theirs, c) for c in ("pages", "layers")}
    tests |= {"duration": moved(ours) & moved(theirs), "assets": _both_changed(base, ours, theirs, "assets")}
    return _reasons(tests, _format_changed(base, ours, theirs))


def merge_of(media_type: Column) -> Column:
    """Which merge a type of media has; `conflict` for all others."""
    return F.when(media_type.isin(*MERGED_TYPES), media_type).otherwise("conflict")
