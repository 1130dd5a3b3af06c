"""Scene documents: shape rules and canonical text, one document per row."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgraph.functions.exprs import let

_PROBLEM = "array<struct<path:string,message:string>>"
_NO_FIELDS = "struct<>"
ROOT_KEYS = ["version", "name", "engine", "seed", "instances", "lights", "camera"]
INSTANCE_KEYS = ["id", "prefab", "name", "parent", "transform", "params", "model", "visible", "locked"]
LIGHT_KEYS = ["id", "kind", "color", "intensity", "position", "distance", "angle", "castShadow"]
CAMERA_KEYS = ["kind", "position", "rotation", "fov", "near", "far", "orthoSize"]
LIGHT_KINDS = ["ambient", "directional", "point", "spot", "hemisphere"]


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def fields(value: Column, names: list[str]) -> Column:
    """The named fields of an object as one struct of variants, read in one pass; NULL where ``value`` is no object."""
    return F.try_variant_get(value, "$", f"struct<{', '.join(f'{n}:variant' for n in names)}>")


def plain(value: Column) -> Column:
    """The text of a string; NULL for values of other kinds."""
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def items(value: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("MISSING"))


def is_number(value: Column) -> Column:
    return _kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def _number(value: Column) -> Column:
    return F.when(is_number(value), F.try_variant_get(value, "$", "double"))


# Schemas of whole objects and arrays are costly; a cast that keeps nothing tells the kind.

def _is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", _NO_FIELDS).isNotNull()


def _listed(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _items(value: Column) -> Column:
    return F.coalesce(_listed(value), F.array().cast("array<variant>"))


def _at(path: Column, name: str) -> Column:
    return F.concat(path, F.lit("." + name)) if path is not None else F.lit(name)


def _rule(bad: Column, path: Column, message: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.struct(path.alias("path"), F.lit(message).alias("message")))


def _gather(*rules: Column) -> Column:
    return F.filter(F.array(*rules), lambda r: r.isNotNull()).cast(_PROBLEM)


def _unknown_keys(value: Column, known: list[str], path: Column) -> Column:
    keys = F.map_keys(F.try_variant_get(value, "$", f"map<string,{_NO_FIELDS}>"))
    extra = F.array_except(keys, F.array(*[F.lit(k) for k in known]))
    found = F.transform(extra, lambda k: F.struct(path.alias("path"), F.concat(F.lit("Unrecognized key "), k).alias("message")))
    return F.coalesce(found, F.array()).cast(_PROBLEM)


# The rules below take the value of a field, not the object around it.

def _absent(value: Column) -> Column:
    return value.isNull()


def _filled(value: Column) -> Column:
    return F.coalesce(plain(value), F.lit("")) != ""


def _vector(value: Column, path: Column, optional: bool = False) -> Column:
    good = let(_listed(value), lambda parts: F.coalesce((F.size(parts) == 3) & F.forall(parts, is_number), F.lit(False)))
    skip = _absent(value) if optional else F.lit(False)
    return _rule(~skip & ~good, path, "must have exactly 3 components (x, y, z)")


def _bounded(value: Column, path: Column, low: float, high: float | None = None, optional: bool = True) -> Column:
    inside = let(_number(value), lambda n: n >= low if high is None else (n >= low) & (n <= high))
    bound = f"must be at least {low:g}" if high is None else f"must be between {low:g} and {high:g}"
    skip = _absent(value) if optional else F.lit(False)
    return _rule(~skip & ~F.coalesce(inside, F.lit(False)), path, bound)


def _optional(value: Column, kind: str, path: Column) -> Column:
    return _rule(~_absent(value) & (_kind(value) != kind), path, f"must be a {kind.lower()}")


def _transform_rules(value: Column, path: Column) -> Column:
    known = ["position", "rotation", "scale"]
    rules = let(fields(value, known), lambda f: _gather(*[_vector(f[n], _at(path, n)) for n in known]))
    missing = _gather(_rule(F.lit(True), path, "a transform is required"))
    return F.when(_is_object(value), rules).otherwise(missing)


def _instance_rules(value: Column, index: Column) -> Column:
    here = F.concat(F.lit("instances["), index.cast("string"), F.lit("]"))
    inner = _at(here, "transform")

    def check(f: Column) -> Column:
        moved = f["transform"]
        before = _gather(
            _rule(~_filled(f["id"]), _at(here, "id"), "instance id must not be empty"),
            _rule(~_filled(f["prefab"]), _at(here, "prefab"), "prefab must not be empty"),
            _optional(f["name"], "STRING", _at(here, "name")),
            _optional(f["parent"], "STRING", _at(here, "parent")),
        )
        after = _gather(
            _rule(~_absent(f["params"]) & ~_is_object(f["params"]), _at(here, "params"), "must be an object"),
            _rule(~_absent(f["model"]) & ~_filled(f["model"]), _at(here, "model"), "must not be empty"),
            _optional(f["visible"], "BOOLEAN", _at(here, "visible")),
            _optional(f["locked"], "BOOLEAN", _at(here, "locked")),
        )
        return F.concat(before, _transform_rules(moved, inner), after, _unknown_keys(value, INSTANCE_KEYS, here),
                        _unknown_keys(moved, ["position", "rotation", "scale"], inner))

    return let(fields(value, INSTANCE_KEYS), check)


def _light_rules(value: Column, index: Column) -> Column:
    here = F.concat(F.lit("lights["), index.cast("string"), F.lit("]"))

    def check(f: Column) -> Column:
        rules = _gather(
            _rule(~_filled(f["id"]), _at(here, "id"), "light id must not be empty"),
            _rule(~F.coalesce(plain(f["kind"]).isin(*LIGHT_KINDS), F.lit(False)), _at(here, "kind"), "must be a known light kind"),
            _rule(~F.coalesce(plain(f["color"]).rlike("^#[0-9a-fA-F]{6}$"), F.lit(False)), _at(here, "color"),
                  'must be a 6-digit hex colour, e.g. "#ffffff"'),
            _bounded(f["intensity"], _at(here, "intensity"), 0, optional=False),
            _vector(f["position"], _at(here, "position"), optional=True),
            _bounded(f["distance"], _at(here, "distance"), 0),
            _bounded(f["angle"], _at(here, "angle"), 0, math.pi),
            _optional(f["castShadow"], "BOOLEAN", _at(here, "castShadow")),
        )
        return F.concat(rules, _unknown_keys(value, LIGHT_KEYS, here))

    return let(fields(value, LIGHT_KEYS), check)


def _camera_rules(value: Column) -> Column:
    here = F.lit("camera")

    def check(f: Column) -> Column:
        rules = _gather(
            _rule(~F.coalesce(plain(f["kind"]).isin("perspective", "orthographic"), F.lit(False)), _at(here, "kind"),
                  "must be a known camera kind"),
            _vector(f["position"], _at(here, "position")),
            _vector(f["rotation"], _at(here, "rotation")),
            _bounded(f["fov"], _at(here, "fov"), 1, 179),
            *[_bounded(f[n], _at(here, n), 0) for n in ("near", "far", "orthoSize")],
        )
        return F.concat(rules, _unknown_keys(value, CAMERA_KEYS, here))

    missing = _gather(_rule(F.lit(True), here, "a camera is required"))
    return F.when(_is_object(value), let(fields(value, CAMERA_KEYS), check)).otherwise(missing)


def shape_problems(doc: Column) -> Column:
    """``array<struct(path, message)>`` of a JSON text; NULL when it is no JSON."""
    def check(value: Column, f: Column) -> Column:
        rules = _gather(
            _rule(F.coalesce(_number(f["version"]) != 1, F.lit(True)), F.lit("version"), "must be exactly 1"),
            _rule(~_filled(f["name"]), F.lit("name"), "scene name must not be empty"),
            _rule(~F.coalesce(plain(f["engine"]).isin("three", "godot"), F.lit(False)), F.lit("engine"), "must be three or godot"),
            _rule(_kind(f["seed"]) != "BIGINT", F.lit("seed"), "must be an integer"),
            _rule(_listed(f["instances"]).isNull(), F.lit("instances"), "must be an array"),
            _rule(~_absent(f["lights"]) & _listed(f["lights"]).isNull(), F.lit("lights"), "must be an array"),
        )
        return F.concat(
            rules, _unknown_keys(value, ROOT_KEYS, F.lit("(root)")),
            F.flatten(F.transform(_items(f["instances"]), _instance_rules)),
            F.flatten(F.transform(_items(f["lights"]), _light_rules)),
            _camera_rules(f["camera"]))

    return let(F.try_parse_json(doc), lambda value: F.when(
        value.isNotNull(), let(fields(value, ROOT_KEYS), lambda f: check(value, f))))


def canonical_text(doc: Column) -> Column:
    """Compact JSON with keys in a fixed order; absent optional keys stay absent."""
    def ordered(value: Column, names: list[str]) -> Column:
        return let(fields(value, names), lambda f: F.struct(*[f[n].alias(n) for n in names]))

    def whole(f: Column) -> Column:
        return F.struct(
            *[f[n].alias(n) for n in ("version", "name", "engine", "seed")],
            F.transform(_items(f["instances"]), lambda i: ordered(
                i, ["id", "prefab", "name", "parent", "transform", "params", "model", "visible", "locked"])).alias("instances"),
            F.transform(_items(f["lights"]), lambda i: ordered(i, LIGHT_KEYS)).alias("lights"),
            ordered(f["camera"], CAMERA_KEYS).alias("camera"))

    return F.to_json(let(fields(F.try_parse_json(doc), ROOT_KEYS), whole))
