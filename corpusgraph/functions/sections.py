"""Sectioned project text (``[kind key="value"]`` headers with lines below them)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.functions.exprs import let, numbered

_CLOSED = r"^\[((?:[^\]\"']++|\"[^\"]*+\"|'[^']*+')*+)\]"
_PAIR = r"([^\s=]+)\s*=\s*(\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+'|\S+)"


def lines_with_header(content: Column) -> Column:
    """``array<struct(header_line, header, line, text)>``; every line with the header above it."""
    rows = numbered(F.split(content, r"\r?\n", -1),
                    lambda s, i: F.struct(i.alias("line"), F.trim(s).alias("text")))

    def carry(lines: Column) -> Column:
        heads = F.filter(lines, lambda r: r["text"].startswith("["))
        first_head = F.coalesce(F.get(heads, F.lit(0))["line"], F.size(lines) + 1)
        before = F.transform(
            F.slice(lines, F.lit(1), first_head - 1),
            lambda r: F.struct(F.lit(None).cast("int").alias("header_line"),
                               F.lit(None).cast("string").alias("header"),
                               r["line"].alias("line"), r["text"].alias("text")))

        def below(head: Column, at: Column) -> Column:
            stop = F.coalesce(F.get(heads, at + 1)["line"], F.size(lines) + 1)
            return F.transform(
                F.slice(lines, head["line"], stop - head["line"]),
                lambda r: F.struct(head["line"].alias("header_line"), head["text"].alias("header"),
                                   r["line"].alias("line"), r["text"].alias("text")))

        return F.concat(before, F.flatten(F.transform(heads, below)))

    return let(rows, carry)


def autoloads(content: Column) -> Column:
    """``array<struct(name, path)>`` of the autoload section, in order."""
    # Entry format of the autoload section (fixed value).
    form = r"^([A-Za-z_][A-Za-z0-9_]*)\s*=\s*\"?\*?res://([^\"]+)\"?\s*$"
    lines = F.filter(lines_with_header(content),
                     lambda r: (r["header"] == "[autoload]") & (r["line"] > r["header_line"]) & r["text"].rlike(form))
    return F.transform(lines, lambda r: F.struct(
        F.regexp_extract(r["text"], form, 1).alias("name"), F.regexp_extract(r["text"], form, 2).alias("path")))


def _attributes(body: Column) -> Column:
    def bare(value: Column) -> Column:
        inner = F.substring(value, F.lit(2), F.length(value) - 2)
        return F.when(value.rlike("^[\"']"), F.regexp_replace(inner, r"\\(.)", "$1")).otherwise(value)

    pairs = F.arrays_zip(T.extract_all(body, _PAIR, 1).alias("k"), T.extract_all(body, _PAIR, 2).alias("v"))
    return F.transform(pairs, lambda p: F.struct(p["k"].alias("key"), bare(p["v"]).alias("value")))


def attribute(attributes: Column, name: str) -> Column:
    """Last value of an attribute, NULL when it is absent."""
    found = F.filter(attributes, lambda a: a["key"] == name)
    return F.when(F.size(found) > 0, F.element_at(found, -1)["value"])


def sections(content: Column) -> Column:
    """``array<struct(line, kind, attributes, closed, stray, properties)>`` in file order.

    ``properties`` holds the ``key = value`` lines below a node header; ``stray`` is
    header text that is no ``key=value`` pair.
    """
    rows = numbered(F.split(content, r"\r?\n", -1),
                    lambda s, i: F.struct(i.alias("line"), F.trim(s).alias("text")))

    def parse(lines: Column) -> Column:
        heads = F.filter(lines, lambda r: r["text"].startswith("["))

        def one(head: Column, at: Column) -> Column:
            body = F.regexp_extract(head["text"], _CLOSED, 1)
            kind = F.regexp_extract(body, r"^\s*([A-Za-z_][A-Za-z0-9_]*)", 1)
            rest = F.regexp_replace(body, r"^\s*[A-Za-z_][A-Za-z0-9_]*", "")
            stop = F.coalesce(F.get(heads, at + 1)["line"], F.size(lines) + 1)
            below = F.slice(lines, head["line"] + 1, stop - head["line"] - 1)
            assigned = F.filter(below, lambda r: ~r["text"].startswith(";") & r["text"].rlike(r"^[^=]*[^=\s][^=]*="))
            properties = F.transform(assigned, lambda r: F.struct(
                F.trim(F.regexp_extract(r["text"], r"^([^=]*)=", 1)).alias("key"),
                F.trim(F.regexp_extract(r["text"], r"^[^=]*=(.*)$", 1)).alias("value")))
            return F.struct(
                head["line"].alias("line"),
                head["text"].alias("header"),
                kind.alias("kind"),
                _attributes(rest).alias("attributes"),
                head["text"].rlike(_CLOSED).alias("closed"),
                F.trim(F.regexp_replace(rest, _PAIR, "")).alias("stray"),
                F.when(kind == "node", properties).otherwise(F.slice(properties, F.lit(1), F.lit(0))).alias("properties"),
            )

        return F.transform(heads, one)

    return let(rows, parse)


def external_id(value: Column) -> Column:
    """Id inside ``ExtResource("...")``, else NULL."""
    form = r"^ExtResource\(\s*\"([^\"]*)\"\s*\)$"
    return F.when(F.trim(value).rlike(form), F.regexp_extract(F.trim(value), form, 1))


def root_script_id(parsed: Column) -> Column:
    """External id of the first node, in file order, that carries a script."""
    ids = F.transform(
        F.filter(parsed, lambda s: s["kind"] == "node"),
        lambda s: F.nullif(external_id(attribute(s["properties"], "script")), F.lit("")))
    return F.get(F.filter(ids, lambda i: i.isNotNull()), F.lit(0))


def section_errors(parsed: Column) -> Column:
    """``array<struct(line, message)>`` of malformed headers and a missing document header."""
    def missing(section: Column, *names: str) -> Column:
        test = F.lit(False)
        for name in names:
            test = test | (F.coalesce(attribute(section["attributes"], name), F.lit("")) == "")
        return test

    def message(s: Column) -> Column:
        return (
            F.when(~s["closed"], F.concat(F.lit("Unclosed section header: "), s["header"]))
            .when(s["stray"] != "", F.concat(F.lit('Expected "=" after attribute "'),
                                             F.regexp_extract(s["stray"], r"^(\S+)", 1), F.lit('"')))
            .when((s["kind"] == "ext_resource") & missing(s, "id", "path"),
                  'ext_resource requires both "path" and "id"')
            .when((s["kind"] == "sub_resource") & missing(s, "id"), 'sub_resource requires an "id"')
            .when((s["kind"] == "node") & missing(s, "name"), 'node header requires a "name"')
            .when((s["kind"] == "connection") & missing(s, "signal", "from", "to"),
                  'connection requires "signal", "from" and "to"')
        )

    found = F.filter(
        F.transform(parsed, lambda s: F.struct(s["line"].alias("line"), message(s).alias("message"))),
        lambda e: e["message"].isNotNull())
    headless = ~F.exists(parsed, lambda s: s["kind"] == "gd_scene")
    absent = F.array(F.struct(F.lit(1).alias("line"),
                              F.lit("Missing [gd_scene] header — not a valid .tscn file").alias("message")))
    return F.when(headless, F.concat(found, absent)).otherwise(found)
