"""Scene documents and manifests: reading, exploding, writing behind a gate."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph import constants as K
from corpusgraph.functions import documents as D
from corpusgraph.functions.exprs import let


def read_status(docs: DataFrame) -> DataFrame:
    """Add ``status``: missing, bad_json, bad_shape or ok, to ``(scene, doc)`` rows."""
    # Bound once: the rules are the costly part of this expression.
    status = let(D.shape_problems(F.col("doc")), lambda problems: (
        F.when(F.col("doc").isNull(), "missing")
        .when(problems.isNull(), "bad_json")
        .when(F.size(problems) > 0, "bad_shape")
        .otherwise("ok")
    ))
    return docs.withColumn("status", status)


def instances(docs: DataFrame) -> DataFrame:
    """``(scene, pos, id, prefab, name, parent, params)`` with the array position."""
    value = F.try_parse_json("doc")
    names = ["id", "prefab", "name", "parent"]
    rows = docs.select("scene", F.posexplode(D.items(value, "instances")).alias("pos", "i")).select(
        "scene", "pos", D.fields(F.col("i"), [*names, "params"]).alias("f"))
    return rows.select("scene", "pos", *[D.plain(F.col("f")[n]).alias(n) for n in names], F.to_json(F.col("f")["params"]).alias("params"))


def lights(docs: DataFrame) -> DataFrame:
    names = ["id", "kind", "color"]
    rows = docs.select("scene", F.posexplode(D.items(F.try_parse_json("doc"), "lights")).alias("pos", "i")).select(
        "scene", "pos", D.fields(F.col("i"), names).alias("f"))
    return rows.select("scene", "pos", *[D.plain(F.col("f")[n]).alias(n) for n in names])


def write_documents(docs: DataFrame, place: str) -> None:
    """Write the canonical text of the documents given; validate before."""
    docs.select("scene", D.canonical_text(F.col("doc")).alias("doc")).write.mode("overwrite").parquet(place)


def write_manifest(nodes: DataFrame, edges: DataFrame, project_root: str, generated_at: str, place: str) -> None:
    """Write a graph with its provenance; the time is an argument, never the clock."""
    stamp = [F.lit(project_root).alias("project_root"), F.lit(generated_at).alias("generated_at")]
    nodes.select(*stamp, "id", "engine", "type").write.mode("overwrite").json(f"{place}/nodes")
    edges.select(*stamp, "src", "dst", "kind").write.mode("overwrite").json(f"{place}/edges")


def read_manifest(spark: SparkSession, place: str) -> tuple[DataFrame, DataFrame]:
    nodes = spark.read.schema("project_root string, generated_at string, id string, engine string, type string").json(f"{place}/nodes")
    edges = spark.read.schema("project_root string, generated_at string, src string, dst string, kind string").json(f"{place}/edges")
    return nodes, edges


def row_problems(rows: DataFrame, rules: dict[str, list[str] | None], known: list[str]) -> DataFrame:
    """``(row_no, path, message)`` for JSON rows ``(row_no, json)``.

    ``rules`` maps a field to its allowed values, or None for any non-empty text.
    """
    found = []
    for name, allowed in rules.items():
        value = F.get_json_object("json", f"$.{name}")
        bad = F.coalesce(value, F.lit("")) == "" if allowed is None else ~F.coalesce(value.isin(*allowed), F.lit(False))
        message = f'"{name}" must not be empty' if allowed is None else f'"{name}" must be one of {", ".join(allowed)}'
        found.append(F.when(bad, F.struct(F.lit(name).alias("path"), F.lit(message).alias("message"))))
    extra = F.transform(
        F.array_except(F.json_object_keys("json"), F.array(*[F.lit(k) for k in known])),
        lambda k: F.struct(k.alias("path"), F.lit("unknown key").alias("message")))
    every = F.concat(F.filter(F.array(*found), lambda f: f.isNotNull()), F.coalesce(extra, F.array().cast("array<struct<path:string,message:string>>")))
    return rows.select("row_no", F.inline(every))


def edge_problems(rows: DataFrame) -> DataFrame:
    return row_problems(rows, {"from": None, "to": None, "kind": K.EDGE_KINDS}, ["from", "to", "kind"])
