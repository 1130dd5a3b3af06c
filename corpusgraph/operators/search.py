"""Search over file names and contents. Nothing is capped unless the caller asks for a page."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import text as T
from corpusgraph.functions.exprs import numbered
from corpusgraph.plans.dense import dictionary


def needle_of(query: str | None) -> str | None:
    """Trimmed, lower-cased query; None for a blank one."""
    clean = (query or "").strip().lower()
    return clean or None


def name_hits(files: DataFrame, query: str) -> DataFrame:
    needle = needle_of(query)
    if needle is None:
        return files.filter(F.lit(False)).select("path")
    return files.filter(F.lower("path").contains(needle)).select("path")


def _matching_lines(needle: str) -> Column:
    rows = numbered(
        T.search_lines(F.col("content")), lambda s, i: F.struct(i.alias("line"), s.alias("raw"))
    )
    return F.filter(rows, lambda h: F.lower(h["raw"]).contains(needle))


def line_hits(files: DataFrame, query: str, per_file: int | None = None,
              max_bytes: int | None = None, chars: int | None = None) -> DataFrame:
    """``(path, line, column, text)`` of lines that contain the query.

    Works inside each file row, so nothing is shuffled. ``per_file`` keeps the first
    hits of a file; files over ``max_bytes`` are left out before their content is read;
    ``chars`` shortens the text of a hit.
    """
    needle = needle_of(query)
    if needle is None:
        files = files.filter(F.lit(False))
    if max_bytes is not None:
        files = files.filter(F.col("size") <= max_bytes)
    found = _matching_lines(needle or "")
    if per_file is not None:
        found = F.slice(found, 1, per_file)
    hits = files.select("path", F.explode(found).alias("h"))
    return hits.select(
        "path",
        F.col("h.line").alias("line"),
        T.display_column(F.col("h.raw"), F.lit(needle or "")).cast("long").alias("column"),
        T.display_line(F.col("h.raw"), chars).alias("text"),
    )


def capped_hits(files: DataFrame, query: str, per_file: int, total: int, max_bytes: int | None = None) -> DataFrame:
    """The lines of one page: the first ``per_file`` of each file, then the first ``total`` overall."""
    return line_hits(files, query, per_file, max_bytes).orderBy("path", "line").limit(total)


def capped_names(files: DataFrame, query: str, total: int) -> DataFrame:
    return name_hits(files, query).orderBy("path").limit(total)


def search(files: DataFrame, query: str, kind: str = "all", per_file: int | None = None, total: int | None = None,
           total_names: int | None = None) -> DataFrame:
    """Name hits and line hits in one table, ``kind`` all / files / contents; a page of them where caps are given."""
    names = name_hits(files, query) if total_names is None else capped_names(files, query, total_names)
    names = names.select(
        F.lit("name").alias("hit"), "path", F.lit(None).cast("int").alias("line"),
        F.lit(None).cast("long").alias("column"), F.lit(None).cast("string").alias("text"))
    lines = line_hits(files, query, per_file) if total is None else capped_hits(files, query, per_file, total)
    lines = lines.select(F.lit("line").alias("hit"), "path", "line", "column", "text")
    if kind == "files":
        return names
    if kind == "contents":
        return lines
    return names.unionByName(lines)


def lines_by_path(hits: DataFrame) -> DataFrame:
    """Line numbers per file, in order; as many as the file has hits."""
    return hits.groupBy("path").agg(
        F.count("*").alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda v: v.cast("string")), ",")
        .alias("lines"),
    )


def listed_paths(hits: DataFrame, names: DataFrame) -> DataFrame:
    """``(path, position)``: files in listing order from 1 on, those with line hits, then those named only.

    Places come from ranges of (part, path) and the ranges' sizes, so a listing of all hits is no single task.
    """
    both = hits.select("path", F.lit(0).alias("part")).unionByName(
        names.select("path", F.lit(1).alias("part")))
    first = both.groupBy("path").agg(F.min("part").alias("part"))
    return dictionary(first.select("part", "path"), "place").select("path", (F.col("place") + 1).alias("position"))


def summary(files: DataFrame, query: str, per_file: int, total: int, names: int, max_bytes: int | None = None) -> DataFrame:
    """Counts before and after a page's caps, and which caps were hit, in one row. Files of every size are searched."""
    needle = needle_of(query)
    searched = F.lit(True) if max_bytes is None else F.col("size") <= max_bytes
    lines = F.when(searched, F.size(_matching_lines(needle or ""))).otherwise(0)
    per_file_rows = files.select(
        searched.alias("searched"),
        lines.alias("lines"),
        F.lower("path").contains(needle or "").alias("named"),
    )
    if needle is None:
        per_file_rows = per_file_rows.filter(F.lit(False))
    kept = F.least(F.col("lines"), F.lit(per_file))
    counts = per_file_rows.agg(
        F.count("*").alias("scanned"),
        F.count_if("named").alias("name_hits"),
        F.coalesce(F.sum(kept), F.lit(0)).alias("line_hits"),
        F.count_if(~F.col("searched")).alias("skipped"),
        F.count_if(F.col("lines") > per_file).alias("files_cut"),
    )
    return counts.select(
        "scanned",
        F.least("name_hits", F.lit(names)).alias("name_hits"),
        F.least("line_hits", F.lit(total)).alias("line_hits"),
        "skipped",
        "files_cut",
        (F.col("name_hits") > names).alias("names_cut"),
        (F.col("line_hits") > total).alias("lines_cut"),
    )
