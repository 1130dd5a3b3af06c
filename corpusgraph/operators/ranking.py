"""Relevance of files for many issues at once.

Everything is keyed by project, so an issue meets the files of its own project only.
Tokens and symbols are matched once per (project, word) and joined back to issues.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph import constants as K
from corpusgraph.functions import text as T
from corpusgraph.plans.loops import by_shuffle, cut, cut_counting
from corpusgraph.sources.files import top_per_group

_RULE = ["query_id", "project", "file", "score", "line", "reason", "seq"]
_HITS = "array<struct<file:string,score:int,line:bigint,reason:string,seq:array<bigint>>>"


def _order(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.array(*[c.cast("long") for c in cols]).alias("seq")


def _log_reason(ord_: Column, line: Column) -> Column:
    first = ord_ == 0
    return (
        F.when(first & line.isNull(), "Primary error location")
        .when(first, F.concat(F.lit("Error origin at line "), line))
        .when(line.isNull(), "Active stack frame")
        .otherwise(F.concat(F.lit("Stack frame at line "), line))
    )


def _name_reason(word: Column) -> Column:
    return F.concat(F.lit('Filename matches "'), word, F.lit('"'))


def _symbol_reason(kind: Column, declared: Column) -> Column:
    verb = F.when(kind == 3, 'Exports "').otherwise('Declares signal "')
    return F.concat(verb, declared, F.lit('", named in your description'))


def _needs_reason(top: Column) -> Column:
    return F.concat(F.lit("Direct dependency of "), top)


def _used_reason(top: Column) -> Column:
    return F.concat(F.lit("Dependent of "), top, F.lit(" — it may need updating too"))


def log_rule(issues: DataFrame, files: DataFrame) -> DataFrame:
    """Existing files named by the log: the first reference 100, others 95."""
    refs = issues.select("query_id", "project", F.explode(T.file_references(F.col("logs"))).alias("r"))
    rows = refs.select("query_id", "project", F.col("r.file").alias("file"), F.col("r.line").alias("line"), F.col("r.ord").alias("ord"))
    rows = rows.join(by_shuffle(files.select("project", F.col("path").alias("file"))), ["project", "file"], "left_semi")
    score = F.when(F.col("ord") == 0, 100).otherwise(95)
    return rows.select("query_id", "project", "file", score.alias("score"), "line",
                       _log_reason(F.col("ord"), F.col("line")).alias("reason"), _order(1, F.col("ord"), 0))


#: Paths that hold a piece and stand under one join key; a piece of more paths is spread over several.
POSTINGS = 100_000


def _pieces(text: Column) -> Column:
    """The distinct three-character pieces of a text."""
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


#: Pairs of a word and a path that a project may have to be compared directly.
PAIRS = 1_000_000


def paths_with(words: DataFrame, files: DataFrame, postings: int = POSTINGS, pairs: int = PAIRS) -> DataFrame:
    """``(project, word, path)``: the paths of a project that contain a lower-case word of three or more characters.

    In a project of at most ``pairs`` pairs of a distinct word and a path every word meets every path. Larger projects, few of all, go
    through :func:`_by_pieces`, so that only their paths are written piece by piece.
    """
    asked, known = cut(words.select("project", "word").distinct()), files.select("project", "path")
    load = asked.groupBy("project").agg(F.count("*").alias("words")).join(
        by_shuffle(known.groupBy("project").agg(F.count("*").alias("paths"))), "project")
    large, counts = cut_counting(load.filter(F.col("words") * F.col("paths") > pairs).select("project"))
    few = asked.join(large, "project", "left_anti") if counts["rows"] else asked
    met = few.join(by_shuffle(known), "project").filter(F.lower("path").contains(F.col("word"))).select("project", "word", "path")
    if not counts["rows"]:
        return met
    return met.unionByName(_by_pieces(asked.join(large, "project", "left_semi"), known.join(large, "project", "left_semi"), postings))


def _by_pieces(asked: DataFrame, files: DataFrame, postings: int) -> DataFrame:
    """:func:`paths_with` for projects of any size.

    A table counts the paths of each three-character piece of a project. Each word meets only the paths that hold
    its rarest piece, and the check in full follows, so a piece that all paths share (``src``) costs
    nothing unless a word has no other. Pieces of more than ``postings`` paths are spread over several join keys.
    """
    lower = F.lower("path")
    held = cut(files.select("project", "path", F.explode(_pieces(lower)).alias("piece")))
    counts = held.groupBy("project", "piece").agg(F.count("*").alias("n"))
    asked = asked.select("project", "word", F.explode(_pieces(F.col("word"))).alias("piece"))
    # a word with a piece that no path of its project holds is in no path
    rarest = asked.join(counts, ["project", "piece"], "left").groupBy("project", "word").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r")).filter("r.n > 0").select("project", "word", "r.*")
    rarest = cut(rarest)
    parts = F.ceil(F.col("n") / postings).cast("int")
    needed = rarest.select("project", "piece", parts.alias("parts")).distinct()
    spread = held.join(needed, ["project", "piece"]).withColumn("part", F.pmod(F.xxhash64("path"), F.col("parts")).cast("int")).drop("parts")
    keyed = rarest.select("project", "word", "piece", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return keyed.join(spread, ["project", "piece", "part"]).filter(lower.contains(F.col("word"))).select("project", "word", "path")


def name_rule(issues: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose path contains a word of the issue: 40. See :func:`paths_with`."""
    words = issues.select("query_id", "project", F.posexplode(T.issue_tokens(F.col("issue"))).alias("pos", "word"))
    words = words.groupBy("query_id", "project", "word").agg(F.min("pos").alias("pos"))
    words = cut(words)
    rows = words.join(by_shuffle(paths_with(words, files)), ["project", "word"])
    return rows.select("query_id", "project", F.col("path").alias("file"), F.lit(40).alias("score"),
                       F.lit(None).cast("long").alias("line"), _name_reason(F.col("word")).alias("reason"), _order(2, F.col("pos"), 0))


def offered(contracts: DataFrame) -> DataFrame:
    """``(project, path, declared, kind, symbol)`` of exports and signals; the symbol is in lower case."""
    bound = contracts.select("project", "path", T.binding_name(F.col("export_sig")).alias("declared"), F.lit(3).alias("kind"))
    signals = contracts.select("project", "path", F.nullif(T.signal_name(F.col("signal_sig")), F.lit("")).alias("declared"),
                               F.lit(4).alias("kind"))
    return bound.unionByName(signals).filter("declared IS NOT NULL").withColumn("symbol", F.lower("declared"))


def described_exports(issues: DataFrame, contracts: DataFrame) -> DataFrame:
    """``(query_id, project, path, symbol, declared, kind)`` of exports and signals an issue names."""
    named = issues.select("query_id", "project", F.explode(T.described_symbols(F.col("issue"))).alias("symbol"))
    return named.join(by_shuffle(offered(contracts)), ["project", "symbol"])


def symbol_rule(issues: DataFrame, contracts: DataFrame) -> DataFrame:
    """Files that export, or declare a signal, named in the issue: 80."""
    rows = described_exports(issues, contracts)
    return rows.select("query_id", "project", F.col("path").alias("file"), F.lit(80).alias("score"),
                       F.lit(None).cast("long").alias("line"), _symbol_reason(F.col("kind"), F.col("declared")).alias("reason"),
                       _order(F.col("kind"), 0, 0))


def neighbour_rule(direct: DataFrame, edges: DataFrame) -> DataFrame:
    """One hop both ways from every file at 90 or more: dependencies 75, dependents 70."""
    top = direct.filter("score >= 90").groupBy("query_id", "project", F.col("file").alias("top")).agg(F.min("seq").alias("at"))
    links = edges.select("project", "src", "dst").distinct()
    place = F.element_at("at", 2)
    needs = top.join(by_shuffle(links.withColumnRenamed("src", "top")), ["project", "top"]).select(
        "query_id", "project", F.col("dst").alias("file"), F.lit(75).alias("score"), F.lit(None).cast("long").alias("line"),
        _needs_reason(F.col("top")).alias("reason"), _order(5, place, 0))
    used = top.join(by_shuffle(links.withColumnRenamed("dst", "top")), ["project", "top"]).select(
        "query_id", "project", F.col("src").alias("file"), F.lit(70).alias("score"), F.lit(None).cast("long").alias("line"),
        _used_reason(F.col("top")).alias("reason"), _order(5, place, 1))
    return needs.unionByName(used)


#: Pairs of an issue and a file, contract or link that a project may have to be ranked row by row.
DEALT = 20_000_000


def rank(issues: DataFrame, files: DataFrame, contracts: DataFrame, edges: DataFrame, dealt: int = DEALT) -> DataFrame:
    """``(query_id, project, file, score, line, reason, is_top)``: best score per file, first line, distinct reasons in rule order.

    Each table is dealt once by project. In a project of at most ``dealt`` pairs of an issue and what it can name, every issue meets
    the project's files, contracts and links as arrays of one row, so hits are found and grouped where they are. Larger projects, few of all, go
    through the joins of the single rules. Links of projects without issues go first. The result is not written: who reads it twice writes what they need of it.
    """
    issued = cut(issues.groupBy("project").agg(F.count("*").alias("issues")))
    links = cut(edges.select("project", "src", "dst").join(by_shuffle(issued.select("project")), "project", "left_semi"))
    held = files.select("project").unionByName(contracts.select("project")).join(
        by_shuffle(issued.select("project")), "project", "left_semi").unionByName(links.select("project"))
    load = held.groupBy("project").agg(F.count("*").alias("held")).join(by_shuffle(issued), "project")
    large, counts = cut_counting(load.filter(F.col("held") * F.col("issues") > dealt).select("project"))
    if not counts["rows"]:
        return _best(_dealt_hits(issues, files, contracts, links))
    small, rest = ([t.join(large, "project", how) for t in (issues, files, contracts, links)] for how in ("left_anti", "left_semi"))
    return _best(_dealt_hits(*small)).unionByName(_best(_joined_hits(*rest)))


def _best(hits: DataFrame) -> DataFrame:
    """One row per query and file of its hits."""
    reasons = F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("seq", "reason"))), lambda r: r["reason"]))
    return hits.groupBy("query_id", "project", "file").agg(
        F.max("score").alias("score"), F.min_by("line", F.when(F.col("line").isNotNull(), F.col("seq"))).alias("line"),
        F.array_join(reasons, "; ").alias("reason")).withColumn("is_top", F.col("score") >= 95)


def _joined_hits(issues: DataFrame, files: DataFrame, contracts: DataFrame, links: DataFrame) -> DataFrame:
    """Hits of all rules by joins on project and word, symbol or file."""
    logs = cut(log_rule(issues, files).select(*_RULE))
    others = name_rule(issues, files).select(*_RULE).unionByName(symbol_rule(issues, contracts).select(*_RULE))
    return logs.unionByName(others).unionByName(neighbour_rule(logs, links).select(*_RULE)).repartition("query_id", "project", "file")


def _dealt_hits(issues: DataFrame, files: DataFrame, contracts: DataFrame, links: DataFrame) -> DataFrame:
    """:func:`_joined_hits` with the tables of a project side by side: joins on the project alone, then arrays."""
    asked = issues.select(
        "query_id", "project", T.file_references(F.col("logs")).alias("refs"), T.issue_tokens(F.col("issue")).alias("words"),
        F.array_distinct(T.described_symbols(F.col("issue"))).alias("symbols"))
    whole = lambda frame, name, item: by_shuffle(frame.groupBy("project").agg(F.collect_set(item).alias(name)))
    paths = whole(files.filter("path IS NOT NULL"), "paths", F.struct("path", F.lower("path").alias("lower")))
    offers = whole(offered(contracts), "offers", F.struct("symbol", "path", "declared", "kind"))
    linked = whole(links, "links", F.struct("src", "dst"))
    met = asked.join(paths, "project", "left").join(offers, "project", "left").join(linked, "project", "left")
    met = met.select("query_id", "project", "words", "symbols", "paths", "offers", "links", F.filter(
        "refs", lambda r: F.exists("paths", lambda p: p["path"] == r["file"])).alias("refs"))

    def hit(file: Column, score, line: Column | None, reason: Column, *seq) -> Column:
        return F.struct(file.alias("file"), (score if isinstance(score, Column) else F.lit(score)).alias("score"),
                        (F.lit(None).cast("long") if line is None else line).alias("line"), reason.alias("reason"), _order(*seq))

    direct = F.transform("refs", lambda r: hit(
        r["file"], F.when(r["ord"] == 0, 100).otherwise(95), r["line"], _log_reason(r["ord"], r["line"]), 1, r["ord"], 0))
    names = F.flatten(F.transform(F.array_distinct("words"), lambda w: F.transform(
        F.filter("paths", lambda p: p["lower"].contains(w)),
        lambda p: hit(p["path"], 40, None, _name_reason(w), 2, F.array_position("words", w) - 1, 0))))
    symbols = F.transform(F.filter("offers", lambda o: F.array_contains("symbols", o["symbol"])),
                          lambda o: hit(o["path"], 80, None, _symbol_reason(o["kind"], o["declared"]), o["kind"], 0, 0))
    needs = F.flatten(F.transform("refs", lambda r: F.transform(
        F.filter("links", lambda l: l["src"] == r["file"]), lambda l: hit(l["dst"], 75, None, _needs_reason(r["file"]), 5, r["ord"], 0))))
    used = F.flatten(F.transform("refs", lambda r: F.transform(
        F.filter("links", lambda l: l["dst"] == r["file"]), lambda l: hit(l["src"], 70, None, _used_reason(r["file"]), 5, r["ord"], 1))))
    parts = [F.coalesce(x, F.array().cast(_HITS)) for x in (direct, names, symbols, needs, used)]
    return met.select("query_id", "project", F.explode(F.concat(*parts)).alias("h")).select("query_id", "project", "h.*")


def top_ranked(ranked: DataFrame, limit: int = K.AUTO_ATTACH) -> DataFrame:
    return top_per_group(ranked, ["query_id"], [F.col("score").desc(), F.col("file")], limit, "place")


def targets(issues: DataFrame, ranked: DataFrame) -> DataFrame:
    """``(query_id, project, target, line)``: the named target, else the best ranked file;
    the line falls back to that of the ranking."""
    best = top_ranked(ranked, 1).select("query_id", F.col("file").alias("best"), F.col("line").alias("best_line"))
    if "target_file" not in issues.columns:
        at = F.col("target_line") if "target_line" in issues.columns else F.lit(None).cast("long")
        return issues.select("query_id", "project", at.alias("at")).join(by_shuffle(best), "query_id", "left").select(
            "query_id", "project", F.col("best").alias("target"), F.coalesce("at", "best_line").alias("line"))
    at = F.col("target_line") if "target_line" in issues.columns else F.lit(None).cast("long")
    wanted = issues.select("query_id", "project", F.col("target_file").alias("named"), at.alias("at")).join(by_shuffle(best), "query_id", "left")
    chosen = wanted.select("query_id", "project", F.coalesce("named", "best").alias("target"), "at")
    lines = ranked.select("query_id", F.col("file").alias("target"), "line")
    return chosen.join(by_shuffle(lines), ["query_id", "target"], "left").select(
        "query_id", "project", "target", F.coalesce("at", "line").alias("line"))


def attachments(issues: DataFrame, ranked: DataFrame, limit: int = K.AUTO_ATTACH) -> DataFrame:
    """The first ranked files per query without its target and its requested files."""
    top = top_ranked(ranked, limit)
    asked = issues.select("query_id", F.explode(T.attachment_requests(F.concat_ws("\n", "logs", "issue"))).alias("file"))
    if "target_file" not in issues.columns:
        # Without a named target the best file is the target.
        return _unasked(top.filter("place > 1"), asked)
    aim = targets(issues, ranked).select("query_id", F.col("target").alias("file"))
    return _unasked(top, aim.unionByName(asked))


def _unasked(top: DataFrame, asked: DataFrame) -> DataFrame:
    """The few files of each query that are not asked for: the query's list goes to its files, so these stay where they were ranked."""
    lists = asked.filter("file IS NOT NULL").groupBy("query_id").agg(F.collect_set("file").alias("asked"))
    kept = top.join(by_shuffle(lists), "query_id", "left")
    return kept.filter(~F.coalesce(F.array_contains("asked", F.col("file")), F.lit(False))).drop("asked")


def signature_order(contracts: DataFrame, ranked_files: DataFrame) -> DataFrame:
    """Signatures with ranked files first, then by id; paths belong to their project."""
    ranked = ranked_files.select("project", "path", F.lit(0).alias("_r")).distinct()
    marked = contracts.join(ranked, ["project", "path"], "left")
    return marked.withColumn("later", F.coalesce("_r", F.lit(1))).drop("_r").orderBy("later", "project", "path")
