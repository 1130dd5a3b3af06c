"""Patch jobs: many replies against many files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions import edits as E
from corpusgraph.functions import paths as P
from corpusgraph.functions import text as T
from corpusgraph.operators import history
from corpusgraph.plans.loops import cut_counting

def syntax_failure(path, content):
    """Message for a file that cannot be valid; NULL when it passes or is not judged."""
    bad = (P.extension(path) == ".json") & F.try_parse_json(content).isNull()
    return F.when(bad, F.concat(path, F.lit(" is not valid JSON")))


def locate_snippets(edits: DataFrame) -> DataFrame:
    """Add ``m = struct(ok, occurrences, how, target, reason)`` to (content, find) rows."""
    return edits.withColumn("m", E.locate(F.col("content"), F.col("find")))


def file_keys(*tables: DataFrame) -> list[str]:
    """What names a file in all these tables: its path, inside its project where every table says which."""
    return ["project", "path"] if all("project" in t.columns for t in tables) else ["path"]


def staged(replies: DataFrame, files: DataFrame) -> DataFrame:
    """``(reply_id, path, before, base, edits, n_file, n_edit, refusal)``, one row per named file.

    A reply is one row, so its blocks are gathered inside that row; only the join with
    ``files`` moves data. FILE blocks come first: the last one of a path is the base
    on which its EDIT blocks work.
    """
    project = file_keys(replies, files)[:-1]
    read = replies.select(*project, "reply_id", T.file_blocks(F.col("reply")).alias("fb"), T.edit_blocks(F.col("reply")).alias("eb"))
    # A path the reply spells in two ways is one file.
    def cleaned(blocks: str, *fields: str):
        return F.transform(blocks, lambda b: F.struct(
            P.containment(b["path"]).alias("v"), b["path"].alias("raw"), *[b[f].alias(f) for f in fields]))

    read = read.withColumn("fb", cleaned("fb", "content")).withColumn("eb", cleaned("eb", "find", "replace"))
    name = lambda b: F.coalesce(b["v"]["relative_path"], b["raw"])
    named = F.array_distinct(F.concat(F.transform("fb", name), F.transform("eb", name)))
    rows = read.select("*", F.explode(named).alias("path"))
    mine = lambda blocks: F.filter(blocks, lambda b: name(b) == F.col("path"))
    rows = rows.select(
        *project, "reply_id", "path",
        F.get(F.reverse(F.transform(mine("fb"), lambda b: b["content"])), F.lit(0)).alias("written"),
        F.transform(mine("eb"), lambda b: F.struct(b["find"].alias("find"), b["replace"].alias("replace"))).alias("edits"),
        F.size(mine("fb")).alias("n_file"), F.size(mine("eb")).alias("n_edit"),
        F.coalesce(F.get(F.transform(mine("fb"), lambda b: b["v"]["refusal"]), F.lit(0)),
                   F.get(F.transform(mine("eb"), lambda b: b["v"]["refusal"]), F.lit(0))).alias("refusal"))
    known = files.select(*project, "path", F.col("content").alias("before"))
    return rows.join(known, [*project, "path"], "left").withColumn("base", F.coalesce("written", "before"))


_APPLIED = "array<struct<find:string,replace:string>>"
_RESULTS = "array<struct<block_no:int,status:string,how:string,reason:string>>"


def _apply_block(state: DataFrame, number: int) -> DataFrame:
    """Apply block ``number`` of every row to its evolving ``content``."""
    nothing = F.lit(None).cast("string")
    row = state.withColumn("_b", F.get("edits", F.lit(number)))
    find, replacement = F.col("_b.find"), F.col("_b.replace")
    row = row.withColumn("_clash", F.exists("applied", lambda e: E.overlaps(e["find"], e["replace"], find)))
    row = row.withColumn("_m", F.when(~F.col("_clash"), E.locate(F.col("content"), find)))
    ok, target = F.coalesce(F.col("_m.ok"), F.lit(False)), F.col("_m.target")
    row = row.withColumn("_rewritten", F.when(
        ~F.col("_clash") & ~ok & (F.size("applied") > 0), E.locate(F.col("base"), find)["ok"]))
    row = row.withColumn("_reverts", ok & F.exists(
        "applied", lambda e: E.puts_back(target, e["find"], e["replace"], replacement)))
    row = row.withColumn("_new", F.when(ok & ~F.col("_reverts"), E.replace_once(
        F.col("content"), target, E.fitted(replacement, target, F.col("content")))))
    changes = F.coalesce(F.col("_new") != F.col("content"), F.lit(False))
    present = E.already_there(F.col("content"), replacement)
    status = (
        F.when(F.col("_clash") | F.col("_reverts") | F.coalesce("_rewritten", F.lit(False)), "failed")
        .when(changes, "applied")
        .when(present, "already")
        .otherwise("failed")
    )
    reason = (
        F.when(F.col("_clash"), "contradicts an earlier block")
        .when(F.col("_reverts"), "would undo an earlier block")
        .when(F.coalesce("_rewritten", F.lit(False)), "targets text rewritten by an earlier block")
        .when(changes | present, nothing)
        .when(ok, "located the FIND text but could not write the replacement")
        .otherwise(F.col("_m.reason"))
    )
    how = F.when(F.col("_clash"), "overlap").otherwise(F.col("_m.how"))
    row = row.withColumn("_r", F.struct(F.lit(number + 1).alias("block_no"), status.alias("status"), how.alias("how"),
                                        reason.alias("reason")))
    applied = F.when(F.col("_r.status") == "applied", F.concat("applied", F.array("_b"))).otherwise(F.col("applied"))
    content = F.when(F.col("_r.status") == "applied", F.col("_new")).otherwise(F.col("content"))
    keep = [c for c in state.columns if c not in ("content", "applied", "results")]
    return row.select(*keep, content.alias("content"), applied.cast(_APPLIED).alias("applied"),
                      F.concat("results", F.array("_r")).cast(_RESULTS).alias("results"))


def apply_blocks(rows: DataFrame) -> DataFrame:
    """Apply the ordered ``edits`` of each row to its ``base``.

    Adds ``content``, ``applied`` and ``results``; a block ends ``applied``,
    ``already`` or ``failed``. Blocks of one file depend on each other, so round k
    applies the k-th block of all rows at once; rows with fewer blocks sit out.
    """
    start = rows.withColumn("content", F.col("base")).withColumn("applied", F.array().cast(_APPLIED)).withColumn(
        "results", F.array().cast(_RESULTS))
    state, counts = cut_counting(start, several=F.size("edits") > 1, some=F.size("edits") > 0)
    done, number = state.filter(F.size("edits") == 0), 0
    left = counts["some"]
    while left:
        active = _apply_block(state.filter(F.size("edits") > number), number)
        number += 1
        if not counts["several"]:
            return done.unionByName(active)
        state, now = cut_counting(active, more=F.size("edits") > number)
        done = done.unionByName(state.filter(F.size("edits") == number))
        left = now["more"]
    return done


def apply_replies(replies: DataFrame, files: DataFrame) -> DataFrame:
    """``(reply_id, path, before, after, changed, created, results, syntax, ...)`` per file."""
    rows = staged(replies, files)
    usable = F.col("base").isNotNull() & F.col("refusal").isNull()
    refused = F.transform("edits", lambda b, i: F.struct(
        (i + 1).alias("block_no"), F.lit("failed").alias("status"), F.lit("missing").alias("how"),
        F.lit("Target file does not exist in the project").alias("reason"))).cast(_RESULTS)
    marked = rows.withColumn("usable", usable).withColumn("refused", F.when(~usable, refused)).withColumn(
        "edits", F.when(usable, F.col("edits")).otherwise(F.array().cast(_APPLIED)))
    done = apply_blocks(marked)
    out = done.select(
        *file_keys(replies, files)[:-1], "reply_id", "path", "before", F.when(F.col("usable"), F.col("content")).alias("after"),
        F.coalesce("refused", "results").alias("results"), "n_file", "n_edit", "refusal")
    changed = F.col("after").isNotNull() & ~F.col("before").eqNullSafe(F.col("after"))
    return out.withColumn("changed", changed).withColumn(
        "created", F.col("changed") & F.col("before").isNull()).withColumn(
        "syntax", F.when(changed, syntax_failure(F.col("path"), F.col("after"))))


def _with_status(status: str):
    return F.size(F.filter("results", lambda r: r["status"] == status))


def plan_totals(applied: DataFrame) -> DataFrame:
    """Per reply: blocks, applied, already applied, failed, changed and created files."""
    return applied.groupBy("reply_id").agg(
        F.sum(F.col("n_file") + F.col("n_edit")).alias("blocks"),
        F.sum(_with_status("applied")).alias("applied"),
        F.sum(_with_status("already")).alias("already"),
        F.sum(_with_status("failed")).alias("failed"),
        F.count_if("changed").alias("changed"),
        F.count_if("created").alias("created"),
        F.count_if(F.col("refusal").isNotNull()).alias("refused"),
        F.min_by("syntax", F.when(F.col("syntax").isNotNull(), F.col("path"))).alias("syntax"),
    )


def gate(totals: DataFrame) -> DataFrame:
    """``(reply_id, verdict, can_override)``: all or nothing per reply."""
    verdict = (
        F.when(F.col("refused") > 0, "refused_path")
        .when(F.col("failed") > 0, "failed_block")
        .when(F.col("syntax").isNotNull(), "syntax")
        .when((F.col("changed") == 0) & (F.col("already") > 0), "already_present")
        .when(F.col("changed") == 0, "no_change")
        .otherwise("pass")
    )
    override = F.col("syntax").isNotNull() & (F.col("failed") == 0) & (F.col("refused") == 0) & (F.col("changed") > 0)
    return totals.select("reply_id", verdict.alias("verdict"), override.alias("can_override"))


def passing_changes(applied: DataFrame, override: bool = False) -> DataFrame:
    """Changed files of the replies that pass the gate."""
    verdicts = gate(plan_totals(applied))
    good = F.col("verdict") == "pass"
    if override:
        good = good | F.col("can_override")
    return applied.filter("changed").join(verdicts.filter(good).select("reply_id"), "reply_id", "left_semi")


def next_version(files: DataFrame, changes: DataFrame) -> DataFrame:
    """The file table after one set of changes, at most one change per path (and project)."""
    keys = file_keys(files, changes)
    new = changes.select(*keys, F.col("after").alias("content"))
    return files.join(new.select(*keys), keys, "left_anti").select(*keys, "content").unionByName(new)


def new_project_check(replies: DataFrame) -> DataFrame:
    """``(reply_id, refusal, files)``: may a project be made from this reply alone?

    No EDIT block, at least one FILE block, contained paths, valid content.
    """
    read = replies.select("reply_id", T.file_blocks(F.col("reply")).alias("fb"), T.edit_blocks(F.col("reply")).alias("eb"))
    bad_path = F.exists("fb", lambda b: P.containment(b["path"])["refusal"].isNotNull())
    bad_text = F.exists("fb", lambda b: syntax_failure(b["path"], b["content"]).isNotNull())
    refusal = (
        F.when(F.size("eb") > 0, "edit_blocks")
        .when(F.size("fb") == 0, "no_file_blocks")
        .when(bad_path, "path")
        .when(bad_text, "syntax")
    )
    return read.select("reply_id", refusal.alias("refusal"), F.size("fb").alias("files"))


def project_name_problem(name):
    """Why a project name is refused, NULL when it is fine."""
    clean = F.trim(name)
    return (
        F.when(clean == "", "empty")
        .when(clean.isin(".", ".."), "dots")
        .when(clean.rlike(r"[/\\]"), "separator")
        .when(~clean.rlike("^[a-zA-Z0-9_-]+$"), "characters")
    )


def write_new_projects(replies: DataFrame, place: str) -> None:
    """Write the files of every reply that passes, partitioned by reply."""
    good = new_project_check(replies).filter("refusal IS NULL").select("reply_id")
    rows = replies.join(good, "reply_id", "left_semi").select(
        "reply_id", F.explode(T.file_blocks(F.col("reply"))).alias("b"))
    rows.select("reply_id", "b.path", "b.content").write.mode("overwrite").partitionBy("reply_id").parquet(place)


def patch_steps(changes: DataFrame) -> DataFrame:
    """One description per reply: its first three files and how many more."""
    return history.describe_steps(changes.select(F.col("reply_id").alias("step"), "path"), shown=3)
