"""Text expressions for issues, logs, replies and signatures."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgraph import constants as K
from corpusgraph.functions.exprs import let
from corpusgraph.functions.paths import posix

_IDENT = r"[A-Za-z_$][A-Za-z0-9_$]*"


def extract_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def issue_tokens(issue: Column) -> Column:
    """Lower-cased words of at least three characters that are no stop words."""
    words = F.split(F.lower(issue), r"[^a-z0-9_.\-]+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*K.STOP_WORDS))


def described_symbols(issue: Column) -> Column:
    names = F.transform(extract_all(issue, rf"\b({_IDENT})\b"), F.lower)
    return F.array_distinct(
        F.filter(names, lambda n: (F.length(n) >= 3) & ~n.isin(*K.STOP_WORDS))
    )


def binding_name(signature: Column) -> Column:
    """The identifier a display signature binds: the first word that introduces nothing.

    Words stand before the first sign that is neither part of a name, white space nor a
    generator star. ``function`` may touch the name that it introduces.
    """
    opening = F.translate(F.regexp_extract(signature, r"^[\w$\s*]*", 0), "*", " ")
    words = F.filter(F.split(opening, r"\s+"), lambda w: w != "")

    def after_async(w: Column) -> Column:
        return F.when((F.get(w, F.lit(0)) == "async") & (F.size(w) > 1), F.slice(w, F.lit(2), F.size(w))).otherwise(w)

    def name(w: Column) -> Column:
        first = F.get(w, F.lit(0))
        return F.when(first.isin(*K.INTRODUCING_WORDS) & (F.size(w) > 1), F.get(w, F.lit(1))).when(
            first.startswith("function") & F.substring(first, 9, 1).rlike("[A-Za-z_$]"), first.substr(F.lit(9), F.length(first))).otherwise(first)

    bound = let(words, lambda w: let(after_async(w), name))
    return F.when(bound.rlike("^[A-Za-z_$]"), bound)


def signal_name(signature: Column) -> Column:
    return F.regexp_extract(signature, r"^\s*([^(]*)", 1)


def called_symbol(text: Column) -> Column:
    """First called name, else the first name announced as a function."""
    def usable(names: Column) -> Column:
        known = F.filter(names, lambda n: (n != "") & ~F.lower(n).isin(*K.IGNORED_SYMBOLS))
        return F.get(known, F.lit(0))

    def name_at_start(word: Column) -> Column:
        return F.regexp_extract(word, rf"^{_IDENT}", 0)

    # a called name is the last word of what stands before an opening bracket
    before = F.split(text, r"\(")
    last_words = F.transform(F.slice(before, F.lit(1), F.size(before) - 1), lambda s: F.element_at(
        F.split(F.rtrim(F.regexp_replace(s, r"\s", " ")), r"[^A-Za-z0-9_$]"), -1))
    called = F.transform(last_words, name_at_start)
    # an announced name follows a word that ends in one of the kinds
    words = F.split(text, r"\s+")
    announced = F.transform(words, lambda w, i: F.when(
        F.element_at(F.split(w, r"\W"), -1).isin(*K.FUNCTION_WORDS), name_at_start(F.coalesce(F.get(words, i + 1), F.lit("")))).otherwise(""))
    return F.coalesce(usable(called), usable(announced))


def collapse_whitespace(line: Column) -> Column:
    tight = F.regexp_replace(line, r"\s*([(){}\[\];,:=<>+\-*/])\s*", "$1")
    return F.trim(F.regexp_replace(tight, r"\s+", " "))


def strip_line_prefixes(text: Column) -> Column:
    """Remove pasted ``> 12 | `` line numbers when the text starts with one."""
    # Format of a pasted line number (fixed value).
    prefix = r"(?:\s*>\s*)?\s*\d+\s*\|\s?"
    return F.when(text.rlike("^" + prefix), F.regexp_replace(text, "(?m)^" + prefix, "")).otherwise(
        text
    )


def search_lines(text: Column) -> Column:
    """Lines for searching: a trailing empty line is kept, carriage returns are not."""
    return F.transform(F.split(text, "\n", -1), lambda s: F.regexp_replace(s, "\r$", ""))


def diff_lines(text: Column) -> Column:
    """Lines for diffing: no trailing empty line, no line at all for an empty text."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    return let(
        parts,
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
    )


def display_line(line: Column, chars: int | None = None) -> Column:
    """The line without leading white space; its first ``chars`` characters and a mark where a caller asks for that."""
    bare = F.regexp_replace(line, r"^\s+", "")
    if chars is None:
        return bare
    return F.when(F.length(bare) > chars, F.concat(F.substring(bare, 1, chars), F.lit("…"))).otherwise(bare)


def display_column(line: Column, needle: Column) -> Column:
    """1-based column of the hit in the line without leading white space, 1 when it lies in that white space."""
    return F.greatest(F.position(needle, F.lower(display_line(line))), F.lit(1))


def token_estimate(chars: Column) -> Column:
    return F.floor(chars / 4 + 0.5).cast("long")


def saving_percent(chars: Column, full_chars: Column) -> Column:
    share = F.floor((full_chars - chars) * 100.0 / full_chars + 0.5).cast("long")
    return F.when(full_chars > 0, F.greatest(F.lit(0).cast("long"), share)).otherwise(
        F.lit(0).cast("long")
    )


def normalize_signature(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def format_js_export(kind: Column, name: Column, parameters: Column, returns: Column) -> Column:
    params = F.coalesce(parameters, F.lit(""))
    arrow = F.coalesce(F.concat(F.lit(" -> "), returns), F.lit(""))
    return (
        F.when(kind == "function", F.concat(F.lit("function "), name, F.lit("("), params, F.lit(")"), arrow))
        .when(kind == "default_function",
              F.concat(F.lit("default function "), name, F.lit("("), params, F.lit(")"), arrow))
        .when(kind == "default_class", F.concat(F.lit("default class "), name))
        .when(kind.isin("class", "const", "let", "var", "default"), F.concat(kind, F.lit(" "), name))
        .otherwise(name)
    )


def format_gd_member(kind: Column, name: Column, parameters: Column, type_name: Column) -> Column:
    return (
        F.when(kind == "signal", F.concat(name, F.lit("("), parameters, F.lit(")")))
        .when(kind == "export", F.concat(name, F.lit(": "), type_name))
        .when(kind == "const", F.concat(F.lit("const "), name, F.lit(": "), type_name))
        .when(kind == "enum", F.concat(F.lit("enum "), name))
        .when(kind == "function",
              F.concat(name, F.lit("("), parameters, F.lit(") -> "), type_name))
    )


# --- references and requests -------------------------------------------------

# Characters of a path in a log (fixed value).
_PATH_CHARS = r"A-Za-z0-9_./\\\-"


def file_references(logs: Column) -> Column:
    """Distinct ``struct(file, line, ord)`` in first-seen order.

    A path starts after a non-path character, may follow ``res://``, a host or a
    drive letter, and must end in a source extension; ``:12`` after it is a line.
    """
    # Schemes and drive prefixes end in path characters, so they are removed first.
    bare = F.regexp_replace(
        logs, rf"(?<![{_PATH_CHARS}])(?:res://|https?://[^/\s]+/|[A-Za-z]:(?=[\\/]))", ""
    )
    hits = extract_all(bare, rf"([{_PATH_CHARS}]+(?::\d+)?)")
    parsed = F.transform(
        hits,
        lambda h: F.struct(
            posix(F.regexp_replace(h, r":\d+$", "")).alias("file"),
            F.nullif(F.regexp_extract(h, r":(\d+)$", 1), F.lit("")).cast("long").alias("line"),
        ),
    )
    known = F.filter(
        parsed,
        lambda p: p["file"].contains(".")
        & F.lower(F.substring_index(p["file"], ".", -1)).isin(*K.SOURCE_EXTENSIONS),
    )
    return F.transform(
        F.array_distinct(known),
        lambda p, i: F.struct(p["file"].alias("file"), p["line"].alias("line"), i.alias("ord")),
    )


# Request markers (fixed values).
REQUEST_MARKERS = (
    r"NEED:\s*([^\s—\n]+)",
    r"CONTEXT INSUFFICIENT:\s*(?:Need\s+)?([^\s—\n]+)",
    r"\[developer asked for this file to be attached too:\s*([^\]]+)\]",
)


def attachment_requests(text: Column) -> Column:
    """Files named by the three request markers, distinct, forward slashes."""
    found = F.concat(*[extract_all(text, rf"(?i){edge}{m}") for edge, m in zip((r"\b", "", ""), REQUEST_MARKERS)])
    return F.array_distinct(F.transform(found, lambda f: posix(F.trim(f))))


def looks_like_path(request: Column) -> Column:
    clean = F.trim(request)
    ext = F.lower(F.substring_index(clean, ".", -1))
    return (
        (clean != "")
        & ~clean.rlike(r"\s")
        & clean.rlike(r"^.+\.[^.]*$")
        & ext.rlike("^[a-z0-9]+$")
        & (ext.isin(*K.SOURCE_EXTENSIONS) | clean.contains("/") | clean.startswith("res://"))
    )


def _clean_item(item: Column) -> Column:
    left = F.regexp_replace(item, r"^[\s\"'`*\[\]()]+", "")
    return F.trim(F.regexp_replace(left, r"[\s\"'`*.,:\[\]()]+$", ""))


def context_requests(reply: Column) -> Column:
    """Items asked for on marker lines, distinct, in order."""
    # Format of marker lines and of their items (fixed values).
    marker = r"(?im)^[ \t>*_\-]*(?:context insufficient|need)[ \t]*:(.+)$"

    def items(payload: Column) -> Column:
        undashed = F.regexp_replace(payload, r"(?s)\s+[—–\-]\s+.*$", "")
        unled = F.regexp_replace(undashed, r"(?i)^\s*need(?:ed|s)?\b\s*", "")
        parts = F.filter(
            F.transform(F.split(unled, r"[,\n;]+"), _clean_item), lambda i: i != ""
        )
        whole = F.filter(F.array(_clean_item(undashed)), lambda i: i != "")
        chosen = F.when(F.size(parts) > 0, parts).otherwise(whole)

        def halves(i: Column) -> Column:
            left = _clean_item(F.regexp_extract(i, r"^(.+) and (.+)$", 1))
            right = _clean_item(F.regexp_extract(i, r"^(.+) and (.+)$", 2))
            both = i.rlike(r"^.+ and .+$") & looks_like_path(left) & looks_like_path(right)
            return F.when(both, F.array(left, right)).otherwise(F.array(i))

        return F.flatten(F.transform(chosen, halves))

    return F.array_distinct(F.flatten(F.transform(extract_all(reply, marker), items)))


def clean_logs(logs: Column) -> Column:
    """Logs without the request marker lines."""
    markers = [rf"(?i)^{m}{end}" for m, end in zip(REQUEST_MARKERS, ("", "", "$"))]

    def is_marker(line: Column) -> Column:
        bare = F.trim(line)
        test = bare.rlike(markers[0])
        for m in markers[1:]:
            test = test | bare.rlike(m)
        return test

    return F.trim(F.array_join(F.filter(F.split(logs, "\n"), lambda s: ~is_marker(s)), "\n"))


# --- blocks in replies -------------------------------------------------------

# Marker formats of patch blocks (fixed values): heading, fence, FIND / REPLACE arrows.
_LEAD = r"(?:^|\n)[ \t]*(?:\*\*)?(?:#{1,6}[ \t]*)?(?:\*\*)?"
_FILE_HEAD = _LEAD + r"FILE:[ \t]*([^\r\n*`\"']+)[`*\"']*(?:\*\*)?[ \t]*\r?\n[ \t]*```[^\r\n]*\r?\n"
FILE_CLOSED = r"(?i)" + _FILE_HEAD + r"([\s\S]*?)\r?\n[ \t]*```"
FILE_TRUNCATED = r"(?i)" + _FILE_HEAD + r"([\s\S]*?)(?:\r?\n[ \t]*```|\z)"
EDIT_BLOCK = (
    r"(?i)" + _LEAD + r"(?:EDIT|FILE|UPDATE|PATCH):[ \t]*[`*\"']*([^\r\n*`\"']+)[`*\"']*(?:\*\*)?[ \t]*\r?\n"
    r"(?:[ \t]*```[^\r\n]*\r?\n)?[ \t]*<{3,7}[ \t]*(?:FIND|SEARCH)[^\r\n]*\r?\n([\s\S]*?)\r?\n"
    r"[ \t]*={3,7}[^\r\n]*\r?\n([\s\S]*?)\r?\n[ \t]*>{3,7}(?:[ \t]*REPLACE)?[^\r\n]*(?:\r?\n[ \t]*```)?"
)


def _block_path(raw: Column) -> Column:
    """The path of a heading without the signs that set it off."""
    bare = F.trim(raw)
    return F.trim(F.btrim(bare, F.lit("`*_")))


def file_blocks(reply: Column) -> Column:
    """``array<struct(path, content)>``; an unclosed last fence counts if nothing closed."""
    def read(pattern: str) -> Column:
        pairs = F.arrays_zip(
            extract_all(reply, pattern, 1).alias("p"), extract_all(reply, pattern, 2).alias("c")
        )
        named = F.transform(
            pairs, lambda b: F.struct(_block_path(b["p"]).alias("path"), b["c"].alias("content"))
        )
        return F.filter(named, lambda b: b["path"] != "")

    closed = read(FILE_CLOSED)
    return F.when(F.size(closed) > 0, closed).otherwise(read(FILE_TRUNCATED))


def edit_blocks(reply: Column) -> Column:
    """``array<struct(path, find, replace)>`` in reply order."""
    triples = F.arrays_zip(
        extract_all(reply, EDIT_BLOCK, 1).alias("p"),
        extract_all(reply, EDIT_BLOCK, 2).alias("f"),
        extract_all(reply, EDIT_BLOCK, 3).alias("r"),
    )
    named = F.transform(
        triples,
        lambda b: F.struct(
            _block_path(b["p"]).alias("path"), b["f"].alias("find"), b["r"].alias("replace")
        ),
    )
    return F.filter(named, lambda b: b["path"] != "")


# --- rendered briefs ---------------------------------------------------------

def brief_mode(markdown: Column, tool: str = "") -> Column:
    found = F.regexp_extract(markdown, rf"(?m)^<!-- {tool}brief mode=(oneShot|interactive) -->$", 1)
    return F.when(found == "interactive", "interactive").otherwise("oneShot")


def brief_stats(markdown: Column) -> Column:
    """``struct(nodes, edges, prefabs, instances)``, or NULL unless all four are there."""
    def number(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(markdown, "(?m)" + pattern, 1), F.lit("")).cast("long")

    nodes = number(r"^- Graph: (\d+) node\(s\), \d+ edge\(s\)$")
    edges = number(r"^- Graph: \d+ node\(s\), (\d+) edge\(s\)$")
    prefabs = number(r"^- Prefab modules: (\d+)$")
    instances = number(r"^- Scene instances: (\d+)$")
    complete = nodes.isNotNull() & edges.isNotNull() & prefabs.isNotNull() & instances.isNotNull()
    return F.when(
        complete,
        F.struct(nodes.alias("nodes"), edges.alias("edges"), prefabs.alias("prefabs"),
                 instances.alias("instances")),
    )
