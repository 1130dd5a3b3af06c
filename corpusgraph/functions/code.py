"""Lexical extraction from source text, one file per row, no shuffle.

These expressions read tokens and lines, not syntax trees. Known misses: regular
expression literals that contain quotes, nested template strings, JSX text,
declarations with several declarators, parameter lists over several lines in
scripts, and annotations on a line of their own.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgraph import constants as K
from corpusgraph.functions import paths as P
from corpusgraph.functions import text as T
from corpusgraph.functions.exprs import compact, let, numbered

_TOKENS = (
    r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)"
    r"|\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+(?:\"|\z)"
    r"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+(?:'|\z)"
    r"|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+(?:`|\z)"
    r"|[^/\"'`]++|/"
)
_SCRIPT_TOKENS = (
    r"#[^\n]*+"
    r"|\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+(?:\"|\z)"
    r"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+(?:'|\z)"
    r"|[^#\"']++"
)
_IDENT = r"[A-Za-z_$][A-Za-z0-9_$]*"
# Words of the script language that are no identifiers (fixed values).
SCRIPT_WORDS = [
    "and", "as", "assert", "await", "break", "breakpoint", "class", "class_name", "const",
    "continue", "elif", "else", "enum", "export", "extends", "false", "for", "func", "if", "in",
    "is", "match", "not", "null", "onready", "or", "pass", "return", "self", "setget", "signal",
    "static", "super", "true", "var", "void", "while", "yield",
]


def blank(source: Column, keep_strings: bool = False, same_length: bool = False) -> Column:
    """Drop comments and template literals, keep or empty quoted text, keep every newline.

    With ``same_length`` every dropped character becomes a space, so columns hold.
    """
    filler = " " if same_length else ""

    def one(token: Column) -> Column:
        hollow = F.regexp_replace(token, r"[^\n]", filler)
        if same_length:
            # The two quote characters count as part of the blanked token.
            emptied = hollow
        else:
            emptied = F.concat(F.lit('""'), hollow)
        comment = token.startswith("//") | token.startswith("/*")
        quoted = token.startswith('"') | token.startswith("'")
        kept = token if keep_strings else F.when(quoted, emptied).otherwise(token)
        return F.when(comment, hollow).when(token.startswith("`"), emptied).otherwise(kept)

    return F.array_join(F.transform(T.extract_all(source, _TOKENS, 0), one), "")


def blank_script(source: Column) -> Column:
    """The same for the indentation-based script language: no comments, empty strings."""
    def one(token: Column) -> Column:
        quoted = token.startswith('"') | token.startswith("'")
        return F.when(token.startswith("#"), "").when(
            quoted, F.concat(F.lit('""'), F.regexp_replace(token, r"[^\n]", ""))
        ).otherwise(token)

    return F.array_join(F.transform(T.extract_all(source, _SCRIPT_TOKENS, 0), one), "")


# --- imports -----------------------------------------------------------------

_STATIC = rf"(?m)^[ \t]*import\b\s*(?:([^'\"();]*?)\bfrom\s*)?[\"']([^\"'\n]+)[\"']"
_DYNAMIC = r"(?<![\w$.])(?:import|require)\s*\(\s*[\"']([^\"'\n]+)[\"']"


def _import_names(clause: Column) -> Column:
    flat = T.normalize_signature(clause)
    braces = F.regexp_extract(flat, r"\{([^}]*)\}", 1)
    named = F.filter(
        F.transform(F.split(braces, ","), lambda n: F.trim(F.regexp_replace(n, r"^\s*type\s+", ""))),
        lambda n: n != "",
    )
    star = F.regexp_extract(flat, rf"(\*\s*as\s+{_IDENT})", 1)
    default = F.regexp_extract(flat, rf"^(?:type\s+)?({_IDENT})", 1)
    return F.concat(
        F.filter(F.array(default, F.regexp_replace(star, r"^\*\s*", "* ")), lambda n: n != ""), named
    )


def imports(source: Column) -> Column:
    """``array<struct(specifier, names, dynamic)>``: static ones in order, then dynamic ones."""
    return let(blank(source, keep_strings=True), imports_of)


def imports_of(text: Column) -> Column:
    """:func:`imports` of a source whose comments are blanked already."""
    def read(text: Column) -> Column:
        static = F.transform(
            F.arrays_zip(T.extract_all(text, _STATIC, 1).alias("c"), T.extract_all(text, _STATIC, 2).alias("s")),
            lambda i: F.struct(i["s"].alias("specifier"), _import_names(i["c"]).alias("names"),
                               F.lit(False).alias("dynamic")),
        )
        dynamic = F.transform(
            F.array_distinct(T.extract_all(text, _DYNAMIC)),
            lambda s: F.struct(s.alias("specifier"), F.array().cast("array<string>").alias("names"),
                               F.lit(True).alias("dynamic")),
        )
        return F.concat(static, dynamic)

    return read(text)


# --- exports -----------------------------------------------------------------

_EXPORT = (
    r"(?m)^[ \t]*export\s+(\{[^}]*\}[^;\n]*"
    r"|(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*[\w$]*\s*\([^)]*\)(?:\s*:\s*[^{;\n]+)?"
    r"|(?:const|let|var)\b[^\n]*(?:(?<=,)[ \t]*\n[^\n]*)*"
    r"|[^\n]*)"
)
_FUNCTION = r"^(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*([\w$]*)\s*\(([^)]*)\)(?:\s*:\s*([^{;\n]+))?"
_CLASS = r"^(?:default\s+)?(?:abstract\s+)?class\b\s*([\w$]*)"
_VARIABLE = r"^(const|let|var)\s+([\w$]+|\{[^}]*\}|\[[^\]]*\])"


def _entry(kind: Column, name: Column, parameters: Column | None = None,
           returns: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(kind.alias("kind"), name.alias("name"),
                    (nothing if parameters is None else parameters).alias("parameters"),
                    (nothing if returns is None else returns).alias("returns"))


#: Brackets inside brackets that the search for declarators looks through.
_NESTED = 12


def _declared(statement: Column) -> Column:
    """Names that a ``const`` / ``let`` / ``var`` statement declares, in order.

    Strings go first, then patterns in front of ``=`` are put in other brackets, and what brackets
    hold goes from inside out. The commas left outside patterns part the declarators; an open bracket or a semicolon ends them.
    """
    rest = F.regexp_replace(F.regexp_replace(statement, r"^(?:const|let|var)\b\s*", ""),
                            r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`", "")
    rest = F.regexp_replace(rest, r"(^|,\s*)[{\[]([^{}\[\]]*)[}\]](?=\s*(?::[^=,]*)?=(?!=))", "$1\u2039$2\u203a")
    for _ in range(_NESTED):
        rest = F.regexp_replace(rest, r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}|<[\w$, |]*>", "")
    parts = F.split(F.regexp_replace(rest, r"(?s)[({\[;].*$", ""), ",(?![^\u2039\u203a]*\u203a)")
    patterns = F.transform(parts, lambda p: F.when(
        F.trim(p).startswith("\u2039"), F.transform(F.split(F.regexp_extract(p, "\u2039([^\u203a]*)\u203a", 1), ","), lambda n: F.trim(F.regexp_replace(n, r"[:=].*$", ""))))
        .otherwise(F.array(F.regexp_extract(p, r"^\s*([\w$]+)", 1))))
    return F.filter(F.flatten(patterns), lambda n: n != "")


def _export_entries(statement: Column) -> Column:
    default = statement.rlike(r"^default\b")
    flat = T.normalize_signature(statement)

    def kinded(word: str) -> Column:
        return F.when(default, f"default_{word}").otherwise(word)

    def text_or(value: Column, other: str) -> Column:
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(other))

    function = F.array(_entry(
        kinded("function"), text_or(F.regexp_extract(statement, _FUNCTION, 1), "anonymous"),
        T.normalize_signature(F.regexp_extract(statement, _FUNCTION, 2)),
        F.nullif(T.normalize_signature(F.regexp_extract(statement, _FUNCTION, 3)), F.lit(""))))
    klass = F.array(_entry(kinded("class"), text_or(F.regexp_extract(statement, _CLASS, 1), "anonymous")))
    variables = F.transform(_declared(statement), lambda n: _entry(F.regexp_extract(statement, _VARIABLE, 1), n))
    clause = F.filter(
        F.transform(F.split(F.regexp_extract(flat, r"^\{([^}]*)\}", 1), ","), lambda v: F.trim(v)), lambda n: n != "")
    specifiers = F.transform(clause, lambda n: _entry(F.lit("specifier"), n))
    expression = F.regexp_replace(F.regexp_replace(flat, r"^default\s+", ""), r";\s*$", "")
    label = F.when(expression.rlike(r"^(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>"), "arrow function").otherwise(
        expression)
    return (
        F.when(statement.rlike(_FUNCTION), function)
        .when(statement.rlike(_CLASS + r"\b|" + _CLASS + r"\s*\{"), klass)
        .when(statement.rlike(_VARIABLE), variables)
        .when(statement.startswith("{"), specifiers)
        .when(statement.startswith("*"), F.array(_entry(F.lit("specifier"), F.lit("*"))))
        .when(default, F.array(_entry(F.lit("default"), label)))
        .otherwise(F.filter(variables, lambda v: F.lit(False)))
    )


def binding_key(entry: Column) -> Column:
    alias = F.regexp_extract(entry["name"], r"^(.+)\s+as\s+.+$", 1)
    return (
        F.when((entry["kind"] == "specifier") & (alias != ""), F.concat(F.lit("alias:"), alias))
        .when(entry["kind"].startswith("default"), F.concat(F.lit("default:"), entry["name"]))
        .otherwise(F.concat(F.lit("name:"), entry["name"]))
    )


def exports(source: Column) -> Column:
    """``array<struct(kind, name, parameters, returns)>``; the first of each binding wins."""
    return let(blank(source, keep_strings=True), exports_of)


def exports_of(text: Column) -> Column:
    """:func:`exports` of a source whose comments are blanked already."""
    statements = T.extract_all(text, _EXPORT)

    def first_only(entries: Column) -> Column:
        return let(
            F.transform(entries, binding_key),
            lambda keys: F.filter(entries, lambda e, i: F.array_position(keys, binding_key(e)) == i + 1))

    return let(F.flatten(F.transform(statements, _export_entries)), first_only)


def export_signatures(source: Column) -> Column:
    formatted = F.transform(
        exports(source),
        lambda e: T.format_js_export(e["kind"], e["name"], e["parameters"], e["returns"]))
    return F.array_sort(formatted)


def asset_literals(source: Column) -> Column:
    """Quoted strings with an asset extension, distinct and sorted."""
    quoted = T.extract_all(blank(source, keep_strings=True), r"\"[^\"\n]*\"|'[^'\n]*'", 0)
    inner = F.transform(quoted, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
    return F.array_sort(F.array_distinct(F.filter(inner, P.is_asset_literal)))


# --- script contracts --------------------------------------------------------

_GD = {
    "signal": r"^signal\s+(\w+)\s*(?:\((.*)\))?",
    "export": r"^(@export\w*(?:\([^)]*\))?|export(?:\([^)]*\))?)\s+(?:onready\s+)?var\s+(\w+)\s*(?::\s*([^=]*?))?\s*(?:=.*)?$",
    "const": r"^const\s+(\w+)\s*(?::\s*([^=]*?))?\s*=",
    "enum": r"^enum\s+(\w+)",
    "function": r"^(?:static\s+)?func\s+(\w+)\s*\((.*)\)\s*(?:->\s*([^:]+?)\s*)?(?::|$)",
}


def script_contract(source: Column) -> Column:
    """``array<struct(kind, name, parameters, type)>`` of top-level members, in order.

    Private constants, enums and functions are left out.
    """
    def read(line: Column) -> Column:
        def group(kind: str, number: int) -> Column:
            return T.normalize_signature(F.regexp_extract(line, _GD[kind], number))

        def typed(value: Column, other: str) -> Column:
            return F.coalesce(F.nullif(value, F.lit("")), F.lit(other))

        def member(kind: str, name: Column, parameters: Column | None = None,
                   type_name: Column | None = None) -> Column:
            nothing = F.lit(None).cast("string")
            return F.struct(F.lit(kind).alias("kind"), name.alias("name"),
                            (nothing if parameters is None else parameters).alias("parameters"),
                            (nothing if type_name is None else type_name).alias("type"))

        def public(kind: str) -> Column:
            return line.rlike(_GD[kind]) & ~group(kind, 1).startswith("_")

        return (
            F.when(line.rlike(_GD["signal"]), member("signal", group("signal", 1), group("signal", 2)))
            .when(line.rlike(_GD["export"]),
                  member("export", group("export", 2), None, typed(group("export", 3), "Variant")))
            .when(public("const"), member("const", group("const", 1), None, typed(group("const", 2), "Variant")))
            .when(public("enum"), member("enum", group("enum", 1)))
            .when(public("function"),
                  member("function", group("function", 1), group("function", 2), typed(group("function", 3), "void")))
        )

    # A colon before "=" marks an inferred type, which is no declared type.
    plain = F.regexp_replace(blank_script(source), r":=", "=")
    return compact(F.transform(F.split(_logical_lines(plain), r"\r?\n"), read))


def _logical_lines(script: Column) -> Column:
    """Export annotations on lines of their own join the variable below; heads that go on inside their parentheses become one line."""
    joined = F.regexp_replace(script, r"(?m)^(@export\w*(?:\([^)\n]*\))?)[ \t]*(?:\r?\n[ \t]*)+(?=var\b|onready\b)", "$1 ")
    inside = r"((?:[^()\n]|\([^()\n]*\))*)\r?\n[ \t]*"
    return F.regexp_replace(joined, r"(?m)(^(?:(?:static[ \t]+)?func|signal)[ \t]+\w+[ \t]*\(|\G(?!\A))" + inside, "$1$2 ")


def script_signatures(contract: Column, kinds: list[str]) -> Column:
    """Formatted members of some kinds, distinct and sorted."""
    chosen = F.filter(contract, lambda m: m["kind"].isin(*kinds))
    return F.array_sort(F.array_distinct(F.transform(
        chosen, lambda m: T.format_gd_member(m["kind"], m["name"], F.coalesce(m["parameters"], F.lit("")), m["type"]))))


def identifiers(source: Column) -> Column:
    """Distinct identifiers of a script."""
    words = T.extract_all(blank_script(source), r"\b([A-Za-z_]\w*)\b")
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*SCRIPT_WORDS)))


def bodyless_functions(source: Column) -> Column:
    """Line numbers of ``func`` lines that no deeper line follows."""
    lines = numbered(F.split(blank_script(source), r"\r?\n"),
                     lambda s, i: F.struct(i.alias("line"), s.alias("s")))
    solid = F.filter(lines, lambda r: F.trim(r["s"]) != "")

    def indent(text: Column) -> Column:
        return F.length(F.regexp_extract(text, r"^([ \t]*)", 1))

    def find(rows: Column) -> Column:
        def bad(row: Column, at: Column) -> Column:
            follower = F.get(rows, at + 1)["s"]
            deeper = F.coalesce(indent(follower) > indent(row["s"]), F.lit(False))
            inline = row["s"].rlike(r"\)\s*(?:->[^:]*)?:\s*\S")
            return row["s"].rlike(r"^[ \t]*(?:static\s+)?func\b") & ~deeper & ~inline

        return F.transform(F.filter(rows, bad), lambda r: r["line"])

    return let(solid, find)


# --- lint --------------------------------------------------------------------

def _word(name: str) -> str:
    return rf"(?<![\w$.]){name}(?![\w$])"


LINT_RULES = {
    "no-this": _word("this"),
    "no-dom-global": _word("(?:" + "|".join(K.DOM_GLOBALS) + ")"),
    "no-scene-add": r"(?<![\w$.])scene\s*\.\s*(?:add|attach)\s*\(",
    "no-math-random": r"(?<![\w$.])Math\s*\.\s*random(?![\w$])",
    "no-module-mutable-state": r"^(?:let|var)\s",
}
_CALL_OR_DECLARATION = ("no-scene-add", "no-module-mutable-state")


def lint(source: Column, chars: int | None = None) -> Column:
    """``array<struct(rule, line, column, text)>`` sorted by line, column and rule; ``chars`` shortens the text."""
    pairs = F.arrays_zip(F.split(blank(source, same_length=True), "\n", -1).alias("code"),
                         F.split(source, "\n", -1).alias("raw"))
    mark = "\u0001"

    def on_line(row: Column, number: Column) -> Column:
        found = []

        def hits_of(rule: str, pattern: str) -> Column:
            pieces = F.split(F.regexp_replace(row["code"], pattern, mark + "$0"), mark)

            def hit(piece: Column, i: Column) -> Column:
                column = F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(1), lambda a, p: a + F.length(p))
                rest = F.substring(row["raw"], column, F.length(row["raw"]))
                if rule in _CALL_OR_DECLARATION:
                    whole = F.trim(F.regexp_extract(rest, r"^[^;]*;?", 0))
                else:
                    whole = F.substring(rest, F.lit(1), F.length(F.regexp_extract(piece, pattern.replace("(?<![\\w$.])", "^"), 0)))
                text = whole if chars is None else F.when(
                    F.length(whole) > chars, F.concat(F.substring(whole, F.lit(1), F.lit(chars)), F.lit("…"))).otherwise(whole)
                return F.struct(number.alias("line"), column.alias("column"), F.lit(rule).alias("rule"), text.alias("text"))

            return F.slice(F.transform(pieces, hit), F.lit(2), F.size(pieces))

        for rule, pattern in LINT_RULES.items():
            found.append(hits_of(rule, pattern))
        return F.concat(*found)

    return F.array_sort(F.flatten(numbered(pairs, on_line)))


def first_global_lines(source: Column, names: list[str] | None = None) -> Column:
    """``array<struct(name, line)>``: first line that uses each forbidden global."""
    lines = F.split(blank(source), "\n", -1)
    wanted = names or K.DOM_GLOBALS

    def first(rows: Column) -> Column:
        def first_of(name: str) -> Column:
            used = rf"(?<![\w$]){name}(?![\w$])"
            at = compact(numbered(rows, lambda s, i: F.when(s.rlike(used), i)))
            return F.struct(F.lit(name).alias("name"), F.get(at, F.lit(0)).alias("line"))

        return F.filter(F.array(*[first_of(n) for n in wanted]), lambda f: f["line"].isNotNull())

    return let(lines, first)
