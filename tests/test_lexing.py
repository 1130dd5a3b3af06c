"""Spans in one pass, wrapped heads, annotations, words in paths."""

import random

from pyspark.sql import functions as F

from corpusgraph.functions import code
from corpusgraph.operators import ranking, spans


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


def plain_brace_ends(rows):
    level = opened = 0
    known = []
    for r in rows:
        before, opened_before = level, opened
        level, opened = level + r["opens"] - r["closes"], opened + r["opens"]
        known.append((r, before, opened_before, level, opened))
    out = []
    for r, before, opened_before, _, _ in known:
        if r["name"] is not None:
            ends = [o["line"] for o, _, _, level, opened in known if o["line"] >= r["line"] and level <= before and opened > opened_before]
            out.append({"name": r["name"], "start_line": r["line"], "end_line": ends[0] if ends else r["line"], "depth": before})
    return out


def plain_indent_ends(rows):
    out = []
    for k, r in enumerate(rows):
        if r["name"] is not None:
            stop = next((j for j in range(k + 1, len(rows)) if rows[j]["indent"] <= r["indent"]), len(rows))
            out.append({"name": r["name"], "start_line": r["line"], "end_line": rows[stop - 1]["line"], "depth": r["indent"]})
    return out


def test_ends_equal_the_search_over_all_lines():
    rng = random.Random(6)
    for _ in range(400):
        n = rng.randrange(25)
        name = lambda: rng.choice([None, None, "f", "g"])
        braces = [{"line": k + 1, "name": name(), "opens": rng.choice([0, 1, 2]), "closes": rng.choice([0, 1, 2])} for k in range(n)]
        assert spans.brace_ends(braces) == plain_brace_ends(braces)
        indents = [{"line": 2 * k + 1, "name": name(), "indent": rng.choice([0, 2, 4])} for k in range(n)]
        assert spans.indent_ends(indents) == plain_indent_ends(indents)


def test_a_file_of_many_functions_takes_one_pass():
    rows = []
    for k in range(60_000):
        rows += [{"line": 3 * k + 1, "name": f"f{k}", "opens": 1, "closes": 0}, {"line": 3 * k + 3, "name": None, "opens": 0, "closes": 1}]
    assert all(s["end_line"] == s["start_line"] + 2 for s in spans.brace_ends(rows))


def test_wrapped_heads_and_annotations_of_scripts(spark):
    source = ("@export\nvar speed: float = 1.0\n@export_range(0, 10)\n\nvar size: int\n@tool\nsignal died(\n  reason: String,\n  by\n)\n"
              "func run(\n\tdelta: float,\n\tat := Vector2(0, 1),\nlast: int\n) -> void:\n\tpass\nfunc plain(x): return x\n"
              "static func make(\n  a\n):\n\tpass\n@onready\nvar inner = 1\n")
    got = [(m.kind, m.name, m.parameters, m.type) for m in one(spark, source, code.script_contract)]
    assert [(k, n) for k, n, *_ in got] == [("export", "speed"), ("export", "size"), ("signal", "died"), ("function", "run"),
                                            ("function", "plain"), ("function", "make")]
    assert got[0][3] == "float" and got[1][3] == "int" and got[2][2] == "reason: String, by"
    assert got[3][2] == "delta: float, at = Vector2(0, 1), last: int" and got[3][3] == "void"


def test_words_in_paths_equal_a_plain_search(spark):
    rng = random.Random(3)
    paths = [(p, f"src/{rng.choice(['core', 'ui', 'Core2'])}/{rng.choice(['load', 'save', 'srcset'])}{k}.js") for p in "ab" for k in range(40)]
    words = [(p, w) for p in "abc" for w in ("src", "core", "load1", "srcset", "js.src", "ui/", "zzz", "src/core/load3.js", ".js")]
    files = spark.createDataFrame(paths, "project string, path string")
    want = sorted((p, w, x) for p, w in words for q, x in paths if p == q and w in x.lower())
    for postings in (1, 7, 10**6):
        got = ranking.paths_with(spark.createDataFrame(words, "project string, word string"), files, postings)
        assert sorted(tuple(r) for r in got.select("project", "word", "path").collect()) == want


def test_every_declarator_is_exported(spark):
    source = ("export const x = 1, y = 2;\nexport let a = f(1, [2, 3]), b = {p: 1, q: {r: 2}}, c;\nexport const { d, e: f2, g = 4 } = obj, [h, i] = list;\n"
              "export const s = 'one, two', t = `three, ${x}`, u = (k, l) => { return [k, l]; };\nexport const big = {\n  v: 1,\n};\n"
              "export var m = 1,\n  n = 2,\n  o = 3;\nexport const typed: Map<string, number> = new Map(), w = a === b;\nconst hidden = 1, none = 2;\n")
    names = [e.name for e in one(spark, source, code.exports)]
    assert names == ["x", "y", "a", "b", "c", "d", "e", "g", "h", "i", "s", "t", "u", "big", "m", "n", "o", "typed", "w"]
