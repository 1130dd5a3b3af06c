"""Text, code and section expressions on literal input."""

from pyspark.sql import functions as F

from corpusgraph.functions import code, markup, sections, seeded
from corpusgraph.functions import paths as P
from corpusgraph.functions import text as T
from corpusgraph.operators import extraction, resolve, spans


def value(spark, expression, text):
    return spark.createDataFrame([(text,)], "x string").select(expression(F.col("x")).alias("v")).first()["v"]


def test_golden_stream(spark):
    got = spark.range(1).select(seeded.draws(F.lit(12345), 5).alias("v")).first()["v"]
    assert got == [0.9797282677609473, 0.3067522644996643, 0.484205421525985, 0.817934412509203, 0.5094283693470061]


def test_file_references(spark):
    log = "at fn (src/x.js:12:1) res://a/b.gd http://localhost:3000/src/y.ts:7 C:\\g\\z.js:3 note.md src/x.js:12"
    got = [(r.file, r.line) for r in value(spark, T.file_references, log)]
    assert got == [("src/x.js", 12), ("a/b.gd", None), ("src/y.ts", 7), ("/g/z.js", 3)]


def test_requests(spark):
    reply = "NEED: src/a.js and src/b.js — to see the loop\n> Context insufficient: Need the physics code; `c.gd`.\nneeded: no"
    assert value(spark, T.context_requests, reply) == ["src/a.js", "src/b.js", "the physics code", "c.gd"]


def test_truncated_file_block(spark):
    reply = "**FILE: a.js**\n```js\nlet a;\n"
    assert value(spark, T.file_blocks, "### FILE: a.js\n```js\nlet a;\nb\n") == [("a.js", "let a;\nb\n")]
    assert value(spark, T.file_blocks, reply) == [("a.js", "let a;\n")]


def test_edit_block_shapes(spark):
    reply = "**EDIT:** a.js\n```\n<<<< SEARCH\nold\n====\nnew\n>>>> REPLACE\n```\nPATCH: b.js\n<<<<<<< FIND\nx\ny\n=======\n\n>>>>>>> REPLACE"
    assert value(spark, T.edit_blocks, reply) == [("a.js", "old", "new"), ("b.js", "x\ny", "")]


def test_blanking_keeps_lines_and_strings(spark):
    source = 'a /* x\ny */ "//no" // gone\n`t\n${u}` \'it\\\'s\''
    assert value(spark, lambda c: code.blank(c, keep_strings=True), source) == 'a \n "//no" \n""\n \'it\\\'s\''
    same = value(spark, lambda c: code.blank(c, same_length=True), source)
    assert [len(x) for x in same.split("\n")] == [len(x) for x in source.split("\n")]


def test_imports_and_exports(spark):
    source = """
import def, { a, b as c } from './m.js';
import * as ns from "../n";
import './side.css';
// import './no.js'
const lazy = await import('./lazy.js'); const r = require("./req");
export default function (x) {}
export async function go(a,
  b): number {}
export class Car {}
export const { p, q: r2 } = x, z = 1;
export { a, b as d } from './m.js';
export * from './all.js';
"""
    got = [(i.specifier, list(i.names), i.dynamic) for i in value(spark, code.imports, source)]
    assert got == [("./m.js", ["def", "a", "b as c"], False), ("../n", ["* as ns"], False), ("./side.css", [], False),
                   ("./lazy.js", [], True), ("./req", [], True)]
    names = [(e.kind, e.name) for e in value(spark, code.exports, source)]
    assert names == [("default_function", "anonymous"), ("function", "go"), ("class", "Car"), ("const", "p"), ("const", "q"), ("const", "z"),
                     ("specifier", "a"), ("specifier", "b as d"), ("specifier", "*")]


def test_sections_with_quotes_and_errors(spark):
    text = '[gd_scene]\n[node name="a]b" type=\'N\']\nscript = ExtResource("2")\n; x = 1\n[node type="N"]\n[broken "x\n[connection signal="s" from="a" to="."]'
    found = [(e.line, e.message) for e in value(spark, lambda c: sections.section_errors(sections.sections(c)), text)]
    assert found == [(5, 'node header requires a "name"'), (6, 'Unclosed section header: [broken "x')]
    assert value(spark, lambda c: sections.root_script_id(sections.sections(c)), text) == "2"


def test_nested_function_spans(spark):
    source = "class A {\n  run(x) {\n    const f = (y) => {\n      return y;\n    };\n    if (x) { f(x) }\n  }\n}\nfunction one() { return '}' }\n"
    files = spark.createDataFrame([(0, "a.js", source)], "project int, path string, content string")
    got = sorted((r.name, r.start_line, r.end_line) for r in spans.function_spans(files).collect())
    assert got == [("f", 3, 5), ("one", 9, 9), ("run", 2, 7)]
    line = spark.createDataFrame([(0, "a.js", 4), (0, "a.js", 6)], "project int, path string, line int")
    assert sorted((r.line, r.name) for r in spans.function_at_line(spans.function_spans(files), line).collect()) == [(4, "f"), (6, "run")]


def test_lint_ignores_strings_and_comments(spark):
    source = "export function create() {\n  const s = 'window'; // document\n  this.x = navigator; scene.add(this);\n}\nvar n = 1;"
    got = [(h.line, h.column, h.rule) for h in value(spark, code.lint, source)]
    assert got == [(3, 3, "no-this"), (3, 12, "no-dom-global"), (3, 23, "no-scene-add"), (3, 33, "no-this"),
                   (5, 1, "no-module-mutable-state")]


def test_import_resolution_both_ways_agree(spark):
    files = ["src/a.ts", "src/a.js", "src/b/index.js", "src/b.mjs", "src/c.d.ts", "src/x.tsx", "models/m.glb", "src/b/index.json"]
    known = spark.createDataFrame([(0, f) for f in files], "project int, path string")
    asked = ["./a", "./a.js", "./b", "./b.js", "./x.jsx", "./c.d", "../models/m.glb", "/src/b/", "./none", "../../up", "three"]
    imports = spark.createDataFrame([(0, "src/main.ts", s) for s in asked], "project int, path string, specifier string")
    fast = {r.specifier: r.target for r in resolve.resolve_imports(imports, known).collect()}
    tried = resolve.candidates(imports).join(known.select("project", F.col("path").alias("candidate")), ["project", "candidate"])
    slow = {r.specifier: r.t for r in tried.groupBy("specifier").agg(F.min_by("candidate", "priority").alias("t")).collect()}
    assert fast == slow
    assert fast["./a"] == "src/a.ts" and fast["./b.js"] == "src/b.mjs" if "./b.js" in fast else fast["./x.jsx"] == "src/x.tsx"


def test_page_scripts(spark):
    html = "<!-- <script src='no.js'></script> --><SCRIPT defer src = main.js></SCRIPT><script data-src='x' src=\"/lib/u.js\"></script><script src='https://c.dn/z.js'></script>"
    assert value(spark, lambda c: markup.tag_attribute(c, "script", "src"), html) == ["main.js", "/lib/u.js", "https://c.dn/z.js"]
    pages = spark.createDataFrame([(0, "web/i.html", html)], "project int, path string, content string")
    known = spark.createDataFrame([(0, "web/main.ts"), (0, "lib/u.js")], "project int, path string")
    assert sorted(r.script for r in extraction.page_scripts(pages, known).collect()) == ["lib/u.js", "web/main.ts"]


def test_containment(spark):
    cases = {"a/./b": (None, "a/b"), "../x": ("traversal", None), "/etc": ("absolute_path", None), "C:\\x": ("absolute_path", None),
             " ": ("empty_path", None), "./.": ("empty_path", None), "a\0b": ("null_byte", None)}
    for raw, want in cases.items():
        got = value(spark, P.containment, raw)
        assert (got.refusal, got.relative_path) == want, raw
