"""Declarations of braced languages."""

import time

import pytest

from turnscale.operators import corpus, entities

SOURCE = """// class Not {}
import x from "y"
/* function not() { */
export default class Shop extends Base {
  static count = 0; #open = () => { return 1 }
  constructor(name) {
    this.name = `${name} {${"}"}`
  }
  @deco("a") async *items(a = { b: 1 }) { yield /[/}]"/g.test(a) }
  get size() { return 1 / 2 / 3 }
  declared
}
async function load(url) {
  return fetch(url)
}

const a = 1, b = [
  2,
]
let f = (x) =>
  x +
  1
var old = 1
function* many() {}
if (a) { function inner() {} }
export const { c, d } = a
export { a, b }
"""


def test_javascript():
    assert entities.braced_entities(SOURCE, False) == [
        ("class", "Shop", 4, 12), ("method", "constructor", 6, 8), ("method", "items", 9, 9), ("method", "size", 10, 10), ("function", "load", 13, 15),
        ("declaration", "a", 17, 19), ("declaration", "f", 20, 22), ("function", "many", 24, 24), ("declaration", None, 26, 26),
    ]


def test_templates_end_statements():
    source = "const a = `x ${\n f(`${1}`)\n} y`\nconst b = `${'{'}`\nclass C {}\nlet d = `plain`\nfunction e() {}\n"
    assert entities.braced_entities(source, False) == [("declaration", "a", 1, 3), ("declaration", "b", 4, 4), ("class", "C", 5, 5), ("declaration", "d", 6, 6), ("function", "e", 7, 7)]


def test_typescript():
    source = """export interface Point<T> { x: T; at(): void }
type Pair = {
  a: number
} | null
export type Name<T> = T
const enum Kind { A, B = 2 }
class Box<T> implements Point<T> {
  private x: { y: number } = { y: 1 };
  at(): void;
  at(a?: number): { b: number } | void { return }
  static of<U>(u: U): Box<U> { return new Box() }
}
declare function later(a: string): void
function* skipped() {}
let n: number = 1
"""
    assert entities.braced_entities(source, True) == [
        ("interface", "Point", 1, 1), ("type", "Pair", 2, 4), ("type", "Name", 5, 5), ("enum", "Kind", 6, 6), ("class", "Box", 7, 12), ("method", "at", 10, 10), ("method", "of", 11, 11), ("declaration", "n", 15, 15),
    ]
    assert ("function", "skipped", 14, 14) in entities.braced_entities(source, False)


@pytest.mark.parametrize("source", [None, "", "plain words of prose", "function f() {", "const a = 'open\n", "x }", "let t = `a ${b", "class A:\n  def f(self):\n    return 1\n", "import os"])
def test_sources_without_entities(source):
    assert entities.braced_entities(source, True) is None


@pytest.mark.parametrize("run", ["/", "`${", "{", "'", "a.", "/*", "[/", "const a = 1\n", "class A { m() {} }\n", "(", "\\"])
def test_long_sources_take_linear_time(run):
    def took(n):
        start = time.perf_counter()
        entities.braced_entities(run * (n // len(run)), True)
        return time.perf_counter() - start

    short = took(20_000)
    assert took(80_000) < 12 * short + 0.5


def test_chunks(spark):
    files = spark.createDataFrame([("p", "a.js", SOURCE), ("p", "b.ts", "no code"), ("p", "c.tsx", "export function F() {\n  return <p>it's</p>\n}\n"), ("p", "d.ts", "enum E { A }\n")], "project_id string, path string, content string")
    got = sorted((r.file_path, r.entity_kind, str(r.entity_name), r.line_start, r.line_end, r.text.split("\n")[0]) for r in corpus.chunk_entities(files).collect())
    assert len([r for r in got if r[0] == "a.js"]) == 9 and ("a.js", "function", "load", 13, 15, "async function load(url) {") in got
    assert [r[:3] for r in got if r[0] != "a.js"] == [("b.ts", "file", "None"), ("c.tsx", "file", "None"), ("d.ts", "enum", "E")]


def test_entities_are_read_once(spark):
    """One evaluation in Python for files of all kinds."""
    rows = [("p", "a.py", "def f():\n    return 1\n"), ("p", "b.py", "not python"), ("p", "c.ts", "class A {\n  b() {\n  }\n}\n"), ("p", "d.md", "text"), ("p", "e.go", None)]
    files = spark.createDataFrame(rows, "project_id string, path string, content string")
    chunks = corpus.chunk_entities(files)
    assert chunks._jdf.queryExecution().executedPlan().toString().count("EvalPython [entities") == 1
    got = sorted((r.file_path, r.entity_kind, r.entity_name, r.line_start, r.line_end, r.language) for r in chunks.collect())
    assert got == [("a.py", "function", "f", 1, 2, "python"), ("b.py", "file", None, 1, 1, "python"), ("c.ts", "class", "A", 1, 4, "typescript"), ("c.ts", "method", "b", 2, 3, "typescript"), ("d.md", "file", None, 1, 1, None)]


def test_sweep_takes_old_chunks_once(spark):
    """Changed and missing files are told from one reading of the chunks there were, and each new file is read once."""
    schema = "project_id string, path string, length long, content string"
    row = lambda path, text: ("p", path, len(text), text)
    old = spark.createDataFrame([row("same.py", "def f():\n    return 1\n"), row("new.py", "def g():\n    return 1\n"), row("gone.py", "def h():\n    return 1\n")], schema)
    now = spark.createDataFrame([row("same.py", "def f():\n    return 1\n"), row("new.py", "def g():\n    return 2\n"), row("more.py", "x = 1\n")], schema)
    summary = corpus.sweep(now, old, corpus.chunk_entities(old))[1]
    assert summary._jdf.queryExecution().executedPlan().toString().count("EvalPython [entities") == 2
    assert [tuple(r) for r in summary.collect()] == [("p", 1, 1, 1, 1, 2, 2, 0)]
