"""Definitions and calls (X1-X3, X7) of hand-written code; braces.py against a character-by-character version."""

import random

from packtables.operators.braces import extract_braced
from packtables.operators.scanners import scan_python
from tests.literal_scanners import scan_go, scan_js


def _by(rows, tag):
    return [r for r in rows if r["tag"] == tag]


def test_python_nesting():
    src = ("from __future__ import annotations\nfrom a.b import (x, y as z)\nimport os.path, sys\n"
           "from . import rel\n\nclass A:\n    class B:\n        def inner(self):\n            pass\n"
           "    @dec\n    def m(self):\n        def helper():\n            return self.save(1)\n"
           "        return helper()\n\ndef top():\n    return A().m()\n")
    rows = scan_python(src)
    syms = {(r["name"], r["kind"], r["start_line"], r["end_line"]) for r in _by(rows, "symbol")}
    assert ("A", "class", 6, 14) in syms and ("B", "class", 7, 9) in syms
    assert ("B.inner", "method", 8, 9) in syms
    assert ("A.m", "method", 11, 14) in syms and ("A.helper", "method", 12, 13) in syms
    assert ("top", "function", 16, 17) in syms
    calls = {(r["name"], r["line"]) for r in _by(rows, "call")}
    assert {("self.save", 13), ("helper", 14), ("A().m", 17), ("A", 17)} <= calls
    assert ("dec", 10) not in calls          # a bare decorator is not a call


def by_spark(spark, texts, lang):
    """Rows of each text as ``(tag, name, kind, start_line, end_line, col, body, signature, line)``."""
    files = spark.createDataFrame([(None if i == 1 else "r", f"p{i}", t) for i, t in enumerate(texts)], "repo_id string, path string, content string")
    got = {i: [] for i in range(len(texts))}
    for r in extract_braced({lang: files}).collect():
        got[int(r.path[1:])].append((r.tag, r.name, r.kind, r.start_line, r.end_line, r.col, r.body, r.signature, r.line))
    return [sorted(got[i], key=repr) for i in got]


def literal(texts, scan):
    fields = ("tag", "name", "kind", "start_line", "end_line", "col", "body", "signature", "line")
    return [sorted((tuple(d.get(f) for f in fields) for d in scan(t or "")), key=repr) for t in texts]


JS = ["import Def, { a } from 'mod';\nexport const f = async (x) => {\n  return g(x);\n};\nconst h = y => y + 1;\n"
      "class K extends Base {\n  static make() { return new K(); }\n  run(a) {\n    this.go(a);\n  }\n}\n"
      "function outer() { /* } */ const s = '}'; return 1; }\n", "", None, "// c\n", "x\ny(1)",
      "const z = foo(bar(1)[2], () => { q(); })\n  , w = 2;\nlet t = (a, b) => ({ x: a })\nfunction g<T>(x: T): T { function inner() { class In { "
      "m() { if (x) { y.z?.k(1) } }\n  n(): void {\n for (;;) { w() } }\n }\n } return x }\nfunction unclosed( { \n h(1)",
      "class A { \n constructor(private x: string) {\n super(x); }\n get v(): number { return this.x.length() }\n static async *gen() {}\n"
      " if (x) { b() }\n helper = (q) => q.map(r => r.go());\n}\nexport default class B extends mix(A) { m() {} }\nconst s = `a ${f(1)} b`; "
      "call ('x' /* y( */); k <T> (1); new Foo(2); new a.Bar(3)\nconst e = () => [1,\n2].map(u => u)\n",
      "// \U0001F600 é\nconst ü = 1; function \u00e9t(a) { return 'ß\U0001F600' + b(a) }\nclass Q { m(a) {\n  c('\U0001F600') } }"]
GO = ['package p\n\nimport "fmt"\nimport (\n  alias "a/b"\n)\n\ntype (\n  T struct {\n    x int\n  }\n  U int\n)\n\n'
      'func (t *T) M() { fmt.Println(t.x) }\n\nfunc F(a int) int {\n  return helper(a)\n}\n', "", None,
      'package q\n\ntype S struct {\n\tA int\n\tF func(x int) error\n}\n\ntype I interface{ M() }\ntype J = map[string]int\n'
      'func G[T any](x T) T {\n\ts := `raw } "`\n\tif f(x) { return g.h.k(x) }\n\tgo run()\n\tdefer func() { r() }()\n\treturn make([]int, 3)\n}\n'
      'func (Recv) N()\nfunc (r Recv2[T]) O() {}\nfunc asm(a int)\n', "type T int", "func () Anon() {\n", "type (\n A struct {\n", "func open() {\n f(1)\n"]


def test_braced_languages_match_the_literal_version(spark):
    assert by_spark(spark, JS, "js") == literal(JS, scan_js)
    assert by_spark(spark, GO, "go") == literal(GO, scan_go)


def test_random_texts_match_the_literal_version(spark):
    """Pieces in any order: unbalanced brackets, open strings, classes in functions in classes; Go in whole declarations."""
    rng = random.Random(4)
    js = ["class A {\n", "class B extends C {", "function f(", "x) {", "}\n", "}", "{", " m(a) {\n", "  static n() { return 1 }\n", "const k = (a) =>", " {", "b(1);\n",
          "=> c.d(2)", ";", "\n", "'s }'", "\"t{", "`q\n{`", "// e( {\n", "/* { */", "new D(3)", "[", "]", "(", ")", "let u = async v => v(", "async function g() {", "if (x) {\n"]
    go = ["func F(a int) int {\n  return g(1)\n}\n", "func (r *R) M() {\n  x.y(2)\n  if h(3) {\n    go k()\n  }\n}\n", "type T struct {\n  A int\n}\n", "}\n",
          "type (\n  U int\n  V struct {\n    x f\n  }\n  W = string // )\n)\n", "type I interface{ N() }\n", "func N()\n", "var s = `raw {\n`\n", "var c = '{'\n",
          "// type Z int {\n", "/* func Q() {\n*/\n", "func G[T any](x T) { call(\"}\", x) }\n", "func open() {\n", "\n"]
    for lang, pieces, scan in (("js", js, scan_js), ("go", go, scan_go)):
        texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(250)]
        got, want = by_spark(spark, texts, lang), literal(texts, scan)
        assert [(t, a, b) for t, a, b in zip(texts, got, want) if a != b][:1] == []


def test_python_ranges():
    """Byte columns beyond ASCII, line ends of all kinds, functions in methods, classes in functions, files that do not parse."""
    src = "class É:\r\n    def m(self):\r\n        def g(): return 'ü', f('ß')(1)\r\n        return g()\r\n\r\ndef t():\r\n    class I:\r\n        def n(self): pass\r\n    return I\r\n"
    rows = scan_python(src)
    assert {(r["name"], r["kind"], r["start_line"], r["end_line"]) for r in _by(rows, "symbol")} == {
        ("É", "class", 1, 4), ("É.m", "method", 2, 4), ("É.g", "method", 3, 3), ("t", "function", 6, 9), ("I", "class", 7, 8), ("I.n", "method", 8, 8)}
    assert {(r["name"], r["line"], r["col"]) for r in _by(rows, "call")} == {("f('ß')", 3, 30), ("f", 3, 30), ("g", 4, 15)}
    assert next(r["body"] for r in rows if r["name"] == "É.g") == "def g(): return 'ü', f('ß')(1)"
    assert scan_python("") == []


def test_js_forms():
    src = ("import Def, { a, b as c } from 'mod';\nimport * as ns from \"./ns\";\n"
           "export const f = async (x) => {\n  return g(x);\n};\nconst h = y => y + 1;\n"
           "class K extends Base {\n  static make() { return new K(); }\n  run(a) {\n    this.go(a);\n  }\n}\n"
           "function outer() { /* } */ const s = '}'; return 1; }\n")
    rows = scan_js(src)
    syms = {(r["name"], r["kind"], r["start_line"], r["end_line"]) for r in _by(rows, "symbol")}
    assert ("f", "function", 3, 5) in syms and ("h", "function", 6, 6) in syms
    assert ("K", "class", 7, 12) in syms and ("K.make", "method", 8, 8) in syms and ("K.run", "method", 9, 11) in syms
    assert ("outer", "function", 13, 13) in syms
    calls = {(r["name"], r["line"]) for r in _by(rows, "call")}
    assert ("g", 4) in calls and ("this.go", 10) in calls
    assert not any(n in ("run", "make", "outer", "K") for n, _ in calls)


def test_go_forms():
    src = ('package p\n\nimport "fmt"\nimport (\n  alias "a/b"\n  "c"\n)\n\ntype (\n  T struct {\n    x int\n  }\n'
           '  U int\n)\n\nfunc (t *T) M() { fmt.Println(t.x) }\n\nfunc F(a int) int {\n  return helper(a)\n}\n')
    rows = scan_go(src)
    syms = {(r["name"], r["kind"], r["start_line"], r["end_line"]) for r in _by(rows, "symbol")}
    assert ("T", "class", 10, 12) in syms and ("U", "class", 13, 13) in syms
    assert ("T.M", "method", 16, 16) in syms and ("F", "function", 18, 20) in syms
    calls = {(r["name"], r["line"]) for r in _by(rows, "call")}
    assert ("fmt.Println", 16) in calls and ("helper", 19) in calls
