"""Definitions, calls, imports and bases of every language."""

import pytest

from skeinworks.operators.extract import EXTRACTORS

# source, definitions, calls, imports (local, imported, specifier), bases
CASES = {
    "cpp": ('#include "a.h"\nnamespace n {\nclass A : public B, private virtual C {\n public:\n  A();\n  ~A();\n  int go(int x) const;\n  int x = 1;\n};\nint A::go(int x) const { return helper(x); }\n}\ntypedef struct node node_t;\nenum E { One, Two };\n', {("namespace", "n"), ("class", "A"), ("method", "A"), ("method", "~A"), ("method", "go"), ("field", "x"), ("function", "go"), ("type_alias", "node_t"), ("enum", "E"), ("enum_member", "One"), ("enum_member", "Two")}, ["helper"], [("a.h", "*", "a.h")], [("B", "extends"), ("C", "extends")]),
    "csharp": ("using System.IO;\nusing X = A.B;\nnamespace N {\npublic class A : B, C {\n  private int x = 1;\n  public int P { get; set; }\n  public A() { Init(); }\n  public int Go(string y) { return this.Run(y); }\n}\n}\n", {("namespace", "N"), ("class", "A"), ("field", "x"), ("property", "P"), ("method", "A"), ("method", "Go")}, ["Init", "Run"], [("IO", "IO", "System.IO"), ("X", "B", "A.B")], [("B", "extends"), ("C", "extends")]),
    "php": ("<?php\nuse A\\B;\nuse A\\B as C, D;\nuse P\\{Q, R as S};\n# note f()\nclass K extends L implements M, O {\n  const X = 1;\n  private $y = 'call(';\n  public function go($z) { return $this->run($z); }\n}\nenum E { case One; case Two; }\nfunction free() { helper(); }\n", {("class", "K"), ("constant", "X"), ("field", "y"), ("method", "go"), ("enum", "E"), ("enum_member", "One"), ("enum_member", "Two"), ("function", "free")}, ["run", "helper"], [("B", "B", "A\\B"), ("C", "B", "A\\B"), ("D", "D", "D"), ("Q", "Q", "P\\Q"), ("S", "R", "P\\R")], [("L", "extends"), ("M", "implements"), ("O", "implements")]),
    "kotlin": ("import a.b.c as d\nimport a.b.*\nimport x.y.Z\nclass A(val x: Int) : B(), C {\n  fun go(y: String): Int { return run(y) }\n}\nenum class E { One, Two }\nclass D : F\ninterface I\nfun free() { helper() }\n", {("class", "A"), ("method", "go"), ("enum", "E"), ("enum_member", "One"), ("enum_member", "Two"), ("class", "D"), ("interface", "I"), ("function", "free")}, ["run", "helper"], [("d", "c", "a.b.c"), ("", "*", "a.b"), ("Z", "Z", "x.y.Z")], [("B", "extends"), ("C", "extends"), ("F", "extends")]),
    "swift": ("import Foundation\nclass A: B, C {\n  var x = 1\n  func go(y: String) -> Int { return run(y) }\n}\nlet top = 2\nstruct S { }\nprotocol P { func f() }\nenum E { case one, two }\n", {("class", "A"), ("field", "x"), ("method", "go"), ("constant", "top"), ("struct", "S"), ("interface", "P"), ("method", "f"), ("enum", "E"), ("enum_member", "one"), ("enum_member", "two")}, ["run"], [("Foundation", "*", "Foundation")], [("B", "extends"), ("C", "extends")]),
    "dart": ("import 'package:a/b.dart';\nclass A extends B with C implements D {\n  int x = 1;\n  int go(String y) { return run(y); }\n}\nenum E { one, two }\n", {("class", "A"), ("field", "x"), ("method", "go"), ("enum", "E"), ("enum_member", "one"), ("enum_member", "two")}, [], [("package:a/b.dart", "*", "package:a/b.dart")], [("B", "extends"), ("C", "extends"), ("D", "implements")]),
    "scala": ("import a.b.{c, d => e}\nimport x.Y\nclass A(val p: Int, q: String) extends B with C {\n  val x = 1\n  def go(y: String): Int = { run(y) }\n}\nobject O { def main(): Unit = helper() }\ntrait T\n", {("class", "A"), ("field", "p"), ("field", "q"), ("field", "x"), ("method", "go"), ("class", "O"), ("method", "main"), ("trait", "T")}, ["run", "helper"], [("c", "c", "a.b.c"), ("Y", "Y", "x.Y")], [("B", "extends"), ("C", "extends")]),
    "zig": ('const std = @import("std");\npub const A = struct {\n    x: u32,\n    pub fn go(self: *A) u32 {\n        return helper(self.x);\n    }\n};\nconst E = enum { one, two };\nvar top: u32 = 1;\nfn free() void {}\n', {("constant", "std"), ("struct", "A"), ("field", "x"), ("method", "go"), ("enum", "E"), ("enum_member", "one"), ("enum_member", "two"), ("variable", "top"), ("function", "free")}, ["helper"], [("std", "*", "std")], []),
    "rust": ("use a::{b, c as d};\ntrait A: B + C {}\ntrait G<T>: H<T> + J where T: K { fn f(&self); }\nfn go() { run(); }\n", {("trait", "A"), ("trait", "G"), ("method", "f"), ("function", "go")}, ["run"], [("b", "b", "a::b"), ("d", "c", "a::c")], [("B", "extends"), ("C", "extends"), ("J", "extends")]),
    "typescript": ("import x, { y as z } from './m'\nimport * as w from 'v'\nclass A<T extends Q> extends B implements C, D<E> {}\ninterface I extends J, K {}\n", {("class", "A"), ("interface", "I")}, [], [("x", "default", "./m"), ("z", "y", "./m"), ("w", "*", "v")], [("B", "extends"), ("C", "implements"), ("J", "extends"), ("K", "extends")]),
    "java": ("import a.b.C;\npublic class A<T> extends B implements C, D {\n  A() { init(); }\n}\n", {("class", "A"), ("method", "A")}, ["init"], [("C", "C", "a.b.C")], [("B", "extends"), ("C", "implements"), ("D", "implements")]),
    "go": ('package p\nimport (\n\t"a/b"\n\tc "d"\n)\ntype S struct {\n\tn int\n}\nfunc (s *S) Run() { b.Do() }\n', {("type_alias", "S"), ("field", "n"), ("method", "Run")}, ["Do"], [("b", "*", "a/b"), ("c", "*", "d")], []),
    "c": ('#include <stdio.h>\ntypedef int number;\nint go(void) { return puts("(x"); }\n', {("type_alias", "number"), ("function", "go")}, ["puts"], [("stdio.h", "*", "stdio.h")], []),
    "ruby": ("require 'a/b'\nclass A < B\n  def go\n    run(1)\n  end\nend\n", {("class", "A"), ("method", "go")}, ["run"], [("b", "*", "a/b")], [("B", "extends")]),
    "python": ("from .a import b as c\nclass A(B, d.E):\n    def go(self):\n        return run()\n", {("class", "A"), ("method", "go")}, ["run"], [("c", "b", ".a")], [("B", "extends")]),
}


@pytest.mark.parametrize("language", CASES)
def test_language(language):
    source, definitions, calls, imports, bases = CASES[language]
    for text in (source, source.replace("\n", "\r\n")):
        e = EXTRACTORS[language](text)
        assert {(d["kind"], d["name"]) for d in e.definitions} == definitions
        assert [c["callee_name"] for c in e.calls] == calls
        assert [(i["local_name"], i["imported_name"], i["specifier"]) for i in e.imports] == imports
        assert [(h["target_name"], h["relation"]) for h in e.heritage] == bases


def test_common_js_exports():
    source = "function go() {}\nfunction own() {}\nconst z = 1\nfunction whole() {}\nmodule.exports.go = go\nexports.z = z\nif (a) { exports.own = own }\nmodule.exports = whole\nmodule.exports = { own }\n"
    got = {d["name"]: d["is_exported"] for d in EXTRACTORS["javascript"](source).definitions}
    assert got == {"go": True, "own": False, "z": True, "whole": True}


@pytest.mark.parametrize("piece, head, tail, language", [("f{i}, {i}, ", "const T = [", "]", "javascript"), ("a{i}, ", "class A {{ int[] x = f(", "0); }}", "java"), (".f(1)", "x", "", "typescript"), ("{i}: {i}, ", "x = {{", "}}", "python")])
def test_costs_grow_with_the_length_of_a_statement(piece, head, tail, language):
    import time

    def seconds(n):
        source = head.format() + "".join(piece.format(i=i) for i in range(n)) + tail.format()
        begin = time.perf_counter()
        EXTRACTORS[language](source)
        return time.perf_counter() - begin

    seconds(1000)
    assert min(seconds(16_000) for _ in range(2)) < 12 * max(min(seconds(4_000) for _ in range(3)), 0.002)  # in proportion: 4 times
