"""Declarations of brace languages with their spans."""

import pytest

from codestrata.operators import blocks
from codestrata.plans.api import Repository

BRACED = {
    "main.c":"#include <stdio.h>\nint count = 0;\nstruct User { int id; };\nint add(int a, int b) {\n  int total = a + b;\n  return total;\n}\n/* int no(void) { */\nstatic char *\nname(struct User *u)\n{\n  if (u) { return \"}{\"; }\n  char c = '{';\n  return 0;\n}\ntypedef struct Pt { int x; } Pt;\nint t[] = { 1, 2 };\n",
    "main.cpp":"#include <vector>\nclass Service : public Base, private virtual ns::Other {\n public:\n  int run(int x) {\n    int value = x;\n    return value;\n  }\n};\nint make() {\n  auto item = Service();\n  return 1;\n}\nnamespace n {\nvoid Service::stop() const {\n  for (int i = 0; i < 3; i++) { go(i); }\n}\n}\n",
    "Main.java":"import java.util.List;\ninterface Named { String name(); }\n@Deprecated\npublic class UserService<T> extends BaseService<T> implements Named, A {\n  private int count;\n  UserService(int a) { super(a); }\n  @Override\n  public List<String> load(int id) throws X {\n    int value = id;\n    if (value > 0) { return foo(value); }\n    Runnable r = new Runnable() {\n      public void run() { }\n    };\n    return new ArrayList<>(id);\n  }\n  abstract void later(String s);\n}\n",
    "main.go":"package main\nimport \"fmt\"\ntype User struct { ID int }\ntype Doer interface {\n  Do() error\n}\nfunc (u User) Name() string { value := \"x{\"; return value }\nfunc main() {\n  count := 1\n  f := func() {\n    x()\n  }\n  if count > 0 {\n    fmt.Println(`{{`, count)\n  }\n}\nfunc multi(\n  a int,\n) (int, error) {\n  return 1, nil\n}\n",
    "main.rs":"use std::fmt;\nstruct User { id: i32 }\nstruct Unit;\npub struct Pair(i32, i32);\ntrait Named { fn name(&self) -> String; }\nimpl<'a> Named for User { fn load(&'a self) -> i32 { let value = self.id; value } }\nimpl Vec<T> {\n  pub async fn go<T>(x: T) -> Option<T> where T: Copy {\n    match x { '{' => 1, _ => 2 }\n  }\n}\n#[test]\nfn make_user() -> User { let user = User { id: 1 }; user }\nfn outer() {\n  fn inner() {}\n}\n",
    "app.js":"import fs from 'fs';\nexport class Worker extends BaseWorker {\n  run(input) {\n    const value = input;\n    return value;\n  }\n  async *gen({ a, b }, c = {}) {\n    if (a) { while (b) { go(); } }\n  }\n}\nexport function start() {\n  var enabled = true;\n  function nested() { return `${enabled}`; }\n  return enabled;\n}\nconst arrow = () => {\n  function hidden() {}\n};\nexport const workerName = 'forge';\nfoo(() => { function cb() { x(); } });\n",
    "app.ts":"import React from 'react';\nexport interface User extends Person {\n  id: string;\n}\nexport class UserStore extends BaseStore implements A, B {\n  find(id: string): Map<string, number> {\n    const value = id;\n    return value;\n  }\n}\nexport const storeName: string = 'users';\nexport default function main() {\n  // }\n}\nabstract class Abs {\n  private m(): void {}\n}\n",
    "open.ts":"class Half {\n  f() {\n    x();\n",
    "empty.ts":"", "close.go":"}\n}\nfunc a() {\n}\n", "no.py":"def f(): {}",
}

# path: kind, name, first line, column, last line, parent
WANT = {
    "main.c": [("class", "User", 3, 0, 3, None), ("function", "add", 4, 0, 7, None), ("function", "name", 9, 0, 15, None), ("class", "Pt", 16, 0, 16, None)],
    "main.cpp": [("class", "Service", 2, 0, 8, None), ("method", "run", 4, 2, 7, "Service"), ("function", "make", 9, 0, 12, None), ("function", "stop", 14, 0, 16, None)],
    "Main.java": [("interface", "Named", 2, 0, 2, None), ("method", "name", 2, 18, 2, "Named"), ("class", "UserService", 3, 0, 17, None), ("method", "load", 7, 2, 15, "UserService"), ("method", "later", 16, 2, 16, "UserService")],
    "main.go": [("class", "User", 3, 0, 3, None), ("class", "Doer", 4, 0, 6, None), ("method", "Name", 7, 0, 7, None), ("function", "main", 8, 0, 16, None), ("function", "multi", 17, 0, 21, None)],
    "main.rs": [
        ("class", "User", 2, 0, 2, None), ("class", "Unit", 3, 0, 3, None), ("class", "Pair", 4, 0, 4, None), ("interface", "Named", 5, 0, 5, None), ("method", "name", 5, 14, 5, "Named"), ("method", "load", 6, 26, 6, "User"),
        ("method", "go", 8, 2, 10, "Vec<T>"), ("function", "make_user", 13, 0, 13, None), ("function", "outer", 14, 0, 16, None), ("method", "inner", 15, 2, 15, "outer"),
    ],
    "app.js": [("class", "Worker", 2, 0, 10, None), ("method", "run", 3, 2, 6, "Worker"), ("method", "gen", 7, 2, 9, "Worker"), ("function", "start", 11, 0, 15, None), ("method", "nested", 13, 2, 13, "start"), ("function", "cb", 20, 12, 20, None)],
    "app.ts": [("interface", "User", 2, 0, 4, None), ("class", "UserStore", 5, 0, 10, None), ("method", "find", 6, 2, 9, "UserStore"), ("function", "main", 12, 0, 14, None), ("method", "m", 16, 2, 16, None)],
    "open.ts": [("class", "Half", 1, 0, 3, None), ("method", "f", 2, 2, 3, "Half")], "close.go": [("function", "a", 3, 0, 4, None)],
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([*BRACED.items(), ("null.ts", None)], "path string, text string")
    return blocks.declarations(files).orderBy("path", "sym_ord").collect()


def test_spans_and_owners(found):
    got = {p: [(r.kind, r.name, r.line, r.col, r.end_line, r.parent) for r in found if r.path == p] for p in {r.path for r in found}}
    assert got == WANT


def test_bases_and_exports(found):
    bases = {(r.path, r.name): r.inherits for r in found if r.inherits}
    assert bases == {
        ("main.cpp", "Service"): ["Base", "ns", "Other"], ("Main.java", "UserService"): ["BaseService", "T", "Named", "A"], ("app.js", "Worker"): ["BaseWorker"],
        ("app.ts", "User"): ["Person"], ("app.ts", "UserStore"): ["BaseStore", "A", "B"],
    }
    assert {(r.path, r.name) for r in found if r.exported} == {("app.js", "Worker"), ("app.js", "start"), ("app.ts", "User"), ("app.ts", "UserStore"), ("app.ts", "main")}


def test_columns_and_no_python(spark, found):
    ends = {(r.path, r.name): r.end_col for r in found}
    assert ends["main.c", "add"] == 1 and ends["app.js", "nested"] == len(BRACED["app.js"].split("\n")[12]) and ends["main.rs", "name"] == len("trait Named { fn name(&self) -> String;")
    files = spark.createDataFrame([], "path string, text string")
    plan = blocks.declarations(files)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and blocks.declarations(files).collect() == []


def test_repository_spans(spark):
    long_ = "class A {\n  run() {\n" + "    x();\n" * 170 + "  }\n}\n"
    with_spans = Repository.of(spark, [("a.ts", "import b from './b';\n" + long_), ("b.ts", "const q = 1;\n")], syntax=True)
    rows = [(r.kind, r.name, r.line, r.end_line) for r in with_spans.symbols.orderBy("path", "sym_ord").collect()]
    assert rows == [("import", "b from", 1, 1), ("class", "A", 2, 175), ("method", "run", 3, 174), ("variable", "q", 1, 1)]
    debt = {r.category for r in with_spans.technical_debt()[0].collect()}
    assert "long_symbol" in debt
    with_spans.close()
