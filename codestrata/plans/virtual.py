"""Virtual repositories over the driver's tables, so that operators run on whole tables.

The same relations are stated as DuckDB CTEs for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = """
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'api' WHEN 1 THEN 'services' WHEN 2 THEN 'repositories' WHEN 3 THEN 'components' WHEN 4 THEN 'tests' ELSE 'core' END
      || '/source/d' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.ts' WHEN 'de' THEN '.go' ELSE '.java' END AS path,
    CASE lang WHEN 'en' THEN 'Python' WHEN 'fr' THEN 'TypeScript' WHEN 'de' THEN 'Go' ELSE 'Java' END AS language,
    CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.ts' WHEN 'de' THEN '.go' ELSE '.java' END AS extension,
    %s AS size_bytes, text FROM documents"""
DEPENDENCIES = """
  SELECT a.path AS source, b.path AS target, CASE WHEN t IS NULL THEN 'ext' || ((s + k) % 7) ELSE 'mod' || t END AS import_name, s * 16 + k AS edge_ord
  FROM (
    SELECT s, k, CASE WHEN (s + k) % 11 = 0 THEN NULL WHEN k % 3 = 2 THEN (s + k) % 20 WHEN (u % 24) < 6 THEN (u + 6) % n ELSE u END AS t
    FROM (SELECT doc_id AS s, k, n, (doc_id * 7 + k * 31) % n AS u FROM (SELECT doc_id, %s AS k FROM documents) x CROSS JOIN (SELECT count(*) AS n FROM documents) y) z
    WHERE s % 97 <> 5
  ) d JOIN files a ON a.doc_id = s LEFT JOIN files b ON b.doc_id = t WHERE t IS NULL OR t <> s"""
RINGS = """
  SELECT 'src/m' || s || '.ts' AS source, 'src/m' || t || '.ts' AS target, s AS edge_ord FROM (
    SELECT doc_id AS s, doc_id - doc_id % 5 + (doc_id + 1) % 5 AS t FROM documents UNION ALL SELECT doc_id, doc_id + 2 FROM documents WHERE doc_id % 5 = 0) r"""
# Long rings of 16 files and dense groups of 6 that all import each other but for one pair, with a chain of dead ends behind.
DENSE = """
  SELECT 'ring/m' || doc_id || '.ts' AS source, 'ring/m' || (doc_id - doc_id % 16 + (doc_id + 1) % 16) || '.ts' AS target, doc_id AS edge_ord FROM documents WHERE doc_id % 64 < 16
  UNION ALL SELECT 'dense/m' || doc_id || '.ts', 'dense/m' || (doc_id - doc_id % 6 + k) || '.ts', doc_id FROM (SELECT doc_id, %s AS k FROM documents WHERE doc_id % 60 < 6) x WHERE doc_id % 6 <> k AND NOT (doc_id % 6 = 5 AND k = 0)
  UNION ALL SELECT 'dense/m' || doc_id || '.ts', 'dense/z' || (doc_id + k) || '.ts', doc_id FROM (SELECT doc_id, %s AS k FROM documents WHERE doc_id % 60 < 6) x"""
SYMBOLS = """
  SELECT doc_id, path, k AS sym_ord, CASE WHEN k = 1 THEN 'class' WHEN k = 2 THEN 'import' ELSE 'function' END AS kind, 'sym' || (doc_id % 7) || '_' || k AS name,
    k * 3 AS line, k * 3 + doc_id % 200 AS end_line FROM (SELECT doc_id, path, %s AS k FROM files) x"""
NODES = """
  SELECT 'src/m' || (p_partkey % 50) || '.py' AS path, 'fn_' || (p_partkey % {m}) AS name, p_partkey AS node_ord,
    'src/m' || (p_partkey % 50) || '.py:fn_' || (p_partkey % {m}) AS id FROM part CROSS JOIN (SELECT count(*) AS n FROM part) y"""
CALLS = """
  SELECT l_orderkey, l_linenumber, 'src/m' || (l_partkey % 50) || '.py' AS path, 'fn_' || (l_suppkey % n) AS caller, 'fn_' || (l_orderkey % n) AS callee
  FROM lineitem CROSS JOIN (SELECT count(*) AS n FROM part) y"""

# Source files, a document each: Python modules and packages, and TypeScript.
PYTHON = (
    "'import os'", "'from app.m' || ((doc_id * 7 + 1) % n) || ' import f' || (doc_id % 5)", "'import util' || (doc_id % 3)",
    "CASE WHEN doc_id % 10 = 9 THEN 'from . import g' ELSE 'import app.m' || ((doc_id + 8) % n) || ', json' END", "'# note: helper(1)'", "'class K' || (doc_id % 9) || '(Base, m.Mixin):'",
    "'    def run(self, x):'", "'        if x == None:'", "'            helper' || (doc_id % 4) || '(x)'", "'    '", "'    def stop(self):'", "'        run(stop(x))'", "''",
    "'def helper' || (doc_id % 4) || '(a):'",
    "CASE doc_id % 5 WHEN 0 THEN '    eval(a)  # TODO' WHEN 1 THEN '    assert a' WHEN 2 THEN '    print(a)' WHEN 3 THEN '    os.system(a)' ELSE '    return fresh' || ((doc_id + 4) % n) || '(a)' END",
    "'total' || (doc_id % 3) || ' = helper' || (doc_id % 4) || '(1)'", "'def fresh' || doc_id || '():'", "'    return total' || (doc_id % 3) || ' + helper' || ((doc_id + 1) % 4) || '(2)'",
    "CASE WHEN doc_id % 40 = 1 THEN 'def broken(:' ELSE '' END", "CASE WHEN doc_id % 8 = 0 THEN repeat('x = 1' || chr(10), 8) ELSE '' END",
)
TYPESCRIPT = (
    """'import { b } from "./m' || ((doc_id + 4) % n) || '"'""", """'import React from "react"'""", "'export class V' || (doc_id % 9) || ' {'", "'  function () { boot(); }'",
    "'  const z = make' || (doc_id % 4) || '(1);'", "'}'", "'export function render' || (doc_id % 4) || '() {'", "'  hydrate(render' || (doc_id % 4) || '());'", "'}'",
)
CODE = """
  SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'web/m' || doc_id || '.ts' WHEN doc_id % 10 = 9 THEN 'app/m' || doc_id || '/__init__.py' ELSE 'app/m' || doc_id || '.py' END AS path,
    CASE WHEN doc_id % 4 = 3 THEN 'TypeScript' ELSE 'Python' END AS language, CASE WHEN doc_id % 4 = 3 THEN {ts} ELSE {py} END AS text
  FROM documents CROSS JOIN (SELECT count(*) AS n FROM documents) y""".replace("{ts}", " || chr(10) || ".join(TYPESCRIPT)).replace("{py}", " || chr(10) || ".join(PYTHON))
# Files of five brace languages, with braces in strings and comments, and bodies of 0 to 169 more lines.
MORE = "CASE WHEN doc_id % 170 > 0 THEN chr(10) || repeat('    step(1); // }' || chr(10), CAST(doc_id % 170 - 1 AS INT)) || '    step(2); /* { */' ELSE '' END"
BRACES = {
    0: ("ts", "'import x from \"./x\"'", "'export interface Shape' || (doc_id % 7) || ' extends Base {'", "'  area: number;'", "'}'", "'export class Box' || (doc_id % 7) || ' extends Base implements Shape' || (doc_id % 7) || ' {'",
        "'  grow(n: number): string {'", "'    const s = \"}{\"; // {' || {more}", "'    if (n) {'", "'      return `}`;'", "'    }'", "'  }'", "'}'", "'function help' || (doc_id % 5) || '(a) {'", "'  return a;'", "'}'"),
    1: ("java", "'import java.util.List;'", "'public class Box' || (doc_id % 7) || ' extends Base implements Shape {'", "'  private int n;'", "'  public List<String> grow(int n) {'", "'    String s = \"}{\";' || {more}",
        "'    for (int i = 0; i < n; i++) {'", "'      step(i);'", "'    }'", "'    return make(s);'", "'  }'", "'}'", "'interface Shape' || (doc_id % 7) || ' {'", "'  int area(int a);'", "'}'"),
    2: ("go", "'package box'", "'type Box' || (doc_id % 7) || ' struct {'", "'  N int'", "'}'", "'func (b Box) Grow(n int) string {'", "'  s := \"}{\"' || {more}", "'  if n > 0 {'", "'    step(n)'", "'  }'", "'  return s'", "'}'", "'func help' || (doc_id % 5) || '() {'", "'}'"),
    3: ("rs", "'pub struct Box' || (doc_id % 7) || ' {'", "'  n: i32,'", "'}'", "'trait Shape {'", "'  fn area(&self) -> i32;'", "'}'", "'impl Shape for Box {'", "'  fn grow(&self) -> i32 {'", "'    let s = \"}{\";' || {more}",
        "'    if self.n > 0 {'", "'      step(1);'", "'    }'", "'    1'", "'  }'", "'}'"),
    4: ("c", "'#include <a.h>'", "'struct Box' || (doc_id % 7) || ' {'", "'  int n;'", "'};'", "'/* int no(void) { */'", "'static int grow(int n) {'", "'  char *s = \"}{\";' || {more}", "'  if (n) {'", "'    step(n);'", "'  }'", "'  return n;'", "'}'"),
}
BRACE = "SELECT doc_id, 'lib/b' || doc_id || CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN '.{v[0]}'" for k, v in BRACES.items()) + " END AS path, CASE doc_id % 5 " + " ".join(
    f"WHEN {k} THEN " + " || chr(10) || ".join(v[1:]).replace("{more}", MORE) for k, v in BRACES.items()) + " END AS text FROM documents"
# Python files with what the contribution rules look for: two rules or three a file, some over two lines.
SMELL = (
    "try:\n  go()\nexcept :\n  stop()", "try:\n  go()\nexcept Exception as e:\n  tell(e)", "x = 1  # TODO FIXME\n# BUG", "if d.has_key(k): go()\nif a in b and c in d: go()", "if x == None or None == y:\n  go()", "print (x); print(y)",
    "def f():\n  pass  \n\n", "global state\nglobal\n  other", "try: go()\nexcept ValueError: pass", "x = eval\n(y)", "exec (code)\nexec(more)", "run(a, shell = True)", "os.system(a)\nsubprocess.call(b); os.popen(c)", "pickle.load(f)\npickle.loads (g)",
    "yaml.load(f)\nyaml.load(f, Loader=L)", "assert\n  x", "get(u, verify = False)\nssl.VERIFY_NONE", "def f(a) -> int:\n    pass", "class A(B):\n  pass", "except ValueError as e:\n    pass", "print(1)\nreprint(2)", "  # type: ignore\nx = 1  # type: ignore",
    "b = a.encode('utf-8')", "for x in y:\n  out.append(x)", "s += 'a'\ns = 'b' += t", "from m import *",
)
SMELLS = "SELECT doc_id, 'src/s' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.ts' ELSE '.py' END AS path, {n} AS n, 'import os' || chr(10) || {a} || chr(10) || {b} || chr(10) || repeat('x = 0' || chr(10), CAST(doc_id % 23 AS INT)) || CASE WHEN doc_id % 4 = 1 THEN '\"\"\"docs\"\"\"' ELSE '' END AS text FROM documents".format(
    n="doc_id % 26", **{c: f"CASE (doc_id * {m} + {k}) % 26 " + " ".join(f"WHEN {i} THEN " + " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in t.split("\n")) for i, t in enumerate(SMELL)) + " END" for c, m, k in (("a", 1, 0), ("b", 5, 3))})
# Wide classes: the methods of a class of each fiftieth file.
MEMBERS = """
  SELECT path, k AS sym_ord, 'method' AS kind, 'get_' || k AS name, k + 1 AS line, k + 1 AS end_line, 'sym' || (doc_id % 7) || '_1' AS parent FROM (SELECT doc_id, path, %s AS k FROM files WHERE doc_id % 50 IN (1, 2, 3)) x"""
# A stack trace a document, in four languages and without frames; paths with blanks, dots, doubled slashes, of bundles and drives.
TRACES = """
  SELECT doc_id AS trace_id, CASE doc_id % 5
    WHEN 0 THEN 'Traceback' || chr(10) || '  File " /srv//app/./' || path || ' ", line ' || (doc_id % 90 + 1) || ', in go' || chr(10) || '  File "' || CASE WHEN doc_id % 10 = 0 THEN 'webpack://lib//./x.py' WHEN doc_id % 3 = 0 THEN 'C:' || chr(92) || 'lib' || chr(92) || 'x.py' ELSE '//lib/x.py' END || '", line 3, in call ' || chr(10) || 'ValueError: bad ' || doc_id
    WHEN 1 THEN 'TypeError: no ' || doc_id || chr(10) || '  at Page.show (/srv/' || path || ':' || (doc_id % 90 + 1) || ':7)' || chr(10) || '  at next (file:///srv/./' || path || ':1:2)'
    WHEN 2 THEN 'java.lang.IllegalStateException: x' || chr(10) || '  at com.acme.A.b(A' || doc_id || '.java:' || (doc_id % 90 + 1) || ')' || chr(10) || 'Caused by' || chr(10) || 'IOException'
    WHEN 3 THEN 'panic: boom ' || doc_id || chr(10) || chr(9) || './/' || path || '.go:' || (doc_id % 90 + 1) || ' +0x1' || chr(10) || chr(9) || 'main.go:2'
    ELSE 'nothing to see' END AS text FROM files"""

DUCK = {
    "files": FILES.replace("%s", "strlen(text)"), "edges": DEPENDENCIES.replace("%s", "unnest(range(0, doc_id % 10 + 1))"), "rings": RINGS,
    "symbols": SYMBOLS.replace("%s", "unnest(range(1, doc_id % 4 + 1))"), "nodes": NODES.format(m="(3 * n // 4)"), "calls": CALLS,
    "code": CODE, "members": MEMBERS.replace("%s", "unnest(range(1, doc_id % 50 * 8 + 1))"), "traces": TRACES, "braces": BRACE, "smells": SMELLS, "dense": DENSE.replace("%s", "unnest(range(0, 6))"),
}
SPARK = {
    "files": FILES.replace("%s", "octet_length(text)"), "edges": DEPENDENCIES.replace("%s", "explode(sequence(0, doc_id % 10))"), "rings": RINGS,
    "symbols": SYMBOLS.replace("%s", "explode(slice(array(1, 2, 3), 1, cast(doc_id % 4 AS int)))"), "nodes": NODES.format(m="(3 * n div 4)"), "calls": CALLS,
    "code": CODE, "members": MEMBERS.replace("%s", "explode(sequence(1, cast(doc_id % 50 * 8 AS int)))"), "traces": TRACES, "braces": BRACE, "smells": SMELLS, "dense": DENSE.replace("%s", "explode(sequence(0, 5))"),
}


def duck(*names: str, recursive: bool = False) -> str:
    """The WITH clause of these relations."""
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(f"{n} AS ({DUCK[n]})" for n in names)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation of this module as a DataFrame, without temporary names in the session."""
    base = {"nodes": ["part"], "calls": ["lineitem", "part"]}.get(name, ["documents"])
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in base}
    with_ = f"WITH files AS ({SPARK['files']}) " if name in ("edges", "symbols", "members", "traces") else ""
    sql = (with_ + SPARK[name]).replace("{", "{{").replace("}", "}}")  # braces of the texts
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    out = spark.sql(sql, **tables)
    if name in ("code", "smells"):
        out = out.withColumn("size_bytes", F.octet_length("text").cast("long"))
    if name == "members":
        out = out.withColumns({"line": F.col("line").cast("int"), "end_line": F.col("end_line").cast("int"), "inherits": F.array().cast("array<string>")})
    if name == "symbols":
        out = out.withColumns({"line": F.col("line").cast("int"), "end_line": F.col("end_line").cast("int"), "parent": F.lit(None).cast("string"), "inherits": F.array().cast("array<string>")})
    if name == "calls":
        out = out.withColumns({"recursive": F.col("caller") == F.col("callee"), "call_ord": F.struct("l_orderkey", "l_linenumber")})
    if name == "nodes":
        out = out.withColumns({"kind": F.lit("function"), "line": F.lit(1), "parent": F.lit(None).cast("string")})
    return out
