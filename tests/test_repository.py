"""The repository operators on small source trees, with expectations derived by hand from the rules."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.operators import chunks, findings, graphs, impact, knowledge, memory, parse, reports, review, stores, syntax
from codestrata.plans.api import Repository
from codestrata.sources import repository as R
from codestrata.streaming import progress

DEPS = [
    ("app/main.py", "import os\nfrom app.service import Service"), ("app/service.py", "class Service:\n    pass"),
    ("src/a.ts", "import { b } from './b';\nexport const a = b;"), ("src/b.ts", "import { a } from './a';\nexport const b = a;"),
]


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_scan(spark, tmp_path):
    for path, text in {"app/main.py": "print('hello')", "app/__init__.py": "", "web/index.tsx": "export default function Page() {}", "README.md": "# Demo", "_p/y.py": "", ".hid/z.py": "", "node_modules/x.py": "", "target/q.py": ""}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path / "README.md", tmp_path / "link.md")
    rows = R.scan(spark, str(tmp_path)).orderBy("file_ord").collect()
    assert [r.path for r in rows if not r.is_dir] == ["README.md", ".hid/z.py", "_p/y.py", "app/__init__.py", "app/main.py", "web/index.tsx"]
    assert {r.path for r in rows if r.is_dir} == {".hid", "_p", "app", "web", "empty"}
    assert {r.path: r.language for r in rows}["web/index.tsx"] == "TypeScript" and {r.path: r.language for r in rows}["README.md"] is None
    with pytest.raises(Exception, match="not a directory"):
        R.scan(spark, str(tmp_path / "nothing")).collect()


def test_zip_and_names(spark, tmp_path):
    def write(name, *members):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for m in members:
                z.writestr(m, "x")
        (tmp_path / name).write_bytes(raw.getvalue())

    write("good.zip", "a/__init__.py", "b.py")
    assert [r[0] for r in sorted(R.read_zip(spark, str(tmp_path)).select("path").collect())] == ["a/__init__.py", "b.py"]
    write("bad.zip", "../evil.py")
    with pytest.raises(Exception, match="unsafe archive member"):
        R.read_zip(spark, str(tmp_path)).select("content").collect()
    names = spark.createDataFrame([("my repo!.zip",), ("...",), ("a-b_c.zip",)], "n string").select(R.safe_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["my-repo", "repository", "a-b_c"]
    urls = ["https://github.com/o/r", "https://github.com/o/r.git", "http://github.com/o/r", "https://evil.com/o/r", "https://github.com/o/r/x"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(R.github_url(F.col("u"))).collect()
    assert [r[0] for r in got] == ["https://github.com/o/r.git"] * 2 + [None] * 3


def test_text_modes(spark):
    df = R.describe(spark.createDataFrame([("a.py", False, b"ok\x80")], "path string, is_dir boolean, content binary"))
    assert [R.read_text(df, m).first()["text"] for m in ("strict", "replace", "ignore")] == [None, "ok\ufffd", "ok"]


def test_text_functions(spark):
    def value(c):
        return spark.range(1).select(c).first()[0]

    for text in ("", "a", "a\n", "a\r\nb\rc\x0bd\u2028e\n\n", "a b\u00a0c"):
        assert value(X.lines(F.lit(text))) == text.splitlines()
    assert value(X.strip(F.lit("\u00a0\t x \u2003\r"))) == "x"
    assert value(X.normal_path(F.lit("a/./b/../../c//d"))) == "c/d" and value(X.normal_path(F.lit("../a"))) == "../a" and value(X.normal_path(F.lit("a/.."))) == "."
    assert value(X.suffix(F.lit("a/.env"))) == "" and value(X.suffix(F.lit("a/b.Test.PY"))) == ".py"
    assert value(X.count_of(F.lit("a&&&b"), "&&")) == 1


def test_line_parser():
    got = parse.parse_symbols("class A:\n    def f(self):\n        x = 1\n    # c\n    def g(self):\n        pass\n\n    def h(self):\n        pass\nimport a as b, c\nfrom .m import q", True)
    assert [(s["kind"], s["name"], s["parent"]) for s in got] == [("class", "A", None), ("method", "f", "A"), ("variable", "x", "f"), ("method", "g", "A"), ("function", "h", None), ("import", "a", None), ("import", "q", None)]
    assert got[-1]["source"] == ".m" and got[1]["line"] == 2 and got[1]["col"] == 6 and got[1]["end_col"] == 7  # the first f of the line
    js = parse.parse_symbols("import React from 'react'\nimport {b} from './b'\nexport class K {\nlet z = 1", False)
    assert [(s["kind"], s["name"], s["source"]) for s in js] == [("import", "React from", None), ("import", "{b}", "./b"), ("class", "K", None), ("variable", "z", None)]
    calls = parse.parse_calls("def main():\n    main()\n    print('done')\nif (x):\n  foo(bar(1))")
    assert [(c["caller"], c["callee"], c["recursive"]) for c in calls] == [("main", "main", True), ("main", "print", False), (None, "foo", False), (None, "bar", False)]


def test_blank_lines_and_unnamed_functions():
    got = parse.parse_symbols("class A:\n    def f(self):\n        x = 1\n    \n    def g(self):\n        pass\n", True)
    assert [(s["kind"], s["name"], s["parent"]) for s in got] == [("class", "A", None), ("method", "f", "A"), ("variable", "x", "f"), ("method", "g", "A")]
    assert parse.parse_calls("function () { foo(); }\nexport async function  (a) { bar(); }") == []
    assert [c["callee"] for c in parse.parse_calls("function() { foo(); }")] == ["foo"]


def test_syntax_tree():
    text = "import os as o, sys\nfrom .m import q\nfrom x import *\n\n@deco(1)\nclass A(Base, m.Other, metaclass=M):\n    y: int = f(2)\n    def run(self, x=g()):\n        def inner():\n            return run(x.call(a)(b))\n        if x:\n            z = h(lambda: k())\n        return inner()\n\nasync def top():\n    top()\nv = w = 3\na.b = 4\n"
    symbols, calls = syntax.parse_python(text)
    assert [(s["kind"], s["name"], s["parent"], s["line"], s["end_line"]) for s in symbols] == [
        ("import", "os as o", None, 1, 1), ("import", "q", None, 2, 2), ("class", "A", None, 6, 13), ("variable", "y", "A", 7, 7), ("method", "run", "A", 8, 13),
        ("method", "inner", "run", 9, 10), ("variable", "z", "run", 12, 12), ("function", "top", None, 15, 16), ("variable", "v", None, 17, 17)]
    assert symbols[1]["source"] == ".m" and symbols[2]["inherits"] == ["Base", "m", "Other", "metaclass", "M"]
    assert [(c["caller"], c["callee"], c["recursive"]) for c in calls] == [
        (None, "deco", False), (None, "f", False), ("run", "g", False), ("inner", "run", False), ("inner", "a", False), ("inner", "call", False),
        ("run", "h", False), ("run", "k", False), ("run", "inner", False), ("top", "top", True)]
    assert syntax.parse_python("def (") is None and syntax.parse_python("x = '\0'") is None and syntax.parse_python("") == ([], [])


def test_dependencies(spark):
    r = Repository.of(spark, DEPS)
    inner = graphs.internal(r.dependencies)
    assert pairs(inner, "source", "target") == [("app/main.py", "app/service.py"), ("src/a.ts", "src/b.ts"), ("src/b.ts", "src/a.ts")]
    assert pairs(graphs.external_names(r.dependencies), "import_name") == [("os",)]
    assert [x.files for x in r.cycles().collect()] == [["src/a.ts", "src/b.ts"]]
    assert r.dependency_stats().first().asDict() == {"file_count": 4, "internal_dependency_count": 3, "external_dependency_count": 1, "unresolved_import_count": 1, "circular_dependency_count": 1}


def test_import_quirks(spark):
    files = [("app/__init__.py", ""), ("app/util.py", ""), ("util.py", ""), ("foo.h", ""), ("app/x.py", "from . import y\nfrom .util import z\nimport util\n")]
    got = pairs(Repository.of(spark, files).dependencies, "import_name", "target")
    assert got == [("util", "util.py"), ("y", "app/__init__.py"), ("z", None)] or dict(got) == {"util": "util.py", "y": "app/__init__.py", "z": None}


def test_three_file_cycle(spark):
    r = Repository.of(spark, [("src/a.ts", "import { b } from './b';"), ("src/b.ts", "import { c } from './c';"), ("src/c.ts", "import { a } from './a';"), ("src/d.ts", "")])
    found, edges, stats = r.cycle_report()
    assert [x.files for x in found.collect()] == [["src/a.ts", "src/b.ts", "src/c.ts"]] and edges.count() == 3
    assert stats.first().asDict() == {"cycle_count": 1, "max_length": 3, "affected_files": 3, "internal_dependencies": 3}


def test_calls(spark):
    r = Repository.of(spark, [
        ("app/main.py", "def helper():\n    return 1\n\ndef main():\n    helper()\n    main()\n    missing()"),
        ("web/app.ts", "export function render() {\n  hydrate();\n}\n\nfunction hydrate() {\n  render();\n}"),
    ])
    assert pairs(r.call_nodes, "id") == [("app/main.py:helper",), ("app/main.py:main",), ("web/app.ts:hydrate",), ("web/app.ts:render",)]
    got = {(x.source, x.target, x.recursive) for x in r.call_graph.collect()}
    assert got == {("app/main.py:main", "app/main.py:helper", False), ("app/main.py:main", "app/main.py:main", True), ("app/main.py:main", None, False), ("web/app.ts:render", "web/app.ts:hydrate", False), ("web/app.ts:hydrate", "web/app.ts:render", False)}
    assert pairs(graphs.unresolved_calls(r.call_graph), "callee") == [("missing",)]


def test_chunks(spark):
    r = Repository.of(spark, [("main.py", "a = 1\nb = 2\nc = 3\n")])
    assert pairs(r.chunks(8), "start_line", "end_line", "content") == [(1, 1, "a = 1\n"), (2, 2, "b = 2\n"), (3, 3, "c = 3\n")]
    r = Repository.of(spark, [("app/service.py", "class UserService:\n    def load(self):\n        return 1\n\ndef make_user():\n    return 2\n"), ("README.md", "# x"), ("e.py", "")])
    rows = r.chunks().collect()
    assert sorted(x.symbol_name or "" for x in rows) == ["", "UserService", "load", "make_user"]
    assert all(x.id.startswith(f"{x.kind}:{x.path}:{x.start_line}:{x.end_line}:") and len(x.id.rsplit(":", 1)[1]) == 16 for x in rows)
    assert chunks.chunk_stats(r.sources, r.chunks()).first()["symbol_chunk_count"] == 3


def test_retrieval(spark, tmp_path):
    r = Repository.of(spark, [("app/auth.py", "def authenticate_user(token):\n    return token == 'valid'"), ("app/main.py", "from app.auth import authenticate_user\n\ndef request_handler(token):\n    return authenticate_user(token)")])
    rows = r.retrieve("auth token", 3).collect()
    assert rows[0].path == "app/auth.py" and rows[0].keyword_score > 0 and rows[0].vector_score > 0 and len(rows) == 3
    assert any("app/main.py" in x.related_paths for x in rows)
    r.store_vectors(str(tmp_path / "v"))
    r.store_vectors(str(tmp_path / "v"))
    assert memory.read_repository(spark, str(tmp_path / "v"), r.name, "path", "start_line").count() == 4
    with pytest.raises(KeyError):
        memory.read_repository(spark, str(tmp_path / "v"), "other")
    with pytest.raises(ValueError, match="No vectors"):
        Repository.of(spark, [("README.md", "")]).retrieve("x")
    with pytest.raises(ValueError, match="blank"):
        r.retrieve("  ")


def test_cycles_of_any_length(spark):
    ring = [f"r{i:02d}" for i in range(14)]
    edges = spark.createDataFrame([*zip(ring, ring[1:] + ring[:1]), ("r03", "r01"), ("x1", "r00")], "source string, target string")
    assert sorted(x.files for x in graphs.cycles(edges).collect()) == [ring, ring[1:4]]



def test_debt(spark):
    wide = "class Wide:\n" + "".join(f"    def m{i}(self): pass\n" for i in range(15))
    r = Repository.of(spark, [("wide.py", wide), ("long.py", "x\n" * 1000), *DEPS[2:]])
    found, stats = r.technical_debt()
    rows = [(x.category, x.severity, x.path) for x in found.collect()]
    assert rows == [("large_file", "high", "long.py"), ("dependency_cycle", "high", "src/a.ts"), ("broad_type", "medium", "wide.py")]
    assert stats.first()["debt_score"] == 100 - 24 - 6


def test_debt_of_spans_and_errors(spark):
    body = "def long(x):\n" + "    if x and x:\n        pass\n" * 45 + "\n"
    r = Repository.of(spark, [("a.py", body), ("b.py", "def broken(:\n"), ("c.py", "def f(): return 1\n")], syntax=True)
    found, stats = r.technical_debt()
    assert [(x.category, x.severity, x.path, x.line) for x in found.collect()] == [("high_complexity", "critical", "a.py", 1), ("parse_error", "high", "b.py", None), ("long_symbol", "medium", "a.py", 1)]
    got = stats.first()
    assert (got.debt_score, got.max_complexity, got.complex_symbol_count, got.average_complexity) == (62, 46, 1, 16.0)


def test_debt_query_has_cycles(spark):
    from codestrata.plans.queries import QUERIES
    from codestrata.plans.virtual import view

    sf = "/root/testdata/sf0.001"
    n = graphs.cycles(view(spark, sf, "rings")).count()
    assert n and QUERIES["debt_findings"](spark, sf).filter("category = 'dependency_cycle' AND severity = 'high'").count() == n


def test_dead_code(spark):
    r = Repository.of(spark, [("app.py", "from util import used\n\n\ndef start():\n    used()"), ("util.py", "def used():\n    pass\n\ndef unused_helper():\n    pass"), ("orphan.py", ""), ("tests/test_util.py", "def test_x():\n    pass")])
    got = pairs(r.dead_code(), "kind", "path")
    assert ("unused_file", "orphan.py") in got and ("unused_callable", "util.py") in got and not any("tests" in p for _, p in got)
    assert {x.symbol_name for x in r.dead_code().collect()} == {None, "unused_helper"}  # start is in an entry file


def test_layers_of_test_folders(spark):
    paths = ["test_utils/foo.py", "src/test_a.py", "Tests/a.py", "src/api.pyi/x.ts", "src/api.py", "views/x.ts", "src/TEST_a.py"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(findings.layer(F.col("p"))).collect()
    assert [r[0] for r in got] == ["source", "test", "test", "source", "api", "ui", "source"]


def test_violations(spark):
    r = Repository.of(spark, [
        ("api/routes/users.py", "from repositories.user import x"), ("repositories/user.py", "from api.routes.users import y"), ("services/billing.py", "from components.panel import z"),
        ("components/panel.py", ""), ("core/job.py", "from tests.helpers import h"), ("tests/helpers.py", ""),
    ])
    assert {x.rule_id for x in r.violations().collect()} == {"api-skips-service-layer", "persistence-depends-on-interface", "production-imports-test", "service-depends-on-ui"}


def test_knowledge_graph(spark):
    r = Repository.of(spark, [
        ("app/main.py", "from app.service import helper\n\ndef main():\n    helper()"),
        ("app/service.py", "class Base:\n    pass\nclass Service(Base):\n    def load(self):\n        return helper()\ndef helper():\n    return 1"),
    ], name="root")
    nodes, edges = r.knowledge_graph()
    ids = {x.id for x in nodes.collect()}
    assert {"repository:root", "directory:app", "file:app/main.py", "symbol:app/main.py:function:main", "symbol:app/service.py:method:Service.load"} <= ids
    got = {(x.source, x.relationship, x.target) for x in edges.collect()}
    assert {("file:app/main.py", "IMPORTS", "file:app/service.py"), ("symbol:app/main.py:function:main", "CALLS", "symbol:app/service.py:function:helper"), ("repository:root", "CONTAINS", "directory:app")} <= got
    s = knowledge.graph_stats(nodes, edges).first()
    assert s["file_count"] == 2 and s["dependency_edge_count"] == 1 and s["call_edge_count"] == 2
    assert knowledge.matched_edges(nodes, edges).count() <= edges.count()


def test_security(spark):
    r = Repository.of(spark, [
        ("app/security.py", "import hashlib\nAPI_KEY = 'super-secret-demo-key'\nx = eval(data)\ny = pickle.loads(z)\nh = hashlib.md5(b)\n"),
        ("app/db.py", "cursor.execute(f\"SELECT * FROM t WHERE id = {i}\")\n"), ("big.py", "x" * 600_000),
    ])
    found, stats = r.security_review(["app/security.py", "app/db.py", "./big.py"])
    assert {x.category for x in found.collect()} == {"hardcoded_secret", "dangerous_code_execution", "unsafe_deserialization", "weak_crypto", "dynamic_sql", "file_too_large"}
    assert stats.first()["risk_score"] == 100 and stats.first()["risk_level"] == "critical"


def test_contribution(spark):
    text = "def f(x):\n    if x == None:\n        print(x)\n    y = eval(x)\n    pickle.loads(x)\n    assert x\n    for i in x:\n        y.append(i)\n    try:\n        pass\n    except:\n        pass\n"
    found, score = Repository.of(spark, [("app.py", text)]).contributions()
    rows = found.collect()
    assert rows[0].severity == "critical" and rows[0].line == 4 and {"bug", "security", "code_smell", "performance"} == {x.kind for x in rows}
    assert score.first()["score"] < 95


def test_contribution_focus_and_docs(spark):
    r = Repository.of(spark, [("app/plain.py", "x = 1\n" * 21), ("lib/doc.py", '"""Doc."""\n' + "x = 1\n" * 21), ("lib/eval_it.py", "eval(1)\nprint(2)\n"), ("big.py", "eval(1)\n" * 70_000)])
    found, score = r.contributions()
    assert {(x.category, x.path, x.line) for x in found.collect()} == {("missing_docs", "app/plain.py", 1), ("eval_usage", "lib/eval_it.py", 1), ("debug_print", "lib/eval_it.py", 2), ("print_statement", "lib/eval_it.py", 2)}
    assert (score.first().score, score.first().security_count, score.first().missing_docs_count) == (95 - 15 - 3, 1, 1) and abs(score.first().confidence - 0.62) < 1e-9
    assert [x.path for x in r.contributions("PLAIN")[0].collect()] == ["app/plain.py"] and r.contributions("print")[0].count() == 2


def test_changed_paths(spark):
    files = spark.createDataFrame([("a/b.py",), ("c.py",), ("x/d.ts",), ("y/d.ts",)], "path string")
    names = spark.createDataFrame(list(enumerate(["./a/b.py", "/srv/a/b.py", "  ", "lib/c.py", "z/d.ts ", "./.new/q.py"])), "pos long, query string")
    got = sorted(tuple(r) for r in review.changed_paths(names, files).collect())
    assert got == [(0, "a/b.py"), (3, "c.py"), (4, "z/d.ts"), (5, "new/q.py")]


def test_reviews(spark):
    files = [("api/a.py", "import services.b\nimport repositories.r\nimport lib.c\nimport lib.d\n"), ("services/b.py", "import repositories.r"), ("repositories/r.py", ""), ("lib/c.py", ""), ("lib/d.py", "")]
    r = Repository.of(spark, files)
    got = r.pull_request_review(["api/a.py", "gone.py"], "+x\n" * 320)
    assert [(x.category, x.severity, x.path) for x in got["findings"].collect()] == [("diff_size", "high", None), ("testing", "medium", None), ("architecture:api-skips-service-layer", "medium", "api/a.py")]
    row = got["report"].first()
    assert (row.changed_file_count, row.impacted_file_count, row.finding_count, row.risk_score, row.risk_level) == (2, 6, 3, 10 + 25 + 16 + 40, "critical") and len(row.recommendations) == 4
    assert r.pull_request_review(["tests/test_a.py"])["findings"].count() == 0
    many = r.pull_request_review([f"n{i}.py" for i in range(8)])
    assert [x.category for x in many["findings"].collect()] == ["change_size", "testing"]
    arch = r.architecture_review(["api/a.py"])
    assert [(x.category, x.severity) for x in arch["findings"].collect()] == [("layer_spread", "high"), ("key_component_changed", "high"), ("high_fan_out", "medium"), ("boundary:api-skips-service-layer", "medium")]
    assert arch["report"].first().risk_score == 6 + 28 + 52 and {x.path: x.score for x in arch["impacted"].collect()}["api/a.py"] == 0.99


def test_bug_advice(spark):
    r = Repository.of(spark, [("a.py", "import b"), ("b.py", "")])
    got = r.bug_impact("boom\nValueError: bad", ["./a.py", "nowhere.py"])
    assert got["root"]["path"] == "a.py" and got["root"]["score"] == 0.5 and len(got["recommendations"]) == 3
    assert r.bug_impact("nothing")["root"] is None and r.bug_impact("nothing")["recommendations"] == []


def test_traces(spark):
    traces = [
        (1, 'File "/repo/app/services/payment.py", line 42, in charge\nPaymentError: card declined'),
        (2, "TypeError: x\n  at Checkout.submit (/repo/frontend/app/checkout.tsx:18:11)\n  at processTicksAndRejections (node:internal/process:95:5)"),
        (3, "java.lang.NullPointerException: user was null\n  at com.acme.Users.load(Users.java:10)\n  at com.acme.Main.main(Main.java:3)"),
        (4, "panic: boom\n\tmain.go:12 +0x1"), (5, "nothing"),
    ]
    got = {r.trace_id: r for r in parse.parse_traces(spark.createDataFrame(traces, "trace_id int, text string")).collect()}
    assert (got[1].language, got[1].error_type, got[1].message, len(got[1].frames)) == ("python", "PaymentError", "card declined", 1)
    f = got[2].frames[0]
    assert (got[2].language, f.file_path, f.line, f.column, f.function) == ("javascript", "/repo/frontend/app/checkout.tsx", 18, 11, "Checkout.submit")
    assert (got[3].language, got[3].error_type, got[3].message, len(got[3].files)) == ("java", "java.lang.NullPointerException", "user was null", 2)
    assert got[4].language == "go" and got[4].error_type == "panic" and got[5].language == "unknown"


def test_bug_impact(spark):
    r = Repository.of(spark, [("api/checkout.py", "from services.payment import pay"), ("services/payment.py", "from services.gateway import send"), ("services/gateway.py", "")])
    trace = 'Traceback\n  File "/srv/api/checkout.py", line 4, in go\n  File "/srv/services/payment.py", line 4, in pay\nPaymentError: card declined'
    got = r.bug_impact(trace)
    assert got["root_cause"] == "services/payment.py" and got["impacted"].count() == 3
    assert got["risk"]["score"] > 20 and got["risk"]["confidence"] > 0.5
    review = r.pull_request_review(["services/payment.py"], "+a\n-b\n+++ x\n")
    assert review["diff_lines"] == 2 and {x.path for x in review["impacted"].collect()} == {"api/checkout.py", "services/payment.py", "services/gateway.py"}
    arch = r.architecture_review(["services/payment.py"])
    assert {x.path: x.score for x in arch["impacted"].collect()}["services/payment.py"] == 0.99


def test_risk(spark):
    def risk(*args):
        return spark.range(1).select(*[c.alias(k) for k, c in impact.bug_risk(*[F.lit(a) for a in args]).items()]).first()

    high, zero = risk(4, 3, 5, 12, 0.9, 1), risk(0, 0, 0, 0, 0.0, 0)
    assert (high.score, high.level) == (75, "high") and abs(high.confidence - 0.8375) < 1e-9
    assert (zero.score, zero.level, zero.confidence) == (0, "low", 0.25)


def test_reports(spark):
    r = Repository.of(spark, [("auth.py", "class AuthService:\n    def authenticate_user(self):\n        pass"), ("main.py", "from auth import AuthService"), ("README.md", "# x"), ("pyproject.toml", "")])
    assert r.summary["stats"]["file_count"] == 4 and r.summary["stats"]["dependency_count"] == 1 and r.summary["languages"][0]["language"] == "Python"
    assert r.readme()["section_count"] == 8 and "pip install -e ." in r.readme()["markdown"] and r.architecture_document()["section_count"] == 7 and r.onboarding()["section_count"] == 8
    assert '--> n_auth_py["auth.py"]' in r.diagrams()["dependency"]
    assert r.explain("auth")["components"][0]["path"] == "auth.py"
    assert r.understanding()["high_risk"] and not any(isinstance(v, Exception) for v in r.analyze().values())
    from codestrata.operators.reports import stream

    asked = r.ask("how does the flow work?")
    assert asked["mode"] == "architecture" and [k for k, _ in stream(asked)][0] == "start"


def test_explained_tells_what_explain_tells(spark):
    r = Repository.of(spark, [
        ("auth.py", "import os\nclass AuthService:\n    def authenticate_user(self):\n        return check(self)\ndef check(x):\n    return x\ndef again():\n    return check(1)"),
        ("main.py", "from auth import AuthService\ndef run():\n    again()"), ("web/page.ts", "import React from 'react'\nexport function render() {\n  draw();\n}"), ("README.md", "# x"),
    ])
    for focus in (" ", "What does authenticate_user do?", "nothing such", "web render"):
        want = r.explain(focus)
        got = reports.explained(r.files, r.directories, r.symbols, r.dependencies, r.call_graph, r.parsed_files, r.call_nodes, focus=focus).orderBy("pos").collect()
        assert [{k: x[k] for k in ("path", "dependencies", "dependents", "role", "symbols", "evidence")} for x in got] == [{k: v for k, v in c.items() if k != "name"} for c in want["components"]]
        assert got and all(x[k] == want[k] for x in got for k in ("confidence", "overview", "dependency_flow", "call_flow", "observations", "evidence_paths"))
    assert want["call_flow"] == ["4 call sites"] and want["components"][0]["path"] == "web/page.ts"
    few = reports.explained(r.files, r.directories, r.symbols.limit(0), r.dependencies.limit(0), r.call_graph.limit(0), r.parsed_files, r.call_nodes, r.files.limit(1)).first()
    assert (few.call_flow, few.dependency_flow, few.observations, few.symbols) == (["No call was found."], ["No file imports another."], ["3 key files and 0 key symbols."], [])


def test_explained_components_reads_all_calls(spark):
    from codestrata.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    got = QUERIES["explained_components"](spark, d).collect()
    calls = spark.read.parquet(f"{d}/lineitem.parquet").count()
    assert got and {(x.confidence, x.call_flow) for x in got} == {(0.74, f"{calls} call sites")}


def test_conversations(spark, tmp_path):
    store = memory.ConversationStore(spark, str(tmp_path / "c"))
    session = store.remember("repo", "q1", "a1", '{"supporting_files": ["a.py"]}')
    store.remember("repo", "q2", "a2", session_id=session)
    rows = store.messages(session).collect()
    assert [x.role for x in rows] == ["user", "assistant"] * 2 and rows[1].metadata == '{"supporting_files": ["a.py"]}'
    with pytest.raises(ValueError):
        store.remember("other", "q", "a", session_id=session)


def test_stores(spark, tmp_path):
    folder = str(tmp_path / "s")
    for name, n in (("a", 3), ("b", 2), ("a", 1)):
        memory.replace_repository(spark.range(n), folder, name, unique=["id"])
    assert memory.read_repository(spark, folder, "a", "id").count() == 1 and memory.read_repository(spark, folder, "b").count() == 2
    with pytest.raises(ValueError, match="repeated key"):
        memory.replace_repository(spark.range(2).select(F.lit(1).alias("id")), folder, "a", unique=["id"])
    assert memory.with_fallback(lambda: 1 / 0, lambda: None) is False


def test_scan_and_graph_stores(spark, tmp_path):
    r = Repository.of(spark, [("app/main.py", "from app.service import helper\nimport os\n\ndef main():\n    helper()\n"), ("app/service.py", "def helper():\n    return 1\n")], name="root")
    folder = str(tmp_path / "s")
    for _ in range(2):
        r.save_scan(folder)
        r.save_graph(folder)
    got = stores.load_scan(spark, folder, "root")
    assert got["record"].count() == 1 and [x.path for x in got["files"].collect()] == ["app/main.py", "app/service.py"]
    nodes, edges = stores.load_graph(spark, folder, "root")
    assert nodes.count() == r.knowledge_graph()[0].count() and edges.count() == r.knowledge_graph()[1].count()
    assert [x.path for x in got["directories"].collect()] == ["app"]
    flat = Repository.of(spark, [("x.py", "")], name="root")
    flat.save_scan(folder)
    got = stores.load_scan(spark, folder, "root")
    assert got["directories"].count() == 0 and [x.path for x in got["files"].collect()] == ["x.py"]
    with pytest.raises(KeyError):
        stores.load_scan(spark, folder, "other")
    bad = nodes.withColumn("labels", F.array(F.lit("no good")))
    with pytest.raises(Exception, match="bad label"):
        stores.identifiers_only(bad, edges)[0].collect()
    odd = spark.createDataFrame([("Größe_1",), ("名",), ("²",), ("__",), ("",), ("a-b",), ("x\n",)], "label string").select(F.col("label").alias("id"), F.array("label").alias("labels"))
    for row in odd.collect():
        one = stores.identifiers_only(odd.filter(F.col("id") == row.id), edges)[0]
        if row.id.replace("_", "").isalnum():
            assert one.first().labels == [row.id]
        else:
            with pytest.raises(Exception, match="bad label"):
                one.collect()
    more = edges.select("source", "relationship", "target").union(spark.createDataFrame([("file:x", "IMPORTS", "file:y")], "source string, relationship string, target string"))
    assert stores.whole_graph(nodes, more).count() == nodes.count() + 2
    assert stores.write_both(lambda: True, lambda: False, lambda: {"nodes": 1}) == {"nodes": 1, "persisted": False}
    memory.replace_repository(spark.createDataFrame([("i", "p", 1)], "id string, path string, start_line int"), str(tmp_path / "v"), "old")
    assert stores.load_vectors(spark, str(tmp_path / "v"), "old").first()["content"] == ""


def test_large_archives_raise(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.py", "x" * 500)
    monkeypatch.setattr(R, "MAX_ARCHIVE", 10)
    with pytest.raises(Exception, match="archive too large"):
        R.read_zip(spark, str(tmp_path)).collect()


def test_degradation(spark, monkeypatch):
    r = Repository.of(spark, [("auth.py", "def check_token():\n    return 1\n"), ("b.py", "import auth\n")])

    def broken(*_):
        raise RuntimeError("no graph")

    monkeypatch.setattr(graphs, "dependency_edges", broken)
    assert r.retrieve("token", 2).first()["graph_score"] in (0.0, 1.0) and r.summary["stats"]["dependency_count"] == 0 and r.summary["stats"]["file_count"] == 2
    assert isinstance(r.analyze()["dependency_stats"], RuntimeError)
    with pytest.raises(ValueError, match="no embedder"):
        Repository.of(spark, [("a.py", "x = 1")], embedder=None).retrieve("x")


def test_components_before_cycles(spark):
    rng = __import__("random").Random(3)
    for _ in range(3):
        pairs_ = {(f"n{rng.randrange(14):02d}", f"n{rng.randrange(14):02d}") for _ in range(22)}
        pairs_ = {(a, b) for a, b in pairs_ if a != b}
        reach = {a: {a} for p in pairs_ for a in p}
        for _ in range(14):
            for a, b in pairs_:
                reach[a] |= reach[b]
        want = {(a, b) for a, b in pairs_ if a in reach[b]}
        got = graphs.on_cycles(spark.createDataFrame(sorted(pairs_), "source string, target string")).collect()
        df = spark.createDataFrame(sorted(pairs_), "source string, target string")
        assert sorted(r.files for r in graphs.cycles(df, many=0).collect()) == sorted(r.files for r in graphs.cycles(df, many=1e9).collect())
        assert {(r.source, r.target) for r in got} == want and all((r.component in reach[r.source]) and (r.source in reach[r.component]) for r in got)


def test_imports(spark, tmp_path):
    import subprocess

    from codestrata.sources.imports import Importer, ImportFailed

    work = tmp_path / "my work"
    work.mkdir()
    (work / "a.py").write_text("x = 1\n")
    for args in (("init", "-q"), ("add", "."), ("-c", "user.name=n", "-c", "user.email=e@x", "commit", "-q", "-m", "m")):
        subprocess.run(["git", "-C", str(work), *args], check=True)
    imports = Importer(spark, str(tmp_path / "store"))
    import_id, folder = imports.from_local(str(work))
    assert os.path.basename(folder).startswith("my-work-") and (tmp_path / folder / "a.py").exists()
    got = imports.progress(import_id)
    assert got["status"] == "completed" and [e[0] for e in got["events"]] == ["queued", "validating", "cloning", "completed"]
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("b/__init__.py", "y = 2\n")
    _, folder = imports.from_zip("Up.zip", raw.getvalue())
    assert [r.path for r in R.scan(spark, folder).filter("NOT is_dir").collect()] == ["b/__init__.py"]
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("../evil.py", "")
    with pytest.raises(ImportFailed, match="unsafe") as failed:
        imports.from_zip("bad.zip", raw.getvalue())
    assert imports.progress(failed.value.import_id)["status"] == "failed" and len(os.listdir(tmp_path / "store" / "repositories")) == 2
    for call in (lambda: imports.from_zip("x.tar", b""), lambda: imports.from_zip("x.zip", b"no"), lambda: imports.from_local(str(tmp_path / "none")), lambda: imports.from_local("/"),
                 lambda: imports.from_github("http://github.com/a/b"), lambda: Importer(spark, str(tmp_path / "store"), max_archive=1).from_zip("x.zip", b"no")):
        with pytest.raises(ImportFailed):
            call()
    with pytest.raises(KeyError):
        imports.progress("nothing")


def test_clients():
    import json

    from codestrata.sources import clients as C

    sent = []

    def post(answers):
        def run(address, body, headers):
            sent.append((address, body, headers))
            return iter(answers.pop(0))

        return run

    embed = C.openai_embedder("k", post=post([['{"data": [{"embedding": [1, 2]}]}'], ['{"data": []}'], ["oops"]]))
    assert embed(["a"]) == [[1.0, 2.0]] and sent[-1][2] == {"Authorization": "Bearer k"}
    for _ in range(2):
        with pytest.raises(C.ClientError):
            embed(["a"])
    local = C.ollama_embedder("http://h/", post=post([['{"embeddings": [[1], [2]]}'], ["{}"], ['{"embedding": [3]}'], ['{"embedding": [4]}'], ["{}"], ["{}"]]))
    assert local([]) == [] and local(["a", "b"]) == [[1.0], [2.0]] and local(["a", "b"]) == [[3.0], [4.0]] and sent[-1][0] == "http://h/api/embeddings"
    with pytest.raises(C.ClientError):
        local(["a"])
    chat = C.Ollama(post=post([['{"message": {"content": "hi"}}'], ['{"message": {"content": "h"}}', "", "bad", '{"message": {"content": "i"}}', '{"done": true}']]))
    assert chat("q") == "hi" and list(chat.stream("q")) == ["h", "i"] and sent[-1][1]["stream"] is True
    part = lambda t: "data: " + json.dumps({"choices": [{"delta": {"content": t}}]})
    groq = C.Groq("k", post=post([['{"choices": [{"message": {"content": "yes"}}]}'], [part("a"), ": ping", part("b"), "data: [DONE]", part("c")]]))
    assert groq("q") == "yes" and list(groq.stream("q")) == ["a", "b"]
    assert isinstance(C.answerer("groq"), C.Nothing) and isinstance(C.answerer("groq", key="k"), C.Groq) and isinstance(C.answerer(), C.Ollama) and C.Nothing()("x") == "" and not list(C.Nothing().stream("x"))
    with pytest.raises(C.ClientError):
        list(C.http_post("http://127.0.0.1:9/x", {}, {}, timeout=2))
    said = reports.stream({"mode": "m", "answer": "a b"}, iter(["x", "y"]))
    assert [v for k, v in said if k == "delta"] == ["x", "y"] and [v for k, v in reports.stream({"mode": "m", "answer": "a b"}, iter(())) if k == "delta"] == ["a ", "b "]


def test_event_stream(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('i', 'queued', '', timestamp'2024-01-01 00:00:00'), ('i', 'completed', '', timestamp'2024-01-01 00:01:00') AS v(import_id, stage, message, created_at)")
    rows.write.parquet(str(tmp_path / "in"))
    q = progress.latest_stage(progress.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.table("latest").first()["status"] == "completed"
    assert progress.stages_by_window(rows).count() == 2 and memory.latest_events(rows).first()["status"] == "completed"


def test_severity_order(spark):
    df = spark.createDataFrame([("low",), ("critical",), ("high",), ("medium",)], "s string")
    assert [r.s for r in df.orderBy(findings.rank(F.col("s"))).collect()] == ["critical", "high", "medium", "low"]


def test_entry_without_corpus_operators(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() == 10


def test_architecture_risk_is_capped(spark):
    from codestrata.operators import impact

    n = lambda k: F.lit(k)
    rows = spark.range(1).select(impact.arch_risk(n(9), n(40), n(500)).alias("most"), impact.arch_risk(n(1), n(1), n(4)).alias("little")).first()
    assert (rows.most, rows.little) == (100, 10)


def test_frames_of_odd_paths(spark):
    from codestrata.operators import parse

    text = "\n".join(f'  File "{p}", line 3, in go ' for p in ("./src//a.ts", " src/b.ts ", "webpack://x/./a.ts", "C:\\a\\b.py", "//net/a.py", "///a.py", ".", "../a/../b.py"))
    rows = spark.createDataFrame([(1, text), (2, "nothing"), (3, "")], "trace_id long, text string")
    got = {r.trace_id: r for r in parse.parse_traces(rows).collect()}
    assert got[1].files == ["src/a.ts", "src/b.ts", "webpack://x/./a.ts", "C:\\a\\b.py", "//net/a.py", "/a.py", ".", "../a/../b.py"]
    assert {f.function for f in got[1].frames} == {"go"} and got[1].language == "python" and got[2].language == "unknown"


def test_contribution_matches_equal_python(spark):
    """Marks in texts count the matches that Python finds, at their lines."""
    import random
    import re

    rng = random.Random(4)
    parts = ["eval(", "eval\n(", "except:", "except :\n", " pass\n", "pass  \n\n", "assert\n\n", "assert x", "global\u00a0x", "\u00e9print (", "print(", "yaml.load(a)", "yaml.load(a, Loader=b)\n", "for x in y:\n  z.append(", "class A:\n  pass\n",
             "def f() -> int:\n\n  pass", "\r\n", "\x1c", "\u2028", " ", "# type: ignore", "\n", "\ue000", "TODOTODO", "import *", "+= '", "in a and b in c", "None == None", "except ValueError: pass", "\x0b"]
    rows = [(f"a{i}.ts", "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(300)] + [("none.ts", None), ("empty.py", "")]
    want = []
    for path, text in rows:
        lines = (text or "").splitlines()
        for k, (kind, category, severity, pattern, flags) in enumerate(findings.PATTERNS):
            for m in re.finditer(pattern, text or "", flags):
                at = text.count("\n", 0, m.start()) + 1
                want.append((kind, category, severity, path, at, (lines[at - 1].strip() if at <= len(lines) else "")[:200].replace("\ue000", ""), k))
    files = spark.createDataFrame(rows, "path string, text string").withColumn("size_bytes", F.lit(1))
    got = findings.contribution_findings(files)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString().replace("PythonSQL", "")
    assert sorted((r[0], r[1], r[2], r[3], r[4], r[5].replace("\ue000", ""), r[6]) for r in got.collect()) == sorted(want) and len({x[1] for x in want}) > 15


def test_scan_deals_a_deep_folder_evenly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "MIN_PART", 1)
    deep = tmp_path / "src" / "a" / "b"
    deep.mkdir(parents=True)
    for i in range(80):
        (deep / f"f{i:02}.py").write_text("x" * 10_000)
    parts = R._Reader(str(tmp_path), frozenset(R.IGNORED), 8).partitions()
    assert len(parts) in (8, 9) and max(len(p.names) for p in parts) <= 12
    got = {(r.path, r.is_dir) for r in R.scan(spark, str(tmp_path), 8).select("path", "is_dir").collect()}
    assert got == {("src", True), ("src/a", True), ("src/a/b", True), *[(f"src/a/b/f{i:02}.py", False) for i in range(80)]}


def test_archive_is_read_by_several_tasks(spark, tmp_path, monkeypatch):
    name = str(tmp_path / "one.zip")
    with zipfile.ZipFile(name, "w") as z:
        for i in range(40):
            z.writestr(f"d/{i}.txt", "y" * 20_000)
    monkeypatch.setattr(R, "MIN_PART", 1)
    assert len(R._ArchiveReader(name, 4, 1 << 30, 1 << 30).partitions()) == 4
    rows = R.read_zip(spark, name).collect()
    assert {r.path for r in rows} == {f"d/{i}.txt" for i in range(40)} and {len(r.content) for r in rows} == {20_000}
    with pytest.raises(Exception, match="unpacked"):
        R.read_zip(spark, name, max_unpacked=100).collect()
    bad = str(tmp_path / "bad.zip")
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("ok.txt", "1")
        z.writestr("../up.txt", "2")
    with pytest.raises(Exception, match="unsafe"):
        R.read_zip(spark, bad).collect()


def slow_cycles(edges):
    after, out = {}, set()
    for s, t in edges:
        if s != t:
            after.setdefault(s, set()).add(t)

    def go(path):
        for x in after.get(path[-1], ()):
            if x == path[0]:
                out.add(tuple(path))
            elif x > path[0] and x not in path:
                go([*path, x])

    for s in after:
        go([s])
    return sorted(out)


def test_cycles_of_dense_components(spark, monkeypatch):
    import random

    rng = random.Random(6)
    edges = [(f"{c}{i}", f"{c}{j}") for c in "abc" for i in range(7) for j in range(7) if rng.random() < 0.55] + [("a0", "b0"), ("b1", "x"), ("x", "y")]
    monkeypatch.setattr(graphs, "CYCLE_ROWS", 3)
    df = spark.createDataFrame(edges, "source string, target string")
    want = slow_cycles(edges)
    assert sorted(tuple(r.files) for r in graphs.cycles(df, many=0.5).collect()) == want and len(want) > 200
    assert sorted(tuple(r.files) for r in graphs.cycles(df, 3, many=0.5).collect()) == [c for c in want if len(c) <= 3]
    ring = [(f"f{i:02}", f"f{(i + 1) % 40:02}") for i in range(40)]
    assert [r.files for r in graphs.cycles(spark.createDataFrame(ring, "source string, target string")).collect()] == [[s for s, _ in ring]]


def test_dead_paths_are_not_walked():
    """A million paths lead from b through ten layers of four files back to b alone."""
    layers = [[f"l{k}_{i}" for i in range(4)] for k in range(10)]
    after = {"a": ["b"], "b": ["a", *layers[0]], "c": ["b"], **{x: [*nxt] for now, nxt in zip(layers, [*layers[1:], ["c"]]) for x in now}}
    steps = [0]
    assert list(graphs.circuits("a", after, steps)) == [["a", "b"]] and steps[0] < 400
    assert graphs.component_of("b", after, {y: [x for x in after if y in after[x]] for y in after}) == set(after) - {"a"}


def test_a_version_is_committed_at_once(spark, tmp_path, monkeypatch):
    from codestrata.operators import snapshots

    files = lambda *paths: R.from_rows(spark, [(p, f"text of {p}") for p in paths])
    folder = str(tmp_path / "s")
    one, two = files("a/x.py", "b.py"), files("a/x.py", "c.py", "d/e.py")
    assert stores.save_scan(one, R.directories(one), folder, "r") == 1 and stores.save_scan(two, R.directories(two), folder, "other") == 1
    before = {r.path: r.id for r in stores.load_scan(spark, folder, "r")["files"].collect()}
    stage, seen = snapshots.Snapshots.stage, []

    def stops(self, repository, name, table):
        seen.append(name)
        if name == "files":
            raise OSError("lost")
        return stage(self, repository, name, table)

    with monkeypatch.context() as m:
        m.setattr(snapshots.Snapshots, "stage", stops)
        with pytest.raises(OSError):
            stores.save_scan(two, R.directories(two), folder, "r")
    assert seen == ["record", "directories", "files"]
    got = stores.load_scan(spark, folder, "r")  # the former state, whole
    assert {r.path: r.id for r in got["files"].collect()} == before and [r.path for r in got["directories"].collect()] == ["a"]
    assert [stores.save_scan(two, R.directories(two), folder, "r") for _ in range(3)] == [2, 3, 4]
    got = stores.load_scan(spark, folder, "r")
    after = {r.path: r.id for r in got["files"].collect()}
    assert after["a/x.py"] == before["a/x.py"] and len(set(after.values())) == 3 and "b.py" not in after and set(after.values()) & {before["b.py"]} == set()
    assert [r.path for r in got["directories"].collect()] == ["a", "d"] and got["record"].first().id == 1 and stores.load_scan(spark, folder, "other")["record"].first().id == 2
    store = snapshots.Snapshots(spark, f"{folder}/scans")
    assert len(store._names(f"{store.home('r')}/versions")) == 2
    with pytest.raises(snapshots.Conflict):
        store.commit("r", {}, {"version": 3})


def test_index_follows_changes(spark, tmp_path, monkeypatch):
    from codestrata.operators import snapshots

    texts, folder = {f"m{i}.py": f"def f{i}():\n    return {i}\n" for i in range(20)}, str(tmp_path / "i")

    def index():
        r = Repository.of(spark, sorted(texts.items()))
        out = r.index(folder)
        r.close()
        return out

    assert index() == {"version": 1, "files": 20, "changed": 20, "gone": 0}
    texts["m3.py"] += "x = f3()\n"
    texts["new.py"] = "y = 1\n"
    del texts["m5.py"]
    assert index() == {"version": 2, "files": 20, "changed": 2, "gone": 1}
    assert index() == {"version": 3, "files": 20, "changed": 0, "gone": 0}
    monkeypatch.setattr(snapshots, "MOST_SEGMENTS", 2)
    texts["m4.py"] += "z = 1\n"
    assert index()["changed"] == 1
    store = snapshots.Snapshots(spark, folder)
    assert len(store.manifest("repository")["tables"]["vectors"]) == 1
    parsed = {r.path: r.segment for r in snapshots.live(store, "repository", "parsed").collect()}
    assert parsed == {p: 4 if p == "m4.py" else 2 if p in ("m3.py", "new.py") else 1 for p in texts}
    whole = snapshots.live(store, "repository", "vectors").filter("symbol_name IS NULL")
    assert {r.path: r.content for r in whole.collect()} == texts
