"""Rule-based findings: security, contribution, technical debt, dead code and layer violations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def rank(severity: Column) -> Column:
    out = None
    for s, k in SEVERITY_RANK.items():
        out = F.when(severity == s, k) if out is None else out.when(severity == s, k)
    return out


def _any(text: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


# --- security: rules over lines, one pass, several findings a line

MAX_REVIEWED_BYTES = 512_000
MAX_SECURITY_FINDINGS = 40


# What a line of each rule must hold, in lower case; and without spaces.
SECURITY_HINTS = (
    "private key", "key", "token", "password", "secret", "eval(", "exec(", "system(", "new function(", "shell=true", "pickle.load", "objectinputstream", "yaml.load(",
    "md5(", "sha1(", "createhash(", "des.new", "access-control-allow-origin", "execute(", "gets(", "strcpy(", "strcat(", "sprintf(",
)
TIGHT_HINTS = ("verify=false", "rejectunauthorized:false", "debug=true", 'allow_origins=["*"]')


def security_rules(line: Column, low: Column, tight: Column) -> list[tuple[str, str, Column]]:
    """(category, severity, condition) on a stripped line, its lower case, and that without spaces.  Fixed values."""
    return [
        ("hardcoded_private_key", "critical", F.rlike(line, F.lit("-----BEGIN [A-Z ]*PRIVATE KEY-----"))),
        ("hardcoded_secret", "high", F.rlike(line, F.lit(r"(?i)\b(api[_-]?key|auth[_-]?token|password|private[_-]?key|secret|token)\b")) & F.rlike(line, F.lit("[:=]\\s*['\"][^'\"]{8,}['\"]"))),
        ("dangerous_code_execution", "high", _any(line, "eval(", "exec(", "child_process.exec", "system(") | _any(low, "new function(", "shell=true", "runtime.getruntime().exec")),
        ("unsafe_deserialization", "high", _any(low, "pickle.load", "objectinputstream") | (_any(low, "yaml.load(") & ~_any(low, "safeloader"))),
        ("weak_crypto", "medium", _any(low, "md5(", "sha1(", "createhash('md5'", 'createhash("md5"', "des.new")),
        ("security_controls_disabled", "high", _any(tight, *TIGHT_HINTS) | (_any(low, "access-control-allow-origin") & _any(line, "*"))),
        ("dynamic_sql", "high", _any(low, "execute(") & F.rlike(line, F.lit(r"(?i)\b(SELECT|INSERT|UPDATE|DELETE)\b")) & _any(line, "f'", 'f"', "+", "%", ".format(")),
        ("unsafe_memory_api", "high", _any(line, "gets(", "strcpy(", "strcat(", "sprintf(")),
    ]


def _hinted(text: Column) -> Column:
    """Whether some rule may fit a line of the text."""
    low = F.lower(text)
    return _any(low, *SECURITY_HINTS, "child_process.exec", "runtime.getruntime().exec") | _any(F.replace(low, F.lit(" "), F.lit("")), *TIGHT_HINTS)


def security_findings(files: DataFrame) -> DataFrame:
    """category, severity, path, line, evidence for (path, text, size_bytes).

    Texts without any hint are not cut into lines, and lines without one meet no rule.
    """
    large = files.filter(F.col("size_bytes") > MAX_REVIEWED_BYTES).select(
        F.lit("file_too_large").alias("category"), F.lit("low").alias("severity"), "path", F.lit(1).alias("line"), F.lit("").alias("evidence"), F.lit(8).alias("rule_ord"))
    rows = files.filter((F.col("size_bytes") <= MAX_REVIEWED_BYTES) & _hinted(F.col("text")))
    lines_ = F.filter(F.transform(X.lines(F.col("text")), lambda x, k: F.struct((k + 1).alias("line"), x.alias("raw"))), lambda x: _hinted(x["raw"]))
    rows = rows.select("path", F.explode(lines_).alias("x")).select("path", "x.line", X.strip(F.col("x.raw")).alias("evidence"))
    low = F.lower("evidence")
    rows = rows.withColumns({"low": low, "tight": F.replace(low, F.lit(" "), F.lit(""))})
    hits = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(k).alias("rule_ord")))
        for k, (c, s, cond) in enumerate(security_rules(F.col("evidence"), F.col("low"), F.col("tight")))
    ]))
    rows = rows.select("path", "line", F.substring("evidence", 1, 160).alias("evidence"), F.explode(hits).alias("x"))
    return rows.select("x.category", "x.severity", "path", "line", "evidence", "x.rule_ord").unionByName(large)


def top_findings(findings: DataFrame, limit: int = MAX_SECURITY_FINDINGS) -> DataFrame:
    """The report's list: the most severe first, then by path, line and rule."""
    return findings.orderBy(rank(F.col("severity")), "path", F.coalesce("line", F.lit(0)), "rule_ord").limit(limit)


def severity_counts(findings: DataFrame) -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_RANK]


def security_level(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 55, "high").when(score >= 25, "medium").otherwise("low")


def security_stats(findings: DataFrame) -> DataFrame:
    """Counts, risk score and level over the listed findings."""
    out = findings.agg(F.count("*").alias("finding_count"), *severity_counts(findings))
    score = F.least(F.col("low") * 3 + F.col("medium") * 10 + F.col("high") * 24 + F.col("critical") * 45, F.lit(100))
    return out.withColumn("risk_score", score).withColumn("risk_level", security_level(F.col("risk_score")))


# --- contribution: patterns over whole files, which need offsets

# Patterns by kind, category and severity.
PATTERNS = (
    ("bug", "bare_except", "high", r"\bexcept\s*:\s*$", re.M),
    ("bug", "broad_except", "medium", r"except Exception\b", 0),
    ("bug", "todo_marker", "low", r"TODO|FIXME|HACK|XXX|BUG", 0),
    ("bug", "redundant_check", "low", r"\.has_key\(|in\s+\w+\s+and\s+\w+\s+in\s+\w+", 0),
    ("bug", "none_comparison", "low", r"==\s*None|None\s*==", 0),
    ("bug", "debug_print", "low", r"\bprint\s*\(", 0),
    ("bug", "empty_block", "medium", r"pass\s*$", re.M),
    ("bug", "global_usage", "medium", r"\bglobal\s+\w+", 0),
    ("bug", "swallowed_error", "high", r"except\s+\w+Error\s*:\s*pass", 0),
    ("security", "eval_usage", "critical", r"eval\s*\(", 0),
    ("security", "exec_usage", "critical", r"exec\s*\(", 0),
    ("security", "shell_true", "high", r"shell\s*=\s*True", 0),
    ("security", "shell_command", "high", r"subprocess\.call|os\.system|os\.popen", 0),
    ("security", "pickle_deserialize", "high", r"pickle\.loads?\s*\(", 0),
    ("security", "unsafe_yaml", "high", r"yaml\.load\s*\((?!.*Loader)", 0),
    ("security", "assert_in_code", "medium", r"assert\s+", 0),
    ("security", "ssl_disabled", "critical", r"\bverify\s*=\s*False|VERIFY_NONE", 0),
    ("code_smell", "empty_function", "low", r"def\s+\w+\(.*\)\s*->\s*\w+.*:\s*\n\s+pass", re.M),
    ("code_smell", "empty_class", "low", r"class\s+\w+.*:\s*\n\s+pass\s*$", re.M),
    ("code_smell", "swallowed_exception", "low", r"except\s+\w+.*:\s*\n\s+pass", re.M),
    ("code_smell", "print_statement", "low", r"\bprint\s*\(", 0),
    ("code_smell", "type_ignore", "low", r"^\s*#\s*type:\s*ignore", re.M),
    ("code_smell", "redundant_encoding", "low", r"\.encode\(['\"]utf-8['\"]\)", re.M),
    ("performance", "append_in_loop", "medium", r"for\s+\w+\s+in\s+.*:\s*\n\s+.*\.append\(", re.M),
    ("performance", "string_concat_loop", "medium", r"\+\=\s*['\"]|['\"]\s*\+=", 0),
    ("performance", "wildcard_import", "medium", r"import\s+\*", 0),
)
MAX_CONTRIBUTIONS, MAX_SCANNED_BYTES = 50, 512_000
KINDS = ("bug", "security", "code_smell", "missing_test", "missing_docs", "performance")


# What a match of each pattern holds, in the order of the patterns.
NEEDED = (
    ("except",), ("except Exception",), ("TODO", "FIXME", "HACK", "XXX", "BUG"), ("has_key", "in"), ("None",), ("print",), ("pass",), ("global",), ("except",), ("eval",), ("exec",), ("shell",),
    ("subprocess.call", "os.system", "os.popen"), ("pickle.load",), ("yaml.load",), ("assert",), ("verify", "VERIFY_NONE"), ("pass",), ("pass",), ("pass",), ("print",), ("ignore",), (".encode(",), (".append(",), ("+=",), ("import",),
)
#: Begins each match while lines are counted; a text that holds it has its neighbour instead.
MARK, OTHER = "\ue000", "\ue001"


def java_pattern(pattern: str, flags: int = 0) -> str:
    """A pattern of this module for Spark: line ends are \\n alone, words and white space are those of Unicode."""
    word, space = r"[\p{L}\p{N}_]", r"[\s\x1c-\x1f]"
    if pattern.startswith(r"\b"):
        pattern = rf"(?<!{word})" + pattern[2:]
    pattern = pattern.replace(r"\b", rf"(?!{word})").replace(r"\w", word).replace(r"\s", space)
    return ("(?dUm)" if flags & re.M else "(?dU)") + pattern


def read_files(files: DataFrame) -> DataFrame:
    """The files whose texts are searched."""
    return files.filter(F.col("text").isNotNull() & (F.col("size_bytes") <= MAX_SCANNED_BYTES))


def contribution_findings(files: DataFrame) -> DataFrame:
    """kind, category, severity, path, line, evidence, rule_ord of each match in (path, text), and Python files of over 20 lines without a docstring.

    A pattern marks the beginnings of its matches, and the marks of each line are counted: one
    projection, in time linear in the text.  A text without what every match of a pattern
    holds is not searched for it, and a text that holds nothing of any is not cut into lines.
    """
    text = F.replace(F.col("text"), F.lit(MARK), F.lit(OTHER))
    rows = read_files(files).select("path", text.alias("text"), X.lines(F.col("text")).alias("lines"))
    found = []
    for k, ((kind, category, severity, pattern, flags), needed) in enumerate(zip(PATTERNS, NEEDED)):
        marked = F.split(F.regexp_replace("text", java_pattern(pattern, flags), MARK + "$0"), "\n", -1)
        hits = F.filter(F.transform(marked, lambda x, i: F.struct((i + 1).alias("line"), X.count_of(x, MARK).alias("n"))), lambda h: h["n"] > 0)
        tell = lambda h: F.struct(
            F.lit(kind).alias("kind"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), h["line"].alias("line"), h["n"].alias("n"), F.lit(k).alias("rule_ord"))  # noqa: B023
        found.append(F.when(_any(F.col("text"), *needed), F.transform(hits, tell)))
    none = F.struct(*[F.lit("missing_docs").alias(c) for c in ("kind", "category")], F.lit("low").alias("severity"), F.lit(0).alias("line"), F.lit(1).alias("n"), F.lit(len(PATTERNS)).alias("rule_ord"))
    bare = F.endswith(F.lower("path"), F.lit(".py")) & (F.size("lines") > 20) & ~_any(F.col("text"), '"""', "'''")
    found.append(F.when(bare, F.array(none)))
    rows = rows.select("path", "lines", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("x"))
    rows = rows.select("path", "x.*", F.coalesce(F.substring(X.strip(F.get("lines", F.col("x.line") - 1)), 1, 200), F.lit("")).alias("evidence"))
    rows = rows.withColumn("again", F.explode(F.sequence(F.lit(1), "n")))
    return rows.select("kind", "category", "severity", "path", F.greatest("line", F.lit(1)).alias("line"), "evidence", "rule_ord")


def contribution_title(category: Column) -> Column:
    return F.replace(category, F.lit("_"), F.lit(" "))


def focused(findings: DataFrame, focus: str | None) -> DataFrame:
    """Findings whose path or title holds a text, in any case."""
    if not focus:
        return findings
    part = F.lit(focus.lower())
    return findings.filter(F.contains(F.lower("path"), part) | F.contains(contribution_title(F.col("category")), part))


def first_contributions(findings: DataFrame, limit: int = MAX_CONTRIBUTIONS) -> DataFrame:
    return findings.orderBy(rank(F.col("severity")), "path", "line", "rule_ord").limit(limit)


def contribution_score(findings: DataFrame, scanned: Column | None = None) -> DataFrame:
    """Counts by severity and kind, score, and confidence by the number of files read, over the listed findings."""
    out = findings.agg(F.count("*").alias("finding_count"), *severity_counts(findings), *[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in KINDS])
    lost = F.col("critical") * 15 + F.col("high") * 8 + F.col("medium") * 3 + F.col("low")
    scanned = F.lit(0) if scanned is None else scanned
    return out.withColumns({
        "score": F.when(F.col("finding_count") == 0, 95).otherwise(F.greatest(F.lit(5), F.least(F.lit(95), 95 - lost))).cast("int"),
        "confidence": F.least(F.lit(0.92), 0.5 + F.least(scanned, F.lit(10)) * 0.04),
    })


# --- technical debt

# Branches of the complexity count.
BRANCHES = (" if ", " elif ", " else if ", " for ", " while ", " case ", " catch ", " except ", "&&", "||", "?")


def complexity(body: Column) -> Column:
    low = F.lower(body)
    out = F.lit(1)
    for token in BRANCHES:
        out = out + X.count_of(low, token)
    return out


def _debt(category: str, severity, path="path", line=None, ord_: int = 0) -> list[Column]:
    return [
        F.lit(category).alias("category"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.col(path).alias("path"),
        (F.col(line) if line else F.lit(None)).cast("int").alias("line"), F.lit(ord_).alias("rule_ord"),
    ]


def large_files(files: DataFrame) -> DataFrame:
    rows = files.withColumn("n_lines", F.size(X.lines(F.coalesce("text", F.lit(""))))).filter("n_lines >= 500")
    return rows.select(*_debt("large_file", F.when(F.col("n_lines") >= 1000, "high").otherwise("medium")))


def callables(symbols: DataFrame) -> DataFrame:
    return symbols.filter(F.col("kind").isin("function", "method")).withColumn("n", F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(1)))


def complexities(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, score) of each function and method; the lines of a file are cut once."""
    spans = callables(symbols).groupBy("path").agg(F.collect_list(F.struct("line", "n")).alias("spans"))
    body = spans.join(files.select("path", X.lines(F.col("text")).alias("lines")), "path")
    score = F.transform("spans", lambda s: F.struct(s["line"].alias("line"), complexity(F.array_join(F.slice("lines", s["line"], s["n"]), "\n")).alias("score")))
    return body.select("path", F.explode(score).alias("x")).select("path", "x.line", "x.score")


def debt_findings(files: DataFrame, symbols: DataFrame, edges: DataFrame, cycles: DataFrame, errors: DataFrame | None = None, scored: DataFrame | None = None) -> DataFrame:
    """Findings of (path, text) files, symbols, dependency edges, cycles and files that could not be parsed (path)."""
    long_ = callables(symbols).filter("n >= 80").select(*_debt("long_symbol", F.when(F.col("n") >= 160, "high").otherwise("medium"), line="line", ord_=1))
    scored = scored if scored is not None else complexities(files, symbols)
    complex_ = scored.filter("score >= 10").select(*_debt("high_complexity", F.when(F.col("score") >= 20, "critical").otherwise("high"), line="line", ord_=2))
    methods = symbols.filter("kind = 'method'").groupBy("path", F.col("parent").alias("name")).agg(F.count("*").alias("n")).filter("n >= 15")
    broad = symbols.filter(F.col("kind").isin("class", "interface")).join(methods, ["path", "name"]).select(*_debt("broad_type", "medium", line="line", ord_=3))
    busy = edges.filter(F.col("target").isNotNull()).groupBy("source").agg(F.count("*").alias("n")).filter("n >= 8").select(*_debt("high_fan_out", "medium", path="source", ord_=4))
    loops = cycles.select(F.col("files")[0].alias("path")).select(*_debt("dependency_cycle", "high", ord_=5))
    out = large_files(files)
    if errors is not None:
        out = out.unionByName(errors.select(*_debt("parse_error", "high", ord_=0)))
    for more in (long_, complex_, broad, busy, loops):
        out = out.unionByName(more)
    return out


def debt_stats(findings: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """Counts and score, and with complexities their average, maximum and number from 10 on."""
    out = findings.agg(F.count("*").alias("finding_count"), *severity_counts(findings))
    lost = F.col("critical") * 20 + F.col("high") * 12 + F.col("medium") * 6 + F.col("low") * 2
    out = out.withColumn("debt_score", F.greatest(F.lit(0), 100 - lost))
    if scored is None:
        return out
    return out.crossJoin(scored.agg(  # one-row tables
        F.coalesce(F.round(F.avg("score"), 2), F.lit(0.0)).alias("average_complexity"), F.coalesce(F.max("score"), F.lit(0)).alias("max_complexity"),
        F.count_if(F.col("score") >= 10).alias("complex_symbol_count"),
    ))


# --- dead code

# Names that are entered from outside, and parts of test paths.
ENTRY_STEMS = ("__init__", "app", "index", "main", "manage", "mod", "server")
ENTRY_SYMBOLS = ("main", "handler", "render")
TEST_PARTS = ("__tests__", "spec", "test", "tests")


def exempt(path: Column) -> Column:
    stem = X.stem(path)
    return (stem.isin(*ENTRY_STEMS) | F.arrays_overlap(F.transform(X.parts(path), F.lower), F.array(*[F.lit(p) for p in TEST_PARTS]))
            | F.startswith(stem, F.lit("test_")) | F.endswith(stem, F.lit(".test")) | F.endswith(stem, F.lit(".spec")))


def dead_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.filter(F.col("target").isNotNull()).select(F.col("target").alias("path"))
    out = files.select("path").join(used, "path", "left_anti").filter(~exempt(F.col("path")))
    return out.select(F.lit("unused_file").alias("kind"), "path", F.lit(0.68).alias("confidence"))


def dead_callables(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    called = calls.filter(F.col("target").isNotNull()).select(F.col("target").alias("id"))
    out = nodes.join(called, "id", "left_anti").filter(~exempt(F.col("path")) & ~F.startswith("name", F.lit("_")) & ~F.col("name").isin(*ENTRY_SYMBOLS))
    return out.select(F.lit("unused_callable").alias("kind"), "path", "line", F.col("name").alias("symbol_name"), F.when(F.col("kind") == "method", 0.62).otherwise(0.72).alias("confidence"))


def dead_stats(files: DataFrame, nodes: DataFrame, dead: DataFrame) -> DataFrame:
    """Counts of files, callables and findings."""
    return files.agg(F.count("*").alias("file_count")).crossJoin(nodes.agg(F.count("*").alias("callable_count"))).crossJoin(dead.agg(  # one-row tables
        F.count("*").alias("finding_count"), F.count_if(F.col("kind") == "unused_file").alias("unused_file_count"), F.count_if(F.col("kind") == "unused_callable").alias("unused_callable_count"),
    ))


# --- layers

# Parts of paths by layer.
LAYERS = {
    "test": ("__tests__", "spec", "test", "tests"), "ui": ("components", "frontend", "pages", "ui", "views"),
    "api": ("api", "controllers", "handlers", "routes", "views"), "service": ("services", "usecases", "use_cases"),
    "persistence": ("database", "db", "models", "repositories"), "infrastructure": ("config", "docker", "infrastructure", "scripts", "settings"),
}


def _in(path: Column, layer: str, without: tuple = ()) -> Column:
    """Whether a part of the path, without .py at its end, names the layer."""
    p = F.transform(X.parts(F.lower(path)), lambda x: F.regexp_replace(x, r"\.py$", ""))
    return F.arrays_overlap(p, F.array(*[F.lit(x) for x in LAYERS[layer] if x not in without]))


def _test_part(path: Column) -> Column:
    return _in(path, "test") | F.exists(X.parts(F.lower(path)), lambda x: F.startswith(x, F.lit("test_")))


def violations(edges: DataFrame) -> DataFrame:
    """rule_id, severity, confidence, source, target of internal edges; the first rule that fits."""
    s, t = F.col("source"), F.col("target")
    rules = (
        ("production-imports-test", "high", 0.92, ~_test_part(s) & _test_part(t)),
        ("ui-depends-on-infrastructure", "high", 0.82, _in(s, "ui") & (_in(t, "persistence") | _in(t, "infrastructure"))),
        ("api-skips-service-layer", "medium", 0.78, _in(s, "api") & _in(t, "persistence")),
        ("persistence-depends-on-interface", "critical", 0.88, _in(s, "persistence") & (_in(t, "api") | _in(t, "ui"))),
        ("service-depends-on-ui", "critical", 0.90, _in(s, "service") & _in(t, "ui")),
    )
    hit = None
    for rule, severity, confidence, cond in rules:
        value = F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))
        hit = F.when(cond, value) if hit is None else hit.when(cond, value)
    out = edges.filter(t.isNotNull()).withColumn("hit", hit).filter("hit IS NOT NULL")
    return out.select("hit.*", "source", "target")


def layer(path: Column) -> Column:
    name = X.base_name(path)
    return (F.when(_in(path, "ui"), "ui").when(_in(path, "api", ("views",)), "api").when(_in(path, "service"), "service")
            .when(_in(path, "persistence"), "persistence").when(_in(path, "infrastructure"), "infrastructure")
            .when(_in(path, "test") | F.startswith(name, F.lit("test_")), "test").otherwise("source"))
