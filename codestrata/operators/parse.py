"""Line parser for symbols and calls of a source file, and stack traces.

Scopes depend on the lines before (an empty line closes all of them), so a file is parsed by
Python, one row a file in one narrow pass; everything after works on the exploded tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .syntax import parse_python

# Declarations and calls that the line parser knows.
NAME = "([A-Za-z_][A-Za-z0-9_]*)"
CLASS = {False: re.compile(rf"^\s*(?:export\s+)?class\s+{NAME}"), True: re.compile(rf"^\s*class\s+{NAME}")}
FUNCTION = {False: re.compile(rf"^\s*(?:export\s+)?(?:async\s+)?function\s+{NAME}"), True: re.compile(rf"^\s*(?:async\s+)?def\s+{NAME}")}
VARIABLE = {False: re.compile(rf"^\s*(?:const|let|var)\s+{NAME}\s*="), True: re.compile(rf"^\s*{NAME}\s*=")}
IMPORT = re.compile(r"^\s*(?:from\s+([\w.]+)\s+)?import\s+([\w*.,\s]+)")
IMPORT_FROM = re.compile(r"^\s*import\s+(.+?)\s+from\s+[\"']([^\"']+)[\"']")
DECLARES = re.compile(r"^\s*(?:export\s+)?(?:async\s+)?(?:def|function)\s+")
DECLARATION = re.compile(rf"^\s*(?:export\s+)?(?:async\s+)?(?:def|function)\s+{NAME}")
CALL = re.compile(rf"\b{NAME}\s*\(")
NO_CALL = {"class", "def", "function", "if", "for", "while", "import", "from"}
# Extensions that the parser takes.
PARSED = (".c", ".cc", ".cpp", ".cxx", ".go", ".h", ".hh", ".hpp", ".hxx", ".java", ".js", ".jsx", ".py", ".rs", ".ts", ".tsx")

_SPAN = "line: int, col: int, end_line: int, end_col: int"
SYMBOL = f"struct<sym_ord: int, kind: string, name: string, {_SPAN}, parent: string, source: string, exported: boolean, inherits: array<string>>"
CALLED = f"struct<call_ord: int, caller: string, callee: string, {_SPAN}, recursive: boolean>"


class Scopes:
    """Names that enclose a line.  A line closes those at its own indent or deeper."""

    def __init__(self):
        self.open: list[tuple[int, str]] = []

    def around(self, indent: int) -> str | None:
        while self.open and self.open[-1][0] >= indent:
            self.open.pop()
        return self.open[-1][1] if self.open else None


def code_lines(text: str) -> Iterator[tuple[int, str, int]]:
    """Number, text and indent (leading spaces, of blank lines too) of the lines that are no comments."""
    for at, line in enumerate(text.splitlines(), 1):
        if not line.strip().startswith(("#", "//")):
            yield at, line, len(line) - len(line.lstrip(" "))


def declared(line: str, python: bool) -> Iterator[tuple[str, str, str | None]]:
    """(kind, name, source) of what a line declares: an import, and one of class, function, variable."""
    if m := IMPORT.match(line):
        yield "import", m[2].split(",")[0].strip().split(" as ")[0].strip(), m[1]
    elif m := IMPORT_FROM.match(line):
        yield "import", m[1].strip(), m[2]
    for kind, pattern in (("class", CLASS), ("function", FUNCTION), ("variable", VARIABLE)):
        if m := pattern[python].match(line):
            yield kind, m[1], None
            return


def events(text: str, python: bool) -> Iterator[tuple[str, dict]]:
    """Symbols and calls of a text in one pass."""
    types, callables = Scopes(), Scopes()
    for at, line, indent in code_lines(text):
        parent, caller = types.around(indent), callables.around(indent)
        for kind, name, source in declared(line, python):
            col = max(0, line.find(name))
            owned = kind in ("function", "variable")
            yield "symbol", {
                "kind": "method" if kind == "function" and parent else kind, "name": name, "line": at, "col": col, "end_line": at, "end_col": col + len(name),
                "parent": parent if owned else None, "source": source, "exported": False, "inherits": [],
            }
            if kind in ("class", "function"):
                types.open.append((indent, name))
        if DECLARES.match(line):  # named or not, its line calls nothing
            if m := DECLARATION.match(line):
                callables.open.append((indent, m[1]))
            continue
        for m in CALL.finditer(line):
            if m[1] not in NO_CALL:
                yield "call", {"caller": caller, "callee": m[1], "line": at, "col": m.start(1), "end_line": at, "end_col": m.end(1), "recursive": caller == m[1]}


def parse_source(text: str, python: bool) -> tuple[list[dict], list[dict]]:
    """Symbols and calls, numbered in their order."""
    out: dict[str, list[dict]] = {"symbol": [], "call": []}
    for what, row in events(text, python):
        out[what].append({f"{'sym' if what == 'symbol' else what}_ord": len(out[what]), **row})
    return out["symbol"], out["call"]


def parse_symbols(text: str, python: bool) -> list[dict]:
    return parse_source(text, python)[0]


def parse_calls(text: str) -> list[dict]:
    return parse_source(text, False)[1]


def parse(files: DataFrame, syntax: bool = False) -> DataFrame:
    """path, symbols, calls and has_error of each source file of (path, text).

    With ``syntax``, Python files go through their syntax tree; one that has none is marked by
    has_error and read by lines, like all other languages.
    """
    def one(path: str, text: str) -> tuple[list[dict], list[dict], bool]:
        python = path.lower().endswith(".py")
        made = parse_python(text) if syntax and python else None
        return (*(made or parse_source(text, python)), bool(syntax and python and made is None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            made = [one(p, t) for p, t in zip(part["path"], part["text"])]
            yield pd.DataFrame({
                "path": part["path"], "n_lines": [len(t.splitlines()) for t in part["text"]],
                "symbols": [s for s, _, _ in made], "calls": [c for _, c, _ in made], "has_error": [e for _, _, e in made],
            })

    sources = files.filter(X.suffix(F.col("path")).isin(*PARSED) & F.col("text").isNotNull()).select("path", "text")
    return sources.mapInPandas(run, f"path string, n_lines int, symbols array<{SYMBOL}>, calls array<{CALLED}>, has_error boolean")


def symbols_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("symbols").alias("s")).select("path", "s.*")


def calls_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("calls").alias("c")).select("path", "c.*")


# Frames by language, in the order they are tried, and the error line.
FRAMES = (
    ("python", r'^\s*File "([^"]+)", line (\d+), in (.+)$', 1, 2, 0, 3),
    ("javascript", r"^\s*at (?:(.+?) \()?((?:file://)?[^():]+):(\d+):(\d+)\)?$", 2, 3, 4, 1),
    ("java", r"(?U)^\s*at ([\w.$<>]+)\(([^():]+):(\d+)\)$", 2, 3, 0, 1),
    ("go", r"^\s*([^:\s]+\.go):(\d+)(?: \+\S+)?$", 1, 2, 0, 0),
)
ERROR = r"(?U)^([\w.$]*Error|[\w.$]*Exception|panic)(?::\s*(.*))?$"


def frame_path(path: Column) -> Column:
    """The file of a frame without white space around it, ``.`` segments and repeated slashes; addresses of bundles stay."""
    bare = X.strip(path)
    return F.when(F.startswith(bare, F.lit("webpack://")), bare).otherwise(X.posix_path(bare))


def trace_lines(traces: DataFrame) -> DataFrame:
    """(trace_id, pos, raw, frame or error) of each line of (trace_id, text)."""
    rows = traces.select("trace_id", F.posexplode(X.lines(X.strip(F.col("text")))).alias("pos", "raw"))
    raw, frame = F.col("raw"), None
    for lang, pattern, file, line, column, function in FRAMES:
        g = lambda k: F.regexp_extract(raw, pattern, k)  # noqa: B023, E731
        value = F.struct(
            frame_path(F.regexp_replace(g(file), "^file://", "")).alias("file_path"), g(line).cast("int").alias("line"),
            (g(column).cast("int") if column else F.lit(None).cast("int")).alias("column"),
            (F.when(g(function) != "", X.strip(g(function))) if function else F.lit(None).cast("string")).alias("function"), F.lit(lang).alias("language"),
        )
        fits = F.rlike(raw, F.lit(pattern))
        frame = F.when(fits, value) if frame is None else frame.when(fits, value)
    rows = rows.withColumn("frame", frame)
    bare = X.strip(raw)
    is_error = F.col("frame").isNull() & F.rlike(bare, F.lit(ERROR))
    return rows.withColumn("error", F.when(is_error, F.struct(F.regexp_extract(bare, ERROR, 1).alias("type"), F.nullif(F.regexp_extract(bare, ERROR, 2), F.lit("")).alias("message"))))


def parse_traces(traces: DataFrame) -> DataFrame:
    """One row a trace: language (most frames, first seen wins; unknown without frames), last error, message, frames, files."""
    rows = trace_lines(traces)
    frames = rows.filter(F.col("frame").isNotNull())
    counts = frames.groupBy("trace_id", "frame.language").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    mode = counts.groupBy("trace_id").agg(F.max_by("language", F.struct("n", (-F.col("first")).alias("f"))).alias("language"))
    out = rows.groupBy("trace_id").agg(
        F.max_by("error.type", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error_type"),
        F.max_by("error.message", F.when(F.col("error.message").isNotNull(), F.col("pos"))).alias("message"),
        F.array_sort(F.collect_list(F.when(F.col("frame").isNotNull(), F.struct("pos", "frame", "raw")))).alias("_f"),
    )
    out = out.withColumns({
        "frames": F.transform("_f", lambda f: F.struct(f["frame"]["file_path"].alias("file_path"), f["frame"]["line"].alias("line"), f["frame"]["column"].alias("column"), f["frame"]["function"].alias("function"), f["frame"]["language"].alias("language"), X.strip(f["raw"]).alias("raw"))),
        "files": F.array_distinct(F.transform("_f", lambda f: f["frame"]["file_path"])),
    }).drop("_f")
    return out.join(mode, "trace_id", "left").withColumn("language", F.coalesce("language", F.lit("unknown")))


def changed_lines(diff: Column) -> Column:
    """Added and removed lines of a diff."""
    return F.size(F.filter(X.lines(diff), lambda x: (F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++"))) | (F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("---")))))
