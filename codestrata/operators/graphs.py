"""Dependency graph, call graph, cycles and neighbours, all as joins on keys.

Edge order is carried as ``edge_ord``; first and last wins are minima and maxima by it.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.session import settle
from .parse import PARSED

PACKAGES = ("__init__", "index", "mod")


def candidates(path: Column, name: Column, source: Column) -> Column:
    """Paths that an import may mean, in order."""
    raw = F.regexp_replace(F.coalesce(source, name), "^[\"'<>]+|[\"'<>]+$", "")
    here = X.folder(path)
    local = F.startswith(raw, F.lit("."))
    slashed = F.replace(F.replace(raw, F.lit("::"), F.lit("/")), F.lit("."), F.lit("/"))
    base = F.when(local, F.concat_ws("/", F.nullif(here, F.lit("")), raw)).otherwise(slashed)
    beside = F.when(~local & ~F.contains(slashed, F.lit("/")), F.array(F.concat_ws("/", F.nullif(here, F.lit("")), slashed))).otherwise(F.array().cast("array<string>"))
    ends = F.array(*[F.lit(e) for e in PARSED])
    inner = F.array(*[F.lit(f"/{p}{e}") for p in PACKAGES for e in PARSED])
    more = F.when(X.suffix(base) != "", F.array().cast("array<string>")).otherwise(F.transform(F.concat(ends, inner), lambda e: F.concat(base, e)))
    return F.array_distinct(F.transform(F.concat(beside, F.array(base), more), X.normal_path))


def dependency_edges(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """source, target (null if external), import_name, import_source, dependency_type, edge_ord."""
    # options come before any renaming: inside a lambda a new name would hide the old column
    imports = symbols.filter("kind = 'import'").select("path", "name", "source", "sym_ord", candidates(F.col("path"), F.col("name"), F.col("source")).alias("options"))
    imports = imports.select(
        F.col("path").alias("source"), F.col("name").alias("import_name"), F.col("source").alias("import_source"), "sym_ord", "options",
    ).withColumn("edge_ord", F.struct(X.file_order(F.col("source")).alias("file"), "sym_ord"))
    tried = imports.select("source", "sym_ord", F.posexplode("options").alias("pos", "path"))
    known = files.select("path").distinct()
    found = tried.join(known, "path").groupBy("source", "sym_ord").agg(F.min_by("path", "pos").alias("target"))
    out = imports.drop("options").join(found, ["source", "sym_ord"], "left").drop("sym_ord")
    return out.withColumn("dependency_type", F.when(F.col("target").isNull(), "external").otherwise("internal"))


def internal(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("target").isNotNull())


def external_names(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("target").isNull()).select("import_name").distinct()


def dependency_stats(files: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.agg(
        F.count_if(F.col("target").isNotNull()).alias("internal_dependency_count"),
        F.count_if(F.col("target").isNull()).alias("external_dependency_count"),
        F.count_if(F.col("target").isNull()).alias("unresolved_import_count"),
    )
    return files.agg(F.count("*").alias("file_count")).crossJoin(e)  # two one-row tables


def with_cycle_count(stats: DataFrame, cycle: DataFrame) -> DataFrame:
    return stats.crossJoin(cycle.agg(F.count("*").alias("circular_dependency_count")))  # one-row tables


def fan_out(edges: DataFrame) -> DataFrame:
    return internal(edges).groupBy(F.col("source").alias("path")).agg(F.count("*").alias("fan_out"))


def fan_in(edges: DataFrame) -> DataFrame:
    return internal(edges).groupBy(F.col("target").alias("path")).agg(F.count_distinct("source").alias("fan_in"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of internal edges, each pair once."""
    e = internal(edges).select("source", "target")
    both = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return both.select(F.col("source").alias("path"), F.col("target").alias("related")).distinct()


def on_cycles(edges: DataFrame, hops: int = 2) -> DataFrame:
    """Edges of (source, target) within strongly connected components, with ``component`` (its greatest file).

    Files without an edge in or out go, over and over; then colours (the greatest file that
    reaches one) part the rest, and what the root of a colour does not reach back goes to the
    next round.  Several hops are one job, and what it made is settled.
    """
    c = F.col
    at = lambda df, end: df.withColumnRenamed("path", end)
    e, kept = settle(edges), None
    n = e.count()
    while n:  # each round finds a component at least
        while True:  # trim
            for _ in range(2):
                e = e.join(e.select(c("target").alias("source")).distinct(), "source", "left_semi").join(e.select(c("source").alias("target")).distinct(), "target", "left_semi").select("source", "target")
            e, before = settle(e), n
            n = e.count()
            if n == before:
                break
        if not n:
            break
        colour, moving = e.select(c("source").alias("path")).distinct().withColumn("colour", c("path")), True
        while moving:  # colours flow along the edges until a hop moves none
            for _ in range(hops):
                flow = e.join(at(colour.select("path", "colour"), "source"), "source").groupBy(c("target").alias("path")).agg(F.max("colour").alias("other"))
                colour = colour.select("path", "colour").join(flow, "path").select("path", F.greatest("colour", "other").alias("colour"), (c("other") > c("colour")).alias("moved"))
            colour = settle(colour)
            moving = colour.filter("moved").count() > 0
        inner = e.join(at(colour.select("path", "colour"), "source"), "source").join(colour.select(c("path").alias("target"), c("colour").alias("c2")), "target")
        inner = settle(inner.filter("colour = c2").select("source", "target", "colour"))
        back, last = colour.filter("path = colour").select("path", "colour", F.lit(0).alias("hop")), hops
        while last == hops:  # what reaches the root of its colour, against the edges
            back = back.withColumn("hop", F.lit(0))
            for k in range(1, hops + 1):
                more = inner.join(at(back.select("path", "colour"), "target"), ["target", "colour"]).select(c("source").alias("path"), "colour", F.lit(k).alias("hop"))
                back = back.unionByName(more).groupBy("path", "colour").agg(F.min("hop").alias("hop"))
            back = settle(back)
            last = back.agg(F.max("hop")).first()[0]
        found = back.select("path", "colour")
        done = settle(inner.join(at(found, "source"), ["source", "colour"], "left_semi").join(at(found, "target"), ["target", "colour"], "left_semi").select("source", "target", c("colour").alias("component")))
        kept = done if kept is None else kept.unionByName(done)
        e = settle(e.join(at(found.select("path"), "source"), "source", "left_anti").join(at(found.select("path"), "target"), "target", "left_anti"))
        n = e.count()
    return kept if kept is not None else e.withColumn("component", F.lit(None).cast("string"))


#: Tasks that share the start files of a component, and cycles that a task hands on at once.
START_DEALS, CYCLE_ROWS = 32, 5_000
#: Paths of so many files are no longer grown row by row.
GROWN_FILES = 12


def component_of(start: str, after: dict[str, list[str]], before: dict[str, list[str]]) -> set[str]:
    """Files from ``start`` on, in their order, that it reaches and that reach it."""
    def reach(step: dict[str, list[str]]) -> set[str]:
        seen, todo = {start}, [start]
        while todo:
            new = [x for x in step.get(todo.pop(), ()) if x > start and x not in seen]
            seen.update(new)
            todo += new
        return seen

    return reach(after) & reach(before)


def circuits(start: str, after: dict[str, list[str]], steps: list[int] | None = None) -> Iterator[list[str]]:
    """Elementary cycles through ``start`` in a strongly connected graph, by Johnson's blocking lists.

    A file that led to no cycle stays blocked until a file behind it comes free, so the time
    between two cycles is linear in the edges, however many dead paths there are.
    """
    path, blocked, waiting = [start], {start}, defaultdict(set)
    todo = [(iter(after[start]), [False])]
    while todo:
        step, closed = todo[-1]
        for following in step:
            if steps is not None:
                steps[0] += 1
            if following == start:
                yield path.copy()
                closed[0] = True
            elif following not in blocked:
                path.append(following)
                blocked.add(following)
                todo.append((iter(after[following]), [False]))
                break
        else:
            todo.pop()
            here = path.pop()
            if closed[0]:
                if todo:
                    todo[-1][1][0] = True
                free = [here]
                while free:
                    x = free.pop()
                    if x in blocked:
                        blocked.discard(x)
                        free += waiting.pop(x, ())
            else:
                for following in after[here]:
                    waiting[following].add(here)


def _cycles_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def found(edges: list[tuple[str, str]], deal: int, deals: int) -> Iterator[list[str]]:
        after, before = defaultdict(list), defaultdict(list)
        for s, t in sorted(edges):
            after[s].append(t)
            before[t].append(s)
        for start in sorted(after)[deal::deals]:
            inside = component_of(start, after, before)
            if len(inside) > 1:
                yield from circuits(start, {x: [y for y in after[x] if y in inside] for x in inside})

    def groups() -> Iterator[tuple]:
        key, edges = None, []
        for part in batches:
            for component, deal, deals, s, t in zip(*(part[c] for c in ("component", "deal", "deals", "source", "target"))):
                if key != (component, deal, deals):
                    if edges:
                        yield edges, *key[1:]
                    key, edges = (component, deal, deals), []
                edges.append((s, t))
        if edges:
            yield edges, *key[1:]

    made = (c for group in groups() for c in found(*group))
    while rows := list(itertools.islice(made, CYCLE_ROWS)):
        yield pd.DataFrame({"files": rows})


def component_cycles(edges: DataFrame) -> DataFrame:
    """Elementary cycles of (source, target, component) as arrays that begin at their least file.

    A cycle is found from its least file.  The start files of a component are dealt to tasks,
    each of which holds the edges of one component and hands its cycles on as it finds them.
    """
    deals = edges.groupBy("component").agg(F.least(F.count_distinct("source"), F.lit(START_DEALS)).cast("int").alias("deals"))
    rows = edges.join(deals, "component").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    return rows.repartition("component", "deal").sortWithinPartitions("component", "deal").mapInPandas(_cycles_of, "files array<string>")


def cycles(edges: DataFrame, max_length: int | None = None, many: float = 4) -> DataFrame:
    """All elementary cycles of 2 files or more (to ``max_length`` if given), as arrays that begin at their least file.

    Paths grow from each file through greater ones only, so that each cycle is found once,
    until no path is left: most graphs have few.  Once there are ``many`` paths an edge, or
    paths of GROWN_FILES files, the strongly connected components are parted and searched for
    all their cycles instead (``component_cycles``), where dead paths are no rows.
    """
    e = settle(internal(edges).filter("source <> target").select("source", "target").distinct())
    n = e.count()
    step = e.select(F.col("source").alias("last"), F.col("target").alias("next"))
    paths = e.filter("target > source").select(F.array("source", "target").alias("files"))
    found, length = None, 2
    while max_length is None or length <= max_length:
        paths = settle(paths)
        n_paths = paths.count()
        if not n_paths:
            break
        if n_paths >= many * n or length > GROWN_FILES:
            whole = component_cycles(on_cycles(e))
            return whole if max_length is None else whole.filter(F.size("files") <= max_length)
        grown = paths.withColumn("last", F.element_at("files", -1)).join(step, "last")
        closed = grown.filter(F.col("next") == F.col("files")[0]).select("files")
        found = closed if found is None else found.unionByName(closed)
        paths = grown.filter((F.col("next") > F.col("files")[0]) & ~F.array_contains("files", F.col("next"))).select(F.concat("files", F.array("next")).alias("files"))
        length += 1
    return found if found is not None else paths.filter(F.lit(False))


def cycle_edges(cycle: DataFrame, edges: DataFrame) -> DataFrame:
    """Internal edges with both ends in a cycle, chords and repeats included."""
    member = cycle.select("files", F.explode("files").alias("path"))
    e = internal(edges)
    out = e.join(member.withColumnRenamed("path", "source"), "source")
    return out.join(member.withColumnRenamed("path", "target"), ["files", "target"]).select("files", *e.columns)


def cycle_stats(cycle: DataFrame, edges: DataFrame) -> DataFrame:
    a = cycle.agg(F.count("*").alias("cycle_count"), F.coalesce(F.max(F.size("files")), F.lit(0)).alias("max_length"))
    b = cycle.select(F.explode("files").alias("p")).agg(F.count_distinct("p").alias("affected_files"))
    c = internal(edges).agg(F.count("*").alias("internal_dependencies"))
    return a.crossJoin(b).crossJoin(c)  # one-row tables


def call_nodes(symbols: DataFrame) -> DataFrame:
    """Functions and methods with their ids."""
    qualified = F.concat_ws(".", "parent", "name")
    order = F.struct(X.file_order(F.col("path")).alias("file"), "sym_ord")
    return symbols.filter(F.col("kind").isin("function", "method")).select(
        F.concat_ws(":", "path", qualified).alias("id"), "name", "kind", "path", "line", "parent", order.alias("node_ord"))


def resolve_calls(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls with source and target ids: the same file first, else a name that is unique over all files."""
    local = nodes.groupBy("path", "name").agg(F.max_by("id", "node_ord").alias("id"))
    unique = nodes.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("anywhere")).filter("n = 1").drop("n")
    out = calls.join(local.withColumnsRenamed({"name": "caller", "id": "source"}), ["path", "caller"], "left")
    out = out.join(local.withColumnsRenamed({"name": "callee", "id": "here"}), ["path", "callee"], "left")
    out = out.join(unique.withColumnRenamed("name", "callee"), "callee", "left")
    return out.withColumn("target", F.coalesce("here", "anywhere")).drop("here", "anywhere")


def call_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.agg(
        F.count("*").alias("call_count"), F.count_if(F.col("target").isNotNull()).alias("resolved_call_count"),
        F.count_if(F.col("target").isNull()).alias("unresolved_call_count"), F.count_if(F.col("recursive")).alias("recursive_call_count"),
    )
    return nodes.agg(F.count("*").alias("callable_count")).crossJoin(e)  # one-row tables


def unresolved_calls(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("target").isNull()).select("callee").distinct()
