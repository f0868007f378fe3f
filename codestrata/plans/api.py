"""One object a repository: every analysis as a method, over shared tables of files, symbols, calls and edges."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, chunks, findings, graphs, impact, knowledge, memory, parse, reports, retrieval, review, stores, snapshots
from ..sources import repository


class Repository:
    """A scanned repository.  Tables are parsed once and kept; close() frees them."""

    def __init__(self, spark: SparkSession, files: DataFrame, name: str = "repository", embedder: Callable | None = chunks.topic_embedding, syntax: bool = False):
        """``syntax`` reads Python files by their syntax tree, and types and callables of brace languages by their blocks, instead of line by line."""
        self.spark, self.name, self.embedder, self.syntax = spark, name, embedder, syntax
        self.entries = files.persist()

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **options) -> Repository:
        return cls(spark, repository.scan(spark, folder), folder, **options)

    @classmethod
    def of(cls, spark: SparkSession, rows: list[tuple[str, str]], **options) -> Repository:
        return cls(spark, repository.from_rows(spark, rows), **options)

    def close(self) -> None:
        for df in (self.entries, self.__dict__.get("parsed")):
            if df is not None:
                df.unpersist()

    # scanning and parsing

    @cached_property
    def files(self) -> DataFrame:
        return self.entries.filter(~F.col("is_dir"))

    @cached_property
    def directories(self) -> DataFrame:
        return self.entries.filter("is_dir").select("path").unionByName(repository.directories(self.files)).distinct()

    @cached_property
    def sources(self) -> DataFrame:
        """Files of a known language with their text (strict UTF-8, else null)."""
        return repository.read_text(self.files.filter(F.col("language").isNotNull()))

    @cached_property
    def parsed(self) -> DataFrame:
        return parse.parse(repository.read_text(self.files.filter(F.col("language").isNotNull()), "replace"), self.syntax).persist()

    @cached_property
    def symbols(self) -> DataFrame:
        rows = parse.symbols_of(self.parsed)
        if not self.syntax:
            return rows
        return blocks.with_spans(rows, repository.read_text(self.files.filter(F.col("language").isNotNull()), "replace").select("path", "text"))

    @cached_property
    def calls(self) -> DataFrame:
        return parse.calls_of(self.parsed)

    @cached_property
    def parsed_files(self) -> DataFrame:
        return self.files.join(self.parsed.select("path"), "path", "left_semi")

    # graphs

    @cached_property
    def dependencies(self) -> DataFrame:
        return graphs.dependency_edges(self.symbols, self.parsed_files)

    @cached_property
    def call_nodes(self) -> DataFrame:
        return graphs.call_nodes(self.symbols)

    @cached_property
    def call_graph(self) -> DataFrame:
        return graphs.resolve_calls(self.call_nodes, self.calls)

    def dependency_stats(self) -> DataFrame:
        return graphs.with_cycle_count(graphs.dependency_stats(self.parsed_files, self.dependencies), self.cycles())

    def call_stats(self) -> DataFrame:
        return graphs.call_stats(self.call_nodes, self.call_graph)

    def cycles(self) -> DataFrame:
        return graphs.cycles(self.dependencies)

    def cycle_report(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        found = self.cycles()
        return found, graphs.cycle_edges(found, self.dependencies), graphs.cycle_stats(found, self.dependencies)

    def knowledge_graph(self) -> tuple[DataFrame, DataFrame]:
        return knowledge.nodes_and_edges(self.name, self.directories, self.parsed_files, self.symbols, self.dependencies, self.call_graph)

    # chunks and retrieval

    def chunks(self, max_chars: int = chunks.CHUNK_CHARS) -> DataFrame:
        return chunks.file_chunks(self.sources, max_chars).unionByName(chunks.symbol_chunks(self.sources, self.symbols))

    def save_scan(self, folder: str) -> None:
        stores.save_scan(self.files, self.directories, folder, self.name)

    def save_graph(self, folder: str, matched: bool = False) -> None:
        nodes, edges = self.knowledge_graph()
        stores.save_graph(nodes, edges, folder, self.name, matched)

    def embeddings(self) -> DataFrame:
        if self.embedder is None:
            raise ValueError("no embedder is set")
        return chunks.embed(self.chunks(), self.embedder)

    def store_vectors(self, folder: str) -> None:
        memory.replace_repository(self.embeddings(), folder, self.name, unique=["id"])

    def index(self, folder: str) -> dict[str, int]:
        """Bring the stored index up to date: only changed files are parsed, cut and embedded."""
        if self.embedder is None:
            raise ValueError("no embedder is set")

        def make(changed: DataFrame) -> dict[str, DataFrame]:
            parsed = parse.parse(changed, self.syntax).persist()
            cut = chunks.file_chunks(changed).unionByName(chunks.symbol_chunks(changed, parse.symbols_of(parsed)))
            return {"parsed": parsed, "vectors": chunks.embed(cut, self.embedder)}

        return snapshots.reindex(snapshots.Snapshots(self.spark, folder), self.name, self.sources.filter("text IS NOT NULL").select("path", "sha256", "language", "text"), make)

    def _near(self) -> DataFrame | None:
        """Neighbours of files; None where the graph cannot be built: retrieval goes on without it."""
        try:
            near = graphs.neighbours(self.dependencies).cache()
            near.count()
            return near
        except Exception:
            return None

    def retrieve(self, query: str, limit: int = retrieval.LIMIT, vectors: DataFrame | None = None) -> DataFrame:
        if not 1 <= limit <= 50:
            raise ValueError("limit must be from 1 to 50")
        if self.embedder is None:
            raise ValueError("no embedder is set")
        rows = vectors if vectors is not None else self.embeddings()
        if rows.isEmpty():
            raise ValueError("No vectors are stored for this repository")
        return retrieval.retrieve(rows, query, self.embedder([query])[0], self._near(), limit)

    def retrieve_many(self, questions: DataFrame, limit: int = retrieval.LIMIT, vectors: DataFrame | None = None) -> DataFrame:
        """The best chunks of each question (question_id, query); questions are embedded in tasks."""
        if not 1 <= limit <= 50:
            raise ValueError("limit must be from 1 to 50")
        if self.embedder is None:
            raise ValueError("no embedder is set")
        different = questions.filter("query IS NOT NULL").select(F.col("query").alias("id"), F.col("query").alias("content")).distinct()
        known = chunks.embed(different, self.embedder).select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
        rows = vectors if vectors is not None else self.embeddings()
        return retrieval.retrieve_many(rows, questions.join(known, "query").select("question_id", "query", "vector"), self._near(), limit)

    # analyses

    def technical_debt(self) -> tuple[DataFrame, DataFrame]:
        files = repository.read_text(self.files.filter(F.col("language").isNotNull()), "ignore")
        scored = findings.complexities(files, self.symbols)
        errors = self.parsed.filter("has_error").select("path")
        found = findings.debt_findings(files, self.symbols, self.dependencies, self.cycles(), errors, scored)
        return found.orderBy(findings.rank(F.col("severity")), "path", F.coalesce("line", F.lit(0)), "rule_ord"), findings.debt_stats(found, scored)

    def dead_code(self) -> DataFrame:
        null = F.lit(None)
        files = findings.dead_files(self.parsed_files, self.dependencies).withColumns({"line": null.cast("int"), "symbol_name": null.cast("string")})
        return files.unionByName(findings.dead_callables(self.call_nodes, self.call_graph)).orderBy("path", F.coalesce("line", F.lit(0)), "symbol_name")

    def violations(self) -> DataFrame:
        return findings.violations(self.dependencies).orderBy(findings.rank(F.col("severity")), "source", "target")

    def dead_stats(self) -> DataFrame:
        return findings.dead_stats(self.parsed_files, self.call_nodes, self.dead_code())

    def contributions(self, focus: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The listed findings, and counts, score and confidence over them."""
        files = repository.read_text(self.files.filter(F.col("language").isNotNull()), "ignore")
        listed = findings.first_contributions(findings.focused(findings.contribution_findings(files), focus))
        return listed, findings.contribution_score(listed, F.lit(findings.read_files(files).count()))

    def _names(self, names: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(names)), "pos long, query string")

    def match(self, names: list[str]) -> DataFrame:
        """(query, path) of the given names; path is null where nothing matches."""
        return impact.match_files(self._names(names), self.files)

    def changed(self, names: list[str]) -> DataFrame:
        """(pos, path) of changed files; names that match nothing stay as they are."""
        return review.changed_paths(self._names(names), self.files)

    def security_review(self, changed: list[str]) -> tuple[DataFrame, DataFrame]:
        files = repository.read_text(self.files, "ignore").join(self.changed(changed).select("path"), "path", "left_semi")
        found = findings.top_findings(findings.security_findings(files))
        return found, findings.security_stats(found)

    def bug_impact(self, trace: str, changed: list[str] = (), error: str | None = None) -> dict:
        """Root cause, impacted files, risk and advice for a stack trace."""
        if not trace.strip():
            raise ValueError("the stack trace is empty")
        traces = self.spark.createDataFrame([(0, trace)], "trace_id int, text string")
        parsed = parse.parse_traces(traces).first()
        frames = [(0, f["language"], k, f["file_path"], f["line"]) for k, f in enumerate(parsed["frames"] or [])]
        matched = {r["query"]: r["path"] for r in self.match([f[3] for f in frames]).collect()} if frames else {}
        known = self._names(list(changed)).join(self.match(list(changed)), "query").filter("path IS NOT NULL").select("pos", "path")
        rows = self.spark.createDataFrame([(t, parsed["language"], k, matched.get(p), at) for t, _, k, p, at in frames], "trace_id int, language string, pos int, path string, line int")
        root = impact.root_cause(rows, known, traces).first()
        seeds = known.select("path").unionByName(rows.filter("path IS NOT NULL").select("path")).distinct()
        hit = impact.bug_impact(seeds, self.dependencies)
        n, n_hit = F.lit, hit.count()
        risk = impact.bug_risk(n(len(frames)), n(sum(matched.get(f[3]) is not None for f in frames)), n(n_hit), n(graphs.internal(self.dependencies).count()), n(root["score"] if root else 0.0), n(known.count()))
        message = error or parsed["message"]
        advice = review.bug_advice(n(root["path"] if root else None), n(root["line"] if root else None).cast("int"), n(message).cast("string"), n(n_hit))
        scored = self.spark.range(1).select(*[c.alias(k) for k, c in risk.items()], advice.alias("recommendations")).first().asDict()
        return {
            "trace": parsed, "error_type": parsed["error_type"], "message": message, "root_cause": root["path"] if root else None, "root": root.asDict() if root else None,
            "impacted": hit.orderBy(F.desc("score"), "path"), "recommendations": scored.pop("recommendations"), "risk": scored,
        }

    def pull_request_review(self, changed: list[str], diff: str = "") -> dict:
        """Changed and impacted files, findings and a one-row report of a change."""
        known = self.changed(changed).cache()
        hit = impact.pr_impact(known, self.dependencies).cache()
        size = self.spark.createDataFrame([(diff,)], "d string").select(parse.changed_lines(F.col("d"))).first()[0]
        found = review.pr_findings(known, hit, self.technical_debt()[0], findings.violations(self.dependencies), size).cache()
        report = review.pr_report(known, hit, found, size)
        r = report.first()
        return {"changed": known, "impacted": hit, "findings": found.orderBy("section", "nth"), "report": report, "risk": {"score": r["risk_score"], "level": r["risk_level"], "confidence": r["confidence"]}, "diff_lines": size}

    def architecture_review(self, changed: list[str]) -> dict:
        """Changed and impacted files with layers, findings, scoped violations and a one-row report."""
        known = self.changed(changed).cache()
        keys = reports.key_files(self.files, self.symbols, self.dependencies)
        hit = impact.arch_impact(known, self.dependencies, keys).cache()
        scope = review.scoped(findings.violations(self.dependencies), hit).orderBy(findings.rank(F.col("severity")), "source", "target").limit(review.MAX_ITEMS).cache()
        found = review.arch_findings(known, hit, keys, self.dependencies, scope).cache()
        report = review.arch_report(known, hit, found, scope)
        r = report.first()
        return {"changed": known, "impacted": hit, "findings": found.orderBy("section", "nth"), "violations": scope, "report": report, "risk": {"score": r["risk_score"], "level": r["risk_level"], "confidence": r["confidence"]}}

    # reports

    @cached_property
    def summary(self) -> dict:
        """The summary; without dependencies and calls where their graphs cannot be built."""
        def or_nothing(make: Callable[[], DataFrame], schema: str) -> DataFrame:
            try:
                df = make()
                df.isEmpty()
                return df
            except Exception:
                return self.spark.createDataFrame([], schema)

        edges = or_nothing(lambda: self.dependencies, "source string, target string, import_name string, edge_ord int")
        calls = or_nothing(lambda: self.call_graph, "path string, callee string, source string, target string, call_ord int")
        return reports.summarize(self.files, self.directories, self.symbols, edges, calls, self.parsed_files, self.call_nodes)

    def explain(self, focus: str | None = None) -> dict:
        return reports.explain(self.summary, focus)

    def diagrams(self) -> dict[str, str]:
        return reports.diagrams(f"Architecture of {self.name}", self.summary["evidence_paths"], self.dependencies, self.call_graph)

    def architecture_document(self, focus: str | None = None) -> dict:
        return reports.architecture_document(self.name, self.summary, self.explain(focus), self.diagrams())

    def readme(self) -> dict:
        return reports.readme_document(self.name, self.summary, reports.setup_commands(self.files))

    def onboarding(self) -> dict:
        return reports.onboarding_document(self.name, self.summary, self.explain(), self.diagrams(), reports.setup_commands(self.files))

    def understanding(self, focus: str | None = None) -> dict:
        return reports.understanding(self.summary, self.explain(focus), self.diagrams())

    def explorer(self, language: str | None = None, text: str = "") -> DataFrame:
        return reports.explore(self.files, language, text)

    def explorer_tree(self, language: str | None = None, text: str = "") -> DataFrame:
        return reports.tree(self.explorer(language, text)).orderBy("path")

    def ask(self, question: str, limit: int = 5, store: memory.ConversationStore | None = None, session_id: str | None = None, llm: Callable = lambda prompt: None) -> dict:
        """Answer a question; with a store, the turn is remembered under ``session_id``."""
        if not 1 <= limit <= 20:
            raise ValueError("limit must be from 1 to 20")
        try:
            found = self.retrieve(question, limit)
        except ValueError:
            found = None
        out = reports.answer(question, self.summary, self.explain, found, llm, limit)
        if store:
            out["session_id"] = store.remember(self.name, question, out["answer"], session_id=session_id)
        return out

    def analyze(self) -> dict:
        """All analyses in turn, each run to its rows; one that fails is reported and the others go on."""
        out = {}
        for name in ("dependency_stats", "call_stats", "cycles", "technical_debt", "dead_code", "violations", "contributions"):
            try:
                made = getattr(self, name)()
                tables = made if isinstance(made, tuple) else (made,)
                for df in tables:
                    df.write.format("noop").mode("overwrite").save()
                out[name] = made
            except Exception as error:
                out[name] = error
        return out
