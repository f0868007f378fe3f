"""Knowledge graph: typed nodes and edges of a repository, the last one of a key wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

SYMBOLS = ("class", "function", "interface", "method")
# Fixed value: the label that every node has besides its own.
NODE = "ForgeNode"


def _ids(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def _parent(path: Column, repository: str) -> Column:
    folder = X.folder(path)
    return F.when(folder == "", F.lit(f"repository:{repository}")).otherwise(F.concat(F.lit("directory:"), folder))


def _node(id_: Column, labels: list[str] | Column, stage: int, **properties: Column) -> list[Column]:
    names = F.array(*[F.lit(x) for x in (NODE, *labels)]) if isinstance(labels, list) else labels
    return [id_.alias("id"), names.alias("labels"), F.to_json(F.struct(id_.alias("id"), *[c.alias(k) for k, c in properties.items()])).alias("properties"), F.lit(stage).alias("stage")]


def nodes_and_edges(repository: str, directories: DataFrame, files: DataFrame, symbols: DataFrame, dependencies: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, labels, properties) and edges (source, relationship, target, properties).

    ``files`` are parsed files (path, language), ``calls`` resolved ones.  Later stages and
    later rows of a stage overwrite earlier ones with the same key.
    """
    repo = F.lit(repository)
    spark = files.sparkSession
    path, name = F.col("path"), F.col("name")
    qualified = F.concat_ws(".", "parent", "name")
    symbol_id = F.concat_ws(":", F.lit("symbol"), path, F.col("kind"), qualified)
    order = F.struct(X.file_order(path).alias("file"), F.lit(0).alias("ord"))
    zero = F.struct(X.file_order(F.lit("")).alias("file"), F.lit(0).alias("ord"))
    kept = symbols.filter(F.col("kind").isin(*SYMBOLS)).withColumns({"sid": symbol_id, "qid": F.concat_ws(":", path, qualified), "at": F.struct(X.file_order(path).alias("file"), F.col("sym_ord").alias("ord"))})
    external = lambda kind, x: F.concat(F.lit(f"external:{kind}:"), x)
    root = spark.range(1).select(*_node(F.lit(f"repository:{repository}"), ["Repository"], 0, path=repo, name=X.base_name(repo)), zero.alias("at"))
    dirs = directories.select(*_node(F.concat(F.lit("directory:"), path), ["Directory"], 1, path=path, name=X.base_name(path), repository_path=repo), order.alias("at"))
    file_nodes = files.select(*_node(_ids(path), ["File"], 2, path=path, name=X.base_name(path), language=F.col("language"), repository_path=repo), order.alias("at"))
    symbol_nodes = kept.select(*_node(F.col("sid"), F.array(F.lit(NODE), F.lit("Symbol"), F.initcap("kind")), 3, path=path, name=name, kind=F.col("kind"), line=F.col("line"), repository_path=repo), "at")
    parents = kept.select("sid", "at", F.explode("inherits").alias("name"))
    inherited = parents.select(*_node(external("symbol", name), ["ExternalSymbol"], 3, name=name, repository_path=repo), "at")
    unknown = dependencies.filter(F.col("target").isNull()).select(*_node(external("dependency", F.col("import_name")), ["ExternalDependency"], 4, name=F.col("import_name"), repository_path=repo), zero.alias("at"))
    ids = kept.groupBy("qid").agg(F.max_by("sid", "at").alias("sid"))
    made = calls.join(ids.select(F.col("qid").alias("source"), F.col("sid").alias("source_id")), "source")
    made = made.join(ids.select(F.col("qid").alias("target"), F.col("sid").alias("target_id")), "target", "left")
    lost = made.filter(F.col("target").isNull()).select(*_node(external("call", F.col("callee")), ["ExternalCall"], 5, name=F.col("callee"), repository_path=repo), zero.alias("at"))
    all_nodes = root
    for more in (dirs, file_nodes, symbol_nodes, inherited, unknown, lost):
        all_nodes = all_nodes.unionByName(more)
    nodes = all_nodes.groupBy("id").agg(F.max_by(F.struct("labels", "properties"), F.struct("stage", "at")).alias("x")).select("id", "x.labels", "x.properties")

    plain = F.to_json(F.struct(repo.alias("repository_path")))

    def edge(rows: DataFrame, source: Column, relationship: str, target: Column, properties: Column = plain, at: Column | None = None) -> DataFrame:
        key = [source.alias("source"), F.lit(relationship).alias("relationship"), target.alias("target")]
        last = F.first(properties) if at is None else F.max_by(properties, at)
        return rows.groupBy(*key).agg(last.alias("properties"))

    imported = F.coalesce(_ids(F.col("target")), external("dependency", F.col("import_name")))
    named = lambda x: F.to_json(F.struct(repo.alias("repository_path"), *x))
    edges = edge(directories, _parent(path, repository), "CONTAINS", F.concat(F.lit("directory:"), path))
    for more in (
        edge(files, _parent(path, repository), "CONTAINS", _ids(path)),
        edge(kept, _ids(path), "DEFINES", F.col("sid")),
        edge(parents, F.col("sid"), "INHERITS", external("symbol", name)),
        edge(dependencies, _ids(F.col("source")), "IMPORTS", imported, named([F.col("import_name").alias("name")]), F.col("edge_ord")),
        edge(made, F.col("source_id"), "CALLS", F.coalesce("target_id", external("call", F.col("callee"))), named([F.col("callee").alias("name"), F.col("recursive")]), F.struct(X.file_order(path), F.col("call_ord"))),
    ):
        edges = edges.unionByName(more)
    return nodes, edges


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.agg(F.count("*").alias("node_count"), F.count_if(F.array_contains("labels", "File")).alias("file_count"), F.count_if(F.array_contains("labels", "Symbol")).alias("symbol_count"))
    b = edges.agg(F.count("*").alias("edge_count"), F.count_if(F.col("relationship") == "IMPORTS").alias("dependency_edge_count"), F.count_if(F.col("relationship") == "CALLS").alias("call_edge_count"))
    return a.crossJoin(b)  # one-row tables


def matched_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both nodes there, as a graph store keeps them."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
