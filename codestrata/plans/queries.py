"""Registered queries of the repository operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import blocks, chunks, findings, graphs, impact, knowledge, memory, parse, reports, retrieval, review, snapshots, stores
from ..sources import repository
from ..streaming import machine
from .session import passing_folder, settle
from .virtual import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


FILES = duck("files")
EDGES = duck("files", "edges")
LINES = "lines AS (SELECT path, size_bytes, i AS line, trim(l[i], ' ' || chr(9) || chr(13)) AS s FROM (SELECT path, size_bytes, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, size_bytes, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM files)))"


@query(FILES + " SELECT language, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM files GROUP BY language")
def lang_summary(spark, d):
    return reports.languages(view(spark, d, "files"))


@query(FILES + " SELECT DISTINCT extension FROM files")
def ext_distinct(spark, d):
    return view(spark, d, "files").select(X.suffix(F.col("path")).alias("extension")).distinct()


@query(FILES + " SELECT DISTINCT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/source']) AS path FROM files")
def directory_set(spark, d):
    return repository.directories(view(spark, d, "files"))


@query(FILES + " SELECT path, language, size_bytes FROM files WHERE language = 'Go' AND contains(lower(path), 'serv')")
def explorer_filter(spark, d):
    return reports.explore(view(spark, d, "files"), "Go", "SERV").select("path", "language", "size_bytes")


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')))::INT AS n_tokens FROM documents")
def token_stats(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens"))


WORDS = "the les ndst der"
CHUNKS = """WITH c AS (SELECT vec_id, 'src/p' || label || '.py' AS path, coalesce(text, '') AS content, embedding FROM embeddings LEFT JOIN documents ON vec_id = doc_id),
q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, path, content,
  coalesce(least(1, greatest(0, (list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) + 1) / 2)), 0) AS v,
  len(list_intersect(%s, list_distinct(regexp_extract_all(lower(path || ' ' || content), '[a-z0-9_]+')))) / %d.0 AS k FROM c, q)"""
NEAR = """, g AS (SELECT path, max(k) AS k, max(v) AS v FROM s GROUP BY path),
seed AS (SELECT path FROM g WHERE CASE WHEN (SELECT max(k) FROM g) > 0 THEN k > 0 ELSE abs(v - (SELECT max(v) FROM g)) <= 1e-9 * greatest(abs(v), (SELECT max(v) FROM g)) END),
e AS (SELECT DISTINCT 'src/p' || label || '.py' AS a, 'src/p' || ((label + 1) % 10) || '.py' AS b FROM embeddings),
near AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT *, CASE WHEN path IN (SELECT path FROM seed) THEN 1.0 WHEN path IN (SELECT a FROM near WHERE b IN (SELECT path FROM seed)) THEN 0.5 ELSE 0.0 END AS gs,
  coalesce((SELECT array_to_string(list_sort(list(b))[1:5], ',') FROM near WHERE a = path), '') AS related FROM s)
SELECT vec_id, path, round(v::DOUBLE, 6) AS vector_score, round(k::DOUBLE, 6) AS keyword_score, gs::DOUBLE AS graph_score, related,
  round((0.6 * v + 0.3 * k + 0.1 * gs)::DOUBLE, 6) AS score
FROM r ORDER BY round((0.6 * v + 0.3 * k + 0.1 * gs)::DOUBLE, 12) DESC, path, vec_id LIMIT 10"""


def _chunks(spark, d) -> tuple[DataFrame, list[float]]:
    vectors = table(spark, d, "embeddings")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    out = vectors.join(docs, "vec_id", "left").select(
        "vec_id", F.concat(F.lit("src/p"), "label", F.lit(".py")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), "embedding",
        F.lit(None).cast("string").alias("symbol_name"), F.lit(None).cast("string").alias("symbol_kind"), F.col("vec_id").alias("start_line"), F.col("vec_id").alias("id"))
    return out, vectors.filter("vec_id = 0").first()["embedding"]


def _retrieve(spark, d, words) -> DataFrame:
    c, vector = _chunks(spark, d)
    path = lambda k: F.concat(F.lit("src/p"), k, F.lit(".py"))
    edges = table(spark, d, "embeddings").select(path(F.col("label")).alias("source"), path((F.col("label") + 1) % 10).alias("target"))
    out = retrieval.retrieve(c, words, vector, graphs.neighbours(edges))
    r = lambda x: F.round(x, 6).alias(x)
    return out.select("vec_id", "path", r("vector_score"), r("keyword_score"), "graph_score", F.array_join("related_paths", ",").alias("related"), r("score"))


@query(CHUNKS % (str(WORDS.split()), 4) + NEAR)
def hybrid_topk(spark, d):
    return _retrieve(spark, d, WORDS)


@query(CHUNKS % ("['zzqq']", 1) + NEAR)
def hybrid_vector_seeds(spark, d):
    return _retrieve(spark, d, "zzqq")


@query(CHUNKS % (str(WORDS.split()), 4) + " SELECT vec_id, round(v::DOUBLE, 6) AS vector_score, round(k::DOUBLE, 6) AS keyword_score FROM s")
def chunk_scores(spark, d):
    c, vector = _chunks(spark, d)
    return retrieval.score(c, WORDS, vector).select("vec_id", F.round("vector_score", 6).alias("vector_score"), F.round("keyword_score", 6).alias("keyword_score"))


TURNS = """WITH c AS (SELECT vec_id, 'src/p' || (vec_id % 97) || '.py' AS path, embedding::DOUBLE[] AS e, list_distinct(regexp_extract_all(lower('src/p' || (vec_id % 97) || '.py ' || coalesce(text, '')), '[a-z0-9_]+')) AS t FROM embeddings LEFT JOIN documents ON vec_id = doc_id),
q AS (SELECT conv_id, turn, u.text AS query, v.embedding::DOUBLE[] AS e, list_distinct(regexp_extract_all(lower(u.text), '[a-z0-9_]+')) AS t FROM (
  SELECT conv_id, turn, CASE conv_id % 4 WHEN 1 THEN 'zz' || conv_id || ' 問' WHEN 2 THEN 'p' || conv_id ELSE text END AS text FROM conversations WHERE role = 'user') u LEFT JOIN embeddings v ON v.vec_id = u.conv_id WHERE trim(u.text) <> ''),
s AS (SELECT conv_id, turn, vec_id, path, coalesce(least(1, greatest(0, (list_cosine_similarity(c.e, q.e) + 1) / 2)), 0)::DOUBLE AS v, len(list_intersect(q.t, c.t)) / greatest(1, len(q.t)) AS k FROM q, c),
g AS (SELECT conv_id, turn, path, max(k) AS k, max(v) AS v FROM s GROUP BY ALL),
m AS (SELECT conv_id, turn, max(k) AS k, max(v) AS v FROM g GROUP BY ALL),
seed AS (SELECT conv_id, turn, path FROM g JOIN m USING (conv_id, turn) WHERE CASE WHEN m.k > 0 THEN g.k > 0 ELSE abs(g.v - m.v) <= 1e-9 * greatest(g.v, m.v) END),
e AS (SELECT DISTINCT 'src/p' || (vec_id % 97) || '.py' AS a, 'src/p' || CASE WHEN vec_id % 7 = 0 THEN 0 ELSE (vec_id % 97 + 1) % 97 END || '.py' AS b FROM embeddings),
near AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
bes AS (SELECT DISTINCT conv_id, turn, a AS path FROM seed JOIN near ON b = path),
r AS (SELECT s.*, CASE WHEN seed.path IS NOT NULL THEN 1.0 WHEN bes.path IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE AS gs FROM s LEFT JOIN seed USING (conv_id, turn, path) LEFT JOIN bes USING (conv_id, turn, path)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(0.6 * v + 0.3 * k + 0.1 * gs, 12) DESC, path, vec_id)::INT AS rank FROM r QUALIFY rank <= 10)
SELECT conv_id, turn, rank, vec_id, path, round(v, 6) AS vector_score, round(k::DOUBLE, 6) AS keyword_score, gs AS graph_score, round(0.6 * v + 0.3 * k + 0.1 * gs, 6) AS score, coalesce(l.related, '') AS related
FROM o LEFT JOIN (SELECT a AS path, array_to_string(list_sort(list(b))[1:5], ',') AS related FROM near GROUP BY a) l USING (path)"""


@query(TURNS)
def conversation_retrieval(spark, d):
    """Every user turn as a question, a quarter of them names of files, a quarter without a known word."""
    vectors, path = table(spark, d, "embeddings"), lambda k: F.concat(F.lit("src/p"), k, F.lit(".py"))
    at = F.col("vec_id") % 97
    c = _chunks(spark, d)[0].withColumn("path", path(at))
    target = F.when(F.col("vec_id") % 7 == 0, 0).otherwise((at + 1) % 97)
    edges = vectors.select(path(at).alias("source"), path(target).alias("target")).distinct()
    said = F.when(F.col("conv_id") % 4 == 1, F.concat(F.lit("zz"), "conv_id", F.lit(" 問"))).when(F.col("conv_id") % 4 == 2, F.concat(F.lit("p"), "conv_id")).otherwise(F.col("text"))
    turns = table(spark, d, "conversations").filter("role = 'user'").select(F.struct("conv_id", "turn").alias("question_id"), said.alias("query"), F.col("conv_id").alias("vec_id"))
    questions = turns.join(vectors.select("vec_id", F.col("embedding").alias("vector")), "vec_id", "left")
    out = retrieval.retrieve_many(c, questions, graphs.neighbours(edges.filter("source <> target")))
    r = lambda x: F.round(x, 6).alias(x)
    return out.select("question_id.conv_id", "question_id.turn", "rank", F.col("id").alias("vec_id"), "path", r("vector_score"), r("keyword_score"), "graph_score", r("score"), F.array_join("related_paths", ",").alias("related"))


@query(EDGES + " SELECT DISTINCT import_name FROM edges WHERE target IS NULL")
def external_deps(spark, d):
    return graphs.external_names(view(spark, d, "edges"))


@query(EDGES + """ SELECT (SELECT count(*) FROM files) AS file_count, count(target) AS internal_dependency_count,
  count(*) - count(target) AS external_dependency_count, count(*) - count(target) AS unresolved_import_count FROM edges""")
def dep_stats(spark, d):
    return graphs.dependency_stats(view(spark, d, "files"), view(spark, d, "edges"))


@query(EDGES + " SELECT source AS path, count(*) AS fan_out FROM edges WHERE target IS NOT NULL GROUP BY source")
def fan_out(spark, d):
    return graphs.fan_out(view(spark, d, "edges"))


@query(EDGES + " SELECT target AS path, count(DISTINCT source) AS fan_in FROM edges WHERE target IS NOT NULL GROUP BY target")
def fan_in(spark, d):
    return graphs.fan_in(view(spark, d, "edges"))


@query(EDGES + " SELECT source AS path, target AS related FROM edges WHERE target IS NOT NULL UNION SELECT target, source FROM edges WHERE target IS NOT NULL")
def neighbours(spark, d):
    return graphs.neighbours(view(spark, d, "edges"))


CYCLES = duck("rings", recursive=True) + """, e AS (SELECT DISTINCT source AS s, target AS t FROM rings WHERE source <> target),
p AS (SELECT [s, t] AS files, t AS last FROM e WHERE t > s
  UNION ALL SELECT list_append(p.files, e.t), e.t FROM p JOIN e ON e.s = p.last WHERE e.t > p.files[1] AND NOT list_contains(p.files, e.t)),
c AS (SELECT files FROM p JOIN e ON e.s = p.last AND e.t = p.files[1])"""


@query(CYCLES + " SELECT array_to_string(files, ',') AS files FROM c")
def cycles(spark, d):
    return graphs.cycles(view(spark, d, "rings")).select(F.array_join("files", ",").alias("files"))


@query(CYCLES + """ SELECT (SELECT count(DISTINCT source) FROM rings) AS file_count, count(*) AS internal_dependency_count, 0::BIGINT AS external_dependency_count, 0::BIGINT AS unresolved_import_count,
  (SELECT count(*) FROM c) AS circular_dependency_count FROM rings""")
def ring_stats(spark, d):
    e = view(spark, d, "rings")
    files = e.select(F.col("source").alias("path")).distinct()
    return graphs.with_cycle_count(graphs.dependency_stats(files, e.withColumn("import_name", F.lit("m"))), graphs.cycles(e))


@query(CYCLES + """ SELECT (SELECT count(*) FROM c) AS cycle_count, (SELECT max(len(files))::INT FROM c) AS max_length,
  (SELECT count(DISTINCT f) FROM (SELECT unnest(files) AS f FROM c)) AS affected_files, (SELECT count(*) FROM rings) AS internal_dependencies""")
def cycle_stats(spark, d):
    e = view(spark, d, "rings")
    return graphs.cycle_stats(graphs.cycles(e), e)


@query(CYCLES + " SELECT array_to_string(files, ',') AS files, source, target FROM c, rings WHERE list_contains(files, source) AND list_contains(files, target)")
def cycle_edges(spark, d):
    e = view(spark, d, "rings")
    return graphs.cycle_edges(graphs.cycles(e), e).select(F.array_join("files", ",").alias("files"), "source", "target")


@query(CYCLES.replace(duck("rings", recursive=True), duck("dense", recursive=True)).replace("FROM rings", "FROM dense") + " SELECT array_to_string(files, ',') AS files, len(files)::INT AS length FROM c")
def dense_cycles(spark, d):
    """Cycles of long rings and of groups with more paths than edges."""
    return graphs.cycles(view(spark, d, "dense")).select(F.array_join("files", ",").alias("files"), F.size("files").alias("length"))


@query(EDGES + """ SELECT 'unused_file' AS kind, path, 0.68::DOUBLE AS confidence FROM files WHERE path NOT IN (SELECT target FROM edges WHERE target IS NOT NULL)
  AND split_part(path, '/', 1) <> 'tests'""")
def dead_files(spark, d):
    return findings.dead_files(view(spark, d, "files"), view(spark, d, "edges"))


RESOLVED = duck("nodes", "calls") + """, local AS (SELECT path, name, arg_max(id, node_ord) AS id FROM nodes GROUP BY path, name),
uniq AS (SELECT name, min(id) AS id FROM nodes GROUP BY name HAVING count(*) = 1),
r AS (SELECT l_orderkey, l_linenumber, c.path, caller, callee, a.id AS source, coalesce(b.id, u.id) AS target FROM calls c
  LEFT JOIN local a ON a.path = c.path AND a.name = c.caller LEFT JOIN local b ON b.path = c.path AND b.name = c.callee LEFT JOIN uniq u ON u.name = c.callee)"""


def _resolved(spark, d) -> DataFrame:
    return graphs.resolve_calls(view(spark, d, "nodes"), view(spark, d, "calls"))


@query(RESOLVED + " SELECT l_orderkey, l_linenumber, source, target FROM r")
def call_resolve(spark, d):
    return _resolved(spark, d).select("l_orderkey", "l_linenumber", "source", "target")


@query(RESOLVED + """ SELECT (SELECT count(*) FROM nodes) AS callable_count, count(*) AS call_count, count(target) AS resolved_call_count,
  count(*) - count(target) AS unresolved_call_count, count(*) FILTER (caller = callee) AS recursive_call_count FROM r""")
def call_stats(spark, d):
    return graphs.call_stats(view(spark, d, "nodes"), _resolved(spark, d))


@query(RESOLVED + " SELECT DISTINCT callee FROM r WHERE target IS NULL")
def unresolved_calls(spark, d):
    return graphs.unresolved_calls(_resolved(spark, d))


@query(RESOLVED + " SELECT 'unused_callable' AS kind, path, 1 AS line, name AS symbol_name, 0.72::DOUBLE AS confidence FROM nodes WHERE id NOT IN (SELECT target FROM r WHERE target IS NOT NULL)")
def dead_callables(spark, d):
    return findings.dead_callables(view(spark, d, "nodes"), _resolved(spark, d))


LAYERED = EDGES + """, x AS (SELECT source, target, split_part(source, '/', 1) AS s, split_part(target, '/', 1) AS t FROM edges WHERE target IS NOT NULL),
v AS (SELECT source, target, CASE WHEN s <> 'tests' AND t = 'tests' THEN 'production-imports-test' WHEN s = 'components' AND t = 'repositories' THEN 'ui-depends-on-infrastructure'
  WHEN s = 'api' AND t = 'repositories' THEN 'api-skips-service-layer' WHEN s = 'repositories' AND t IN ('api', 'components') THEN 'persistence-depends-on-interface'
  WHEN s = 'services' AND t = 'components' THEN 'service-depends-on-ui' END AS rule_id FROM x),
w AS (SELECT *, CASE rule_id WHEN 'api-skips-service-layer' THEN 'medium' WHEN 'production-imports-test' THEN 'high' WHEN 'ui-depends-on-infrastructure' THEN 'high' ELSE 'critical' END AS severity FROM v WHERE rule_id IS NOT NULL)"""


@query(LAYERED + """ SELECT rule_id, severity, source, target, CASE rule_id WHEN 'production-imports-test' THEN 0.92 WHEN 'ui-depends-on-infrastructure' THEN 0.82 WHEN 'api-skips-service-layer' THEN 0.78
  WHEN 'persistence-depends-on-interface' THEN 0.88 ELSE 0.9 END::DOUBLE AS confidence FROM w""")
def violations(spark, d):
    return findings.violations(view(spark, d, "edges"))


@query(LAYERED + " SELECT count(*) AS finding_count, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM w")
def violation_stats(spark, d):
    v = findings.violations(view(spark, d, "edges"))
    return v.agg(F.count("*").alias("finding_count"), *findings.severity_counts(v))


@query(FILES + " SELECT path, CASE split_part(path, '/', 1) WHEN 'components' THEN 'ui' WHEN 'api' THEN 'api' WHEN 'services' THEN 'service' WHEN 'repositories' THEN 'persistence' WHEN 'tests' THEN 'test' ELSE 'source' END AS layer FROM files")
def layers(spark, d):
    return view(spark, d, "files").select("path", findings.layer(F.col("path")).alias("layer"))


SEEDS = ", seed AS (SELECT path FROM files WHERE doc_id % 10 = 3)"
IMPACT = EDGES + SEEDS + """, hit AS (
  SELECT source AS path, {a} AS score, target AS via, edge_ord, 0 AS branch FROM edges WHERE target IN (SELECT path FROM seed)
  UNION ALL SELECT target, {b}, source, edge_ord, 1 FROM edges WHERE source IN (SELECT path FROM seed) AND target IS NOT NULL),
one AS (SELECT path, score, via FROM hit WHERE path NOT IN (SELECT path FROM seed) QUALIFY row_number() OVER (PARTITION BY path ORDER BY edge_ord, branch) = 1),
every AS (SELECT path, {s}::DOUBLE AS score, NULL AS via FROM seed UNION ALL SELECT path, score::DOUBLE, via FROM one)"""


def _seeds(spark, d) -> DataFrame:
    return view(spark, d, "files").filter("doc_id % 10 = 3").select("path")


@query(IMPACT.format(a=0.72, b=0.62, s=0.95) + " SELECT path, score, via FROM every")
def impact_bug(spark, d):
    return impact.bug_impact(_seeds(spark, d), view(spark, d, "edges"))


@query(IMPACT.format(a=0.72, b=0.62, s=0.95) + " SELECT path, score, via FROM every ORDER BY score DESC, path LIMIT 12")
def impact_pr(spark, d):
    return impact.pr_impact(_seeds(spark, d), view(spark, d, "edges"))


@query(IMPACT.format(a=0.74, b=0.66, s=0.96) + """ SELECT path, score, via, layer FROM (SELECT path, via, CASE WHEN score = 0.96 AND regexp_matches(path, 'd[0-9]*3[.]') THEN 0.99 ELSE score END AS score,
  CASE split_part(path, '/', 1) WHEN 'components' THEN 'ui' WHEN 'api' THEN 'api' WHEN 'services' THEN 'service' WHEN 'repositories' THEN 'persistence' WHEN 'tests' THEN 'test' ELSE 'source' END AS layer FROM every) ORDER BY score DESC, path LIMIT 12""")
def impact_arch(spark, d):
    return impact.arch_impact(_seeds(spark, d), view(spark, d, "edges"), _seeds(spark, d))


@query(FILES + " SELECT '/srv/app/' || path AS query, path FROM files UNION ALL SELECT './d' || doc_id || '.x', NULL FROM files UNION ALL SELECT '/other/d' || doc_id || extension, path FROM files")
def file_match(spark, d):
    f = view(spark, d, "files")
    q = f.select(F.explode(F.array(F.concat(F.lit("/srv/app/"), "path"), F.concat(F.lit("./d"), "doc_id", F.lit(".x")), F.concat(F.lit("/other/d"), "doc_id", "extension"))).alias("query"))
    return impact.match_files(q, f)


@query("""WITH x AS (SELECT doc_id, doc_id % 7 AS frames, doc_id % 5 AS matched, doc_id % 9 AS impacted, doc_id % 31 AS edges, (doc_id % 10) / 10.0 AS root, doc_id % 3 AS changed FROM documents),
y AS (SELECT *, CASE WHEN frames > 0 THEN matched::DOUBLE / frames ELSE 0 END AS ratio FROM x),
z AS (SELECT *, round_even((least(100, round_even(ratio * 100, 0)) * 30 + least(100, impacted * 18) * 30 + least(100, edges * 4) * 15 + round_even(root::DOUBLE * 100, 0) * 15 + least(100, changed * 50) * 10) / 100, 0)::INT AS score FROM y)
SELECT doc_id, score, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END AS level,
  round(least(0.95, 0.25 + ratio * 0.45 + least(changed, 1) * 0.15 + least(impacted, 5) / 5.0 * 0.1)::DOUBLE, 6) AS confidence FROM z""")
def risk_score(spark, d):
    x = table(spark, d, "documents").selectExpr("doc_id", "doc_id % 7 frames", "doc_id % 5 matched", "doc_id % 9 impacted", "doc_id % 31 edges", "(doc_id % 10) / 10D root", "doc_id % 3 changed")
    r = impact.bug_risk(*[F.col(c) for c in ("frames", "matched", "impacted", "edges", "root", "changed")])
    return x.select("doc_id", r["score"].alias("score"), r["level"].alias("level"), F.round(r["confidence"], 6).alias("confidence"))


SECURITY = FILES + ", " + LINES + r""", f AS (SELECT path, line, s, lower(s) AS l, replace(lower(s), ' ', '') AS t FROM lines WHERE size_bytes <= 512000),
h AS (SELECT path, line, s, unnest([
  CASE WHEN regexp_matches(s, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN {'c': 'hardcoded_private_key', 'v': 'critical', 'o': 0} END,
  CASE WHEN regexp_matches(s, '(?i)\b(api[_-]?key|auth[_-]?token|password|private[_-]?key|secret|token)\b') AND regexp_matches(s, '[:=]\s*[''"][^''"]{8,}[''"]') THEN {'c': 'hardcoded_secret', 'v': 'high', 'o': 1} END,
  CASE WHEN contains(s, 'eval(') OR contains(s, 'exec(') OR contains(s, 'child_process.exec') OR contains(s, 'system(') OR contains(l, 'new function(') OR contains(l, 'shell=true') OR contains(l, 'runtime.getruntime().exec') THEN {'c': 'dangerous_code_execution', 'v': 'high', 'o': 2} END,
  CASE WHEN contains(l, 'pickle.load') OR contains(l, 'objectinputstream') OR (contains(l, 'yaml.load(') AND NOT contains(l, 'safeloader')) THEN {'c': 'unsafe_deserialization', 'v': 'high', 'o': 3} END,
  CASE WHEN contains(l, 'md5(') OR contains(l, 'sha1(') OR contains(l, 'createhash(''md5''') OR contains(l, 'createhash("md5"') OR contains(l, 'des.new') THEN {'c': 'weak_crypto', 'v': 'medium', 'o': 4} END,
  CASE WHEN contains(t, 'verify=false') OR contains(t, 'rejectunauthorized:false') OR contains(t, 'debug=true') OR contains(t, 'allow_origins=["*"]') OR (contains(l, 'access-control-allow-origin') AND contains(s, '*')) THEN {'c': 'security_controls_disabled', 'v': 'high', 'o': 5} END,
  CASE WHEN contains(l, 'execute(') AND regexp_matches(s, '(?i)\b(SELECT|INSERT|UPDATE|DELETE)\b') AND (contains(s, 'f''') OR contains(s, 'f"') OR contains(s, '+') OR contains(s, '%') OR contains(s, '.format(')) THEN {'c': 'dynamic_sql', 'v': 'high', 'o': 6} END,
  CASE WHEN contains(s, 'gets(') OR contains(s, 'strcpy(') OR contains(s, 'strcat(') OR contains(s, 'sprintf(') THEN {'c': 'unsafe_memory_api', 'v': 'high', 'o': 7} END]) AS x FROM f),
g AS (SELECT x.c AS category, x.v AS severity, path, line::INT AS line, substr(s, 1, 160) AS evidence, x.o AS rule_ord FROM h WHERE x IS NOT NULL
  UNION ALL SELECT 'file_too_large', 'low', path, 1, '', 8 FROM files WHERE size_bytes > 512000)"""


@query(SECURITY + " SELECT category, severity, path, line, evidence FROM g")
def security_findings(spark, d):
    return findings.security_findings(view(spark, d, "files")).drop("rule_ord")


@query(SECURITY + """, t AS (SELECT * FROM g ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, path, line, rule_ord LIMIT 40),
n AS (SELECT count(*) AS finding_count, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM t)
SELECT *, least(low * 3 + medium * 10 + high * 24 + critical * 45, 100) AS risk_score,
  CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 55 THEN 'high' WHEN risk_score >= 25 THEN 'medium' ELSE 'low' END AS risk_level FROM n""")
def security_stats(spark, d):
    return findings.security_stats(findings.top_findings(findings.security_findings(view(spark, d, "files"))))


@query("SELECT doc_id, (1 + " + " + ".join(f"(length(t) - length(replace(t, '{b}', ''))) // {len(b)}" for b in findings.BRANCHES) + ")::INT AS complexity FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def complexity(spark, d):
    return table(spark, d, "documents").select("doc_id", findings.complexity(F.col("text")).alias("complexity"))


# declarations line by line: a block ends with the first line that returns to the depth before its own
SPANS = duck("braces") + r""", bl AS (SELECT path, lang, i AS line, x[i] AS s FROM (SELECT path, x, regexp_extract(path, '[a-z]+$') AS lang, unnest(range(1, len(x) + 1)) AS i FROM (SELECT path, string_split(text, chr(10)) AS x FROM braces))),
bm AS (SELECT *, regexp_replace(s, '"[^"]*"|`[^`]*`|//.*$|/\*.*\*/', '', 'g') AS m FROM bl),
bd AS (SELECT *, sum(length(replace(m, '}', '')) - length(replace(m, '{', ''))) OVER (PARTITION BY path ORDER BY line) AS after FROM bm),
bh AS (SELECT *, CASE lang
    WHEN 'ts' THEN CASE WHEN regexp_matches(m, '^export interface ') THEN 'interface' WHEN regexp_matches(m, '^export class ') THEN 'class' WHEN regexp_matches(m, '^function ') THEN 'function' WHEN regexp_matches(m, '^  \w+\(.*\{$') THEN 'method' END
    WHEN 'java' THEN CASE WHEN regexp_matches(m, '^interface ') THEN 'interface' WHEN regexp_matches(m, '^public class ') THEN 'class' WHEN regexp_matches(m, '^  [\w<>]+( [\w<>]+)* \w+\([^)]*\)( \{|;)$') THEN 'method' END
    WHEN 'go' THEN CASE WHEN regexp_matches(m, '^type ') THEN 'class' WHEN regexp_matches(m, '^func \(') THEN 'method' WHEN regexp_matches(m, '^func ') THEN 'function' END
    WHEN 'rs' THEN CASE WHEN regexp_matches(m, '^pub struct ') THEN 'class' WHEN regexp_matches(m, '^trait ') THEN 'interface' WHEN regexp_matches(m, '^impl ') THEN 'impl' WHEN regexp_matches(m, '^ +fn ') THEN 'method' END
    ELSE CASE WHEN regexp_matches(m, '^struct ') THEN 'class' WHEN regexp_matches(m, '^static int ') THEN 'function' END END AS kind,
  regexp_extract(m, CASE WHEN lang = 'rs' AND starts_with(m, 'impl') THEN 'for (\w+)' WHEN regexp_matches(m, '\b(class|interface|struct|trait|type) ') THEN '(?:class|interface|struct|trait|type) (\w+)' ELSE '(\w+)\([^()]*\)[^()]*$' END, 1) AS name FROM bd),
be AS (SELECT h.*, CASE WHEN m LIKE '%;' AND m NOT LIKE '%{%' THEN h.line ELSE (SELECT min(d.line) FROM bd d WHERE d.path = h.path AND d.line > h.line AND d.after < h.after) END AS end_line FROM bh h WHERE kind IS NOT NULL),
bs AS (SELECT path, kind, name, line, end_line, lang = 'ts' AND starts_with(s, 'export') AS exported, (SELECT arg_max(p.name, p.line) FROM be p WHERE p.path = e.path AND p.line < e.line AND p.end_line >= e.end_line) AS parent,
  CASE WHEN lang IN ('ts', 'java') THEN array_to_string(regexp_extract_all(regexp_extract(s, ' (extends .*)\{', 1), '\b(Base|Shape\d*)\b'), ',') ELSE '' END AS inherits, length(regexp_extract(s, '^ *')) AS col FROM be e WHERE kind <> 'impl')"""


@query(SPANS + """, sy AS (SELECT *, 'symbol:' || path || ':' || kind || ':' || coalesce(parent || '.', '') || name AS sid FROM bs)
SELECT DISTINCT 'file:' || path AS source, 'DEFINES' AS relationship, sid AS target FROM sy UNION SELECT sid, 'INHERITS', 'external:symbol:' || unnest(string_split(inherits, ',')) FROM sy WHERE inherits <> ''""")
def kg_inheritance(spark, d):
    """What files of brace languages define, and what their types extend and implement."""
    f = view(spark, d, "braces").withColumn("language", repository.language(F.col("path")))
    edges = knowledge.nodes_and_edges("repo", repository.directories(f), f, blocks.declarations(f), view(spark, d, "edges"), _resolved(spark, d))[1]
    return edges.filter("relationship IN ('DEFINES', 'INHERITS')").select("source", "relationship", "target")


@query(SPANS + " SELECT path, kind, name, line::INT AS line, end_line::INT AS end_line, col::INT AS col, parent, exported, inherits FROM bs")
def brace_symbols(spark, d):
    s = blocks.declarations(view(spark, d, "braces"))
    return s.select("path", "kind", "name", "line", "end_line", "col", "parent", "exported", F.array_join("inherits", ",").alias("inherits"))


DEBT = CYCLES.replace("WITH RECURSIVE ", "WITH RECURSIVE " + duck("files", "edges", "symbols", "members").removeprefix("WITH ") + ", " + SPANS.removeprefix("WITH ") + ", ") + """,
all_symbols AS (SELECT path, kind, name, line, end_line, NULL AS parent FROM symbols UNION ALL SELECT path, kind, name, line, end_line, parent FROM members UNION ALL SELECT path, kind, name, line, end_line, parent FROM bs),
all_files AS (SELECT path, text FROM files UNION ALL SELECT path, text FROM braces),
dn AS (SELECT path, len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS n FROM all_files),
db AS (SELECT s.path, s.line, lower(array_to_string(string_split(text, chr(10))[s.line:s.end_line], chr(10))) AS t FROM all_symbols s JOIN all_files f ON f.path = s.path WHERE kind IN ('function', 'method')),
dc AS (SELECT path, line, 1 + %s AS score FROM db),
a AS (SELECT 'large_file' AS category, CASE WHEN n >= 1000 THEN 'high' ELSE 'medium' END AS severity, path, NULL::INT AS line, 0 AS rule_ord FROM dn WHERE n >= 500
  UNION ALL SELECT 'parse_error', 'high', path, NULL, 0 FROM files WHERE doc_id %% 333 = 7
  UNION ALL SELECT 'long_symbol', CASE WHEN end_line - line + 1 >= 160 THEN 'high' ELSE 'medium' END, path, line, 1 FROM all_symbols WHERE kind IN ('function', 'method') AND end_line - line + 1 >= 80
  UNION ALL SELECT 'high_complexity', CASE WHEN score >= 20 THEN 'critical' ELSE 'high' END, path, line, 2 FROM dc WHERE score >= 10
  UNION ALL SELECT 'broad_type', 'medium', s.path, s.line, 3 FROM symbols s JOIN (SELECT path, parent FROM members GROUP BY path, parent HAVING count(*) >= 15) m ON m.path = s.path AND m.parent = s.name WHERE s.kind = 'class'
  UNION ALL SELECT 'high_fan_out', 'medium', source, NULL, 4 FROM edges WHERE target IS NOT NULL GROUP BY source HAVING count(*) >= 8
  UNION ALL SELECT 'dependency_cycle', 'high', files[1], NULL, 5 FROM c)""" % " + ".join(
    f"(length(t) - length(replace(t, '{b}', ''))) // {len(b)}" for b in findings.BRANCHES)
SEVERITY = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


def _members(spark, d, braces: DataFrame) -> DataFrame:
    symbols, members = view(spark, d, "symbols"), view(spark, d, "members")
    return symbols.unionByName(members, allowMissingColumns=True).unionByName(blocks.declarations(braces).drop("sym_ord"), allowMissingColumns=True)


def _debt(spark, d) -> tuple[DataFrame, DataFrame]:
    """All categories: cycles of the rings, methods of the wide classes, spans of brace languages, some files marked as not parsed."""
    braces = view(spark, d, "braces")
    files, symbols = view(spark, d, "files").unionByName(braces, allowMissingColumns=True), _members(spark, d, braces)
    scored = findings.complexities(files, symbols)
    errors = view(spark, d, "files").filter("doc_id % 333 = 7").select("path")
    return findings.debt_findings(files, symbols, view(spark, d, "edges"), graphs.cycles(view(spark, d, "rings")), errors, scored), scored


@query(DEBT + " SELECT category, severity, path, line FROM a")
def debt_findings(spark, d):
    return _debt(spark, d)[0].drop("rule_ord")


@query(DEBT + """, k AS (SELECT count(*) AS finding_count, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM a)
SELECT k.*, greatest(0, 100 - (critical * 20 + high * 12 + medium * 6 + low * 2)) AS debt_score, (SELECT round(avg(score), 2) FROM dc) AS average_complexity,
  (SELECT max(score)::INT FROM dc) AS max_complexity, (SELECT count(*) FROM dc WHERE score >= 10) AS complex_symbol_count FROM k""")
def debt_score(spark, d):
    return findings.debt_stats(*_debt(spark, d))


@query(FILES + """ SELECT 'file:' || path || ':1:' || (doc_id % 9 + 1) || ':' || substr(sha256('file:' || path || ':1:' || (doc_id % 9 + 1) || '::'), 1, 16) AS id FROM files""")
def chunk_ids(spark, d):
    f, null = view(spark, d, "files"), F.lit(None).cast("string")
    return f.select(chunks.chunk_id(F.lit("file"), F.col("path"), F.lit(1), F.col("doc_id") % 9 + 1, null, null).alias("id"))


@query(duck("files", recursive=True) + """, li AS (SELECT path, i, l[i] || CASE WHEN i < len(l) THEN chr(10) ELSE '' END AS line FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, string_split(text, chr(10)) AS l FROM files WHERE text <> '')) WHERE i < len(l) OR l[i] <> ''),
w AS (SELECT path, 1::BIGINT AS i, 1::BIGINT AS start, length(line) AS size FROM li WHERE i = 1
  UNION ALL SELECT w.path, w.i + 1, CASE WHEN w.size + length(line) > 12000 THEN w.i + 1 ELSE w.start END, CASE WHEN w.size + length(line) > 12000 THEN length(line) ELSE w.size + length(line) END FROM w JOIN li ON li.path = w.path AND li.i = w.i + 1),
c AS (SELECT w.path, start, max(w.i) AS stop, string_agg(line, '' ORDER BY w.i) AS content FROM w JOIN li ON li.path = w.path AND li.i = w.i GROUP BY w.path, start),
h AS (SELECT *, 'file:' || path || ':' || start || ':' || stop AS head FROM c)
SELECT head || ':' || substr(sha256(head || '::'), 1, 16) AS id, path, start::INT AS start_line, stop::INT AS end_line, length(content)::INT AS char_count, sha256(content) AS content FROM h""")
def file_chunks(spark, d):
    return chunks.file_chunks(view(spark, d, "files")).select("id", "path", "start_line", "end_line", "char_count", F.sha2("content", 256).alias("content"))


@query(FILES + " SELECT path, count(*) FILTER (l <> '' OR i < n)::INT AS n_lines, length(max(text)) AS n_chars FROM (SELECT path, text, l[i] AS l, i, len(l) AS n FROM (SELECT path, text, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT path, text, string_split(text, chr(10)) AS l FROM files WHERE text <> ''))) GROUP BY path")
def chunk_cover(spark, d):
    c = chunks.file_chunks(view(spark, d, "files"))
    return c.groupBy("path").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).cast("int").alias("n_lines"), F.sum("char_count").alias("n_chars"))


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    f = view(spark, d, "files")
    nodes = view(spark, d, "nodes").withColumns({"sym_ord": F.col("node_ord").cast("int"), "inherits": F.array().cast("array<string>")})
    return knowledge.nodes_and_edges("repo", repository.directories(f), f, nodes, view(spark, d, "edges"), _resolved(spark, d))


GRAPH = RESOLVED.replace("WITH ", EDGES + ", ", 1) + """, dirs AS (SELECT DISTINCT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/source']) AS path FROM files),
kn AS (SELECT 'repository:repo' AS id, 'ForgeNode,Repository' AS labels UNION SELECT 'directory:' || path, 'ForgeNode,Directory' FROM dirs UNION SELECT 'file:' || path, 'ForgeNode,File' FROM files
  UNION SELECT 'symbol:' || path || ':function:' || name, 'ForgeNode,Symbol,Function' FROM nodes UNION SELECT 'external:dependency:' || import_name, 'ForgeNode,ExternalDependency' FROM edges WHERE target IS NULL
  UNION SELECT 'external:call:' || callee, 'ForgeNode,ExternalCall' FROM r WHERE target IS NULL AND source IS NOT NULL),
ids AS (SELECT DISTINCT id AS qid, 'symbol:' || path || ':function:' || name AS sid FROM nodes),
ke AS (SELECT CASE WHEN contains(path, '/') THEN 'directory:' || split_part(path, '/', 1) ELSE 'repository:repo' END AS source, 'CONTAINS' AS relationship, 'directory:' || path AS target FROM dirs
  UNION SELECT 'directory:' || split_part(path, '/', 1) || '/source', 'CONTAINS', 'file:' || path FROM files UNION SELECT 'file:' || path, 'DEFINES', 'symbol:' || path || ':function:' || name FROM nodes
  UNION SELECT 'file:' || source, 'IMPORTS', coalesce('file:' || target, 'external:dependency:' || import_name) FROM edges
  UNION SELECT a.sid, 'CALLS', coalesce(b.sid, 'external:call:' || callee) FROM r JOIN ids a ON a.qid = r.source LEFT JOIN ids b ON b.qid = r.target)"""


@query(GRAPH + " SELECT id, labels FROM kn")
def kg_nodes(spark, d):
    return _graph(spark, d)[0].select("id", F.array_join("labels", ",").alias("labels"))


@query(GRAPH + " SELECT source, relationship, target FROM ke")
def kg_edges(spark, d):
    return _graph(spark, d)[1].select("source", "relationship", "target")


@query(GRAPH + """ SELECT (SELECT count(*) FROM kn) AS node_count, (SELECT count(*) FROM files) AS file_count, (SELECT count(*) FROM kn WHERE contains(labels, ',Symbol,')) AS symbol_count,
  count(*) AS edge_count, count(*) FILTER (relationship = 'IMPORTS') AS dependency_edge_count, count(*) FILTER (relationship = 'CALLS') AS call_edge_count FROM ke""")
def kg_stats(spark, d):
    return knowledge.graph_stats(*_graph(spark, d))


PROPERTIES = GRAPH + """, j AS (
  SELECT 'repository:repo' AS key, '{"id":"repository:repo","path":"repo","name":"repo"}' AS properties
  UNION SELECT 'directory:' || path, '{"id":"directory:' || path || '","path":"' || path || '","name":"' || regexp_replace(path, '^.*/', '') || '","repository_path":"repo"}' FROM dirs
  UNION SELECT 'file:' || path, '{"id":"file:' || path || '","path":"' || path || '","name":"' || regexp_replace(path, '^.*/', '') || '","language":"' || language || '","repository_path":"repo"}' FROM files
  UNION SELECT 'symbol:' || path || ':function:' || name, '{"id":"symbol:' || path || ':function:' || name || '","path":"' || path || '","name":"' || name || '","kind":"function","line":1,"repository_path":"repo"}' FROM nodes
  UNION SELECT 'external:dependency:' || import_name, '{"id":"external:dependency:' || import_name || '","name":"' || import_name || '","repository_path":"repo"}' FROM edges WHERE target IS NULL
  UNION SELECT 'external:call:' || callee, '{"id":"external:call:' || callee || '","name":"' || callee || '","repository_path":"repo"}' FROM r WHERE target IS NULL AND source IS NOT NULL
  UNION SELECT source || ' ' || relationship || ' ' || target, '{"repository_path":"repo"}' FROM ke WHERE relationship IN ('CONTAINS', 'DEFINES')
  UNION SELECT 'file:' || source || ' IMPORTS ' || coalesce('file:' || target, 'external:dependency:' || import_name), '{"repository_path":"repo","name":"' || import_name || '"}' FROM edges
  UNION SELECT a.sid || ' CALLS ' || coalesce(b.sid, 'external:call:' || callee), '{"repository_path":"repo","name":"' || callee || '","recursive":' || CASE WHEN caller = callee THEN 'true' ELSE 'false' END || '}' FROM r JOIN ids a ON a.qid = r.source LEFT JOIN ids b ON b.qid = r.target)"""


@query(PROPERTIES + " SELECT key, properties FROM j")
def kg_properties(spark, d):
    nodes, edges = _graph(spark, d)
    return nodes.select(F.col("id").alias("key"), "properties").unionByName(edges.select(F.concat_ws(" ", "source", "relationship", "target").alias("key"), "properties"))


KEY = duck("files", "edges", "symbols") + """, k AS (SELECT path, language, size_bytes, (SELECT count(*) FROM symbols s WHERE s.path = f.path AND kind <> 'import') AS symbol_count,
  (SELECT count(*) FROM edges e WHERE e.source = f.path AND e.target IS NOT NULL) AS dependency_count, (SELECT count(*) FROM edges e WHERE e.target = f.path) AS dependent_count FROM files f)"""


@query(KEY + " SELECT * FROM k ORDER BY symbol_count + dependency_count + dependent_count DESC, path LIMIT 8")
def key_files(spark, d):
    return reports.key_files(view(spark, d, "files"), view(spark, d, "symbols"), view(spark, d, "edges"))


@query(duck("files", "symbols") + " SELECT name, kind, path, line::INT AS line FROM symbols WHERE kind <> 'import' ORDER BY kind NOT IN ('class', 'interface'), path, line, name LIMIT 8")
def key_symbols(spark, d):
    return reports.key_symbols(view(spark, d, "symbols")).drop("parent")


@query(EDGES + " SELECT source, target FROM edges WHERE target IS NOT NULL ORDER BY edge_ord LIMIT 12")
def diagram_edges(spark, d):
    return reports.first_edges(view(spark, d, "edges")).select("source", "target")


@query("SELECT conv_id::VARCHAR AS session_id, count(*) AS message_count, count(*) FILTER (role = 'user') AS question_count, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id")
def session_history(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"), F.col("turn").alias("created_at"))
    return memory.sessions(c).drop("updated_at")


@query("SELECT user_id AS import_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS event_count FROM events GROUP BY user_id")
def import_progress(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("import_id"), F.col("event_type").alias("stage"), F.lit("").alias("message"), F.struct("ts", "event_id").alias("created_at"))
    return memory.latest_events(e).select("import_id", "status", "event_count")


# event by event: the stage before, a day of silence, and what may follow
MACHINE = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'validating' WHEN 'click' THEN 'cloning' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS stage,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s AS (SELECT user_id, 0::BIGINT AS rn, 'none' AS stage, NULL::TIMESTAMP AS since, 0 AS attempt, 0 AS accepted, 0 AS rejected, 0 AS stuck FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, rn, CASE WHEN ok THEN named ELSE stage END, CASE WHEN ok THEN ts ELSE since END, attempt + (ok AND named = 'queued')::INT, accepted + ok::INT, rejected + (NOT ok)::INT, stuck
  FROM (SELECT *, (named = 'queued' AND stage IN ('none', 'completed', 'failed')) OR (named = 'validating' AND stage = 'queued') OR (named = 'cloning' AND stage = 'validating') OR (named = 'completed' AND stage = 'cloning') OR (named = 'failed' AND stage IN ('queued', 'validating', 'cloning')) AS ok
    FROM (SELECT s.user_id, e.rn, e.ts, e.stage AS named, s.attempt, s.accepted, s.rejected, CASE WHEN s.stage IN ('queued', 'validating', 'cloning') AND s.since + INTERVAL 1 DAY <= e.ts THEN 'failed' ELSE s.stage END AS stage,
        CASE WHEN s.stage IN ('queued', 'validating', 'cloning') AND s.since + INTERVAL 1 DAY <= e.ts THEN s.since + INTERVAL 1 DAY ELSE s.since END AS since,
        s.stuck + (s.stage IN ('queued', 'validating', 'cloning') AND s.since + INTERVAL 1 DAY <= e.ts)::INT AS stuck FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1) x) y),
z AS (SELECT s.*, s.stage IN ('queued', 'validating', 'cloning') AND s.since + INTERVAL 1 DAY < (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) AS over FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1)
"""


@query(MACHINE + "SELECT user_id AS import_id, CASE WHEN over THEN 'failed' WHEN stage <> 'none' THEN stage END AS status, attempt AS attempts, accepted::BIGINT AS accepted, rejected::BIGINT AS rejected, (stuck + over::INT)::BIGINT AS stuck FROM z")
def import_states(spark, d):
    """Each user's events as an import's, judged by a stream that reads what is there."""
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    stages = {"signup": "queued", "view": "validating", "click": "cloning", "purchase": "completed"}
    stage = F.lit("failed")
    for event, name in stages.items():
        stage = F.when(F.col("event_type") == event, name).otherwise(stage)
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").select(F.col("user_id").alias("import_id"), "event_id", F.col("ts").alias("at"), stage.alias("stage"))
    with passing_folder(spark) as folder:
        return settle(machine.imports(machine.run_available(spark, events, folder)))


@query("SELECT page_id, (SELECT count(*) FROM (SELECT unnest(string_split(html, '<')) AS x) WHERE starts_with(x, '/'))::INT AS changed FROM pages")
def diff_count(spark, d):
    """Diff lines of pages, each closing tag made a removed line."""
    text = F.regexp_replace(F.regexp_replace(F.col("html"), "[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029+-]", " "), "</", "\n-/")
    return table(spark, d, "pages").select("page_id", parse.changed_lines(text).alias("changed"))


# --- over the source files of the view ``code``

NAME = "([A-Za-z_][A-Za-z0-9_]*)"
CODE = duck("code") + r""", l AS (SELECT path, i AS line, x[i] AS s FROM (SELECT path, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT path, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS x FROM code))),
k AS (SELECT *, length(s) - length(ltrim(s, ' ')) AS indent, ends_with(path, '.py') AS py FROM l WHERE NOT regexp_matches(s, '^\s*(#|//)'))"""
OWNER = """(SELECT i.path, i.line, arg_max(j.name, j.line) AS name FROM k i JOIN {scopes} j ON j.path = i.path AND j.line < i.line
  WHERE NOT EXISTS (SELECT 1 FROM k m WHERE m.path = i.path AND m.line > j.line AND m.line <= i.line AND m.indent <= j.indent) GROUP BY i.path, i.line)"""
PARSED = CODE + r""", d AS (SELECT *,
  CASE WHEN py THEN regexp_extract(s, '^\s*class\s+NAME', 1) ELSE regexp_extract(s, '^\s*(?:export\s+)?class\s+NAME', 1) END AS c,
  CASE WHEN py THEN regexp_extract(s, '^\s*(?:async\s+)?def\s+NAME', 1) ELSE regexp_extract(s, '^\s*(?:export\s+)?(?:async\s+)?function\s+NAME', 1) END AS f,
  CASE WHEN py THEN regexp_extract(s, '^\s*NAME\s*=', 1) ELSE regexp_extract(s, '^\s*(?:const|let|var)\s+NAME\s*=', 1) END AS v,
  regexp_extract(s, '^\s*(?:from\s+([\w.]+)\s+)?import\s+([\w*.,\s]+)', 2) AS pn, nullif(regexp_extract(s, '^\s*(?:from\s+([\w.]+)\s+)?import\s+([\w*.,\s]+)', 1), '') AS ps,
  regexp_extract(s, '^\s*import\s+(.+?)\s+from\s+["'']([^"'']+)["'']', 1) AS jn, regexp_extract(s, '^\s*import\s+(.+?)\s+from\s+["'']([^"'']+)["'']', 2) AS js FROM k),
sc AS (SELECT path, line, indent, CASE WHEN c <> '' THEN c ELSE f END AS name FROM d WHERE c <> '' OR f <> ''), o AS OWNER1,
y AS (SELECT path, line, 'import' AS kind, CASE WHEN pn <> '' THEN trim(split_part(trim(split_part(pn, ',', 1)), ' as ', 1)) ELSE jn END AS name, NULL AS parent, CASE WHEN pn <> '' THEN ps ELSE js END AS source, s FROM d WHERE pn <> '' OR jn <> ''
  UNION ALL SELECT path, line, 'class', c, NULL, NULL, s FROM d WHERE c <> ''
  UNION ALL SELECT d.path, d.line, CASE WHEN o.name IS NULL THEN 'function' ELSE 'method' END, f, o.name, NULL, s FROM d LEFT JOIN o ON o.path = d.path AND o.line = d.line WHERE c = '' AND f <> ''
  UNION ALL SELECT d.path, d.line, 'variable', v, o.name, NULL, s FROM d LEFT JOIN o ON o.path = d.path AND o.line = d.line WHERE c = '' AND f = '' AND v <> ''),
sd AS (SELECT path, line, indent, regexp_extract(s, '^\s*(?:export\s+)?(?:async\s+)?(?:def|function)\s+NAME', 1) AS name FROM k WHERE regexp_matches(s, '^\s*(?:export\s+)?(?:async\s+)?(?:def|function)\s+NAME')), o2 AS OWNER2,
z AS (SELECT path, line, unnest(regexp_extract_all(s, '\bNAME\s*\(', 1)) AS callee FROM k WHERE NOT regexp_matches(s, '^\s*(?:export\s+)?(?:async\s+)?(?:def|function)\s+')),
called AS (SELECT z.path, z.line, o2.name AS caller, callee FROM z LEFT JOIN o2 ON o2.path = z.path AND o2.line = z.line WHERE callee NOT IN ('class', 'def', 'function', 'if', 'for', 'while', 'import', 'from')),
base AS (SELECT path AS source, name AS import_name, source AS import_source, line, CASE WHEN source = '.' THEN regexp_replace(path, '/[^/]*$', '')
  WHEN starts_with(source, './') THEN regexp_replace(path, '/[^/]*$', '') || substr(source, 2) ELSE replace(coalesce(source, name), '.', '/') END AS base FROM y WHERE kind = 'import'),
dep AS (SELECT b.source, f.path AS target, import_name, import_source, line FROM base b LEFT JOIN code f ON f.path IN (base || '.py', base || '.ts', base || '/__init__.py')),
node AS (SELECT path || ':' || coalesce(parent || '.', '') || name AS id, name, kind, path, line, parent FROM y WHERE kind IN ('function', 'method')),
here AS (SELECT path, name, arg_max(id, line) AS id FROM node GROUP BY path, name), single AS (SELECT name, min(id) AS id FROM node GROUP BY name HAVING count(*) = 1),
call AS (SELECT c.*, a.id AS source, coalesce(b.id, u.id) AS target FROM called c LEFT JOIN here a ON a.path = c.path AND a.name = caller
  LEFT JOIN here b ON b.path = c.path AND b.name = callee LEFT JOIN single u ON u.name = callee)""".replace("OWNER1", OWNER.format(scopes="sc")).replace("OWNER2", OWNER.format(scopes="sd")).replace("NAME", NAME)


def _parsed(spark, d, syntax: bool = False) -> DataFrame:
    return parse.parse(view(spark, d, "code"), syntax)


def _code_edges(spark, d) -> DataFrame:
    return graphs.dependency_edges(parse.symbols_of(_parsed(spark, d)), view(spark, d, "code"))


def _code_calls(spark, d) -> DataFrame:
    parsed = _parsed(spark, d)
    return graphs.resolve_calls(graphs.call_nodes(parse.symbols_of(parsed)), parse.calls_of(parsed))


@query(PARSED + " SELECT path, line::INT AS line, kind, name, parent, source, (instr(s, name) - 1)::INT AS col FROM y")
def code_symbols(spark, d):
    return parse.symbols_of(_parsed(spark, d)).select("path", "line", "kind", "name", "parent", "source", "col")


@query(PARSED + " SELECT path, line::INT AS line, caller, callee, coalesce(caller = callee, false) AS recursive FROM called")
def code_calls(spark, d):
    return parse.calls_of(_parsed(spark, d)).select("path", "line", "caller", "callee", "recursive")


@query(PARSED + " SELECT source, target, import_name, import_source, CASE WHEN target IS NULL THEN 'external' ELSE 'internal' END AS dependency_type FROM dep")
def code_dependencies(spark, d):
    return _code_edges(spark, d).drop("edge_ord")


@query(PARSED + " SELECT id, name, kind, path, line::INT AS line, parent FROM node")
def code_call_nodes(spark, d):
    return graphs.call_nodes(parse.symbols_of(_parsed(spark, d))).drop("node_ord")


@query(PARSED + " SELECT path, line::INT AS line, caller, callee, source, target FROM call")
def code_call_graph(spark, d):
    return _code_calls(spark, d).select("path", "line", "caller", "callee", "source", "target")


# spans by indents: a block ends before the next line of its own indent or less, without empty lines
SYNTAX = CODE + r""", q AS (SELECT * FROM k WHERE py AND ltrim(s) <> '' AND path NOT IN (SELECT path FROM l WHERE starts_with(s, 'def broken('))),
h AS (SELECT *, CASE WHEN regexp_matches(s, '^\s*class ') THEN 'class' ELSE 'function' END AS kind, regexp_extract(s, '^\s*(?:class|def)\s+NAME', 1) AS name FROM q WHERE regexp_matches(s, '^\s*(class|def)\s')),
e AS (SELECT h.path, h.line, h.kind, h.name, h.indent, h.s, (SELECT max(m.line) FROM q m WHERE m.path = h.path AND m.line < coalesce((SELECT min(x.line) FROM q x WHERE x.path = h.path AND x.line > h.line AND x.indent <= h.indent), 1000000)) AS end_line FROM h),
w AS (SELECT e.*, (SELECT arg_max(p.name, p.line) FROM e p WHERE p.path = e.path AND p.line < e.line AND p.end_line >= e.end_line) AS parent FROM e),
t AS (SELECT path, line, end_line, CASE WHEN kind = 'class' THEN 'class' WHEN parent IS NULL THEN 'function' ELSE 'method' END AS kind, name, parent, NULL AS source, CASE WHEN kind = 'class' THEN 'Base,m,Mixin' ELSE '' END AS inherits FROM w
  UNION ALL SELECT path, line, line, 'variable', regexp_extract(s, '^NAME = ', 1), NULL, NULL, '' FROM q WHERE regexp_matches(s, '^NAME = ')
  UNION ALL SELECT path, line, line, 'import', regexp_extract(s, 'import ([A-Za-z0-9_.]+)', 1), NULL, nullif(regexp_extract(s, '^from ([A-Za-z0-9_.]+) ', 1), ''), '' FROM q WHERE regexp_matches(s, '^(from|import) '))""".replace("NAME", NAME)


@query(SYNTAX + " SELECT path, line::INT AS line, end_line::INT AS end_line, kind, name, parent, source, inherits FROM t")
def syntax_symbols(spark, d):
    parsed = _parsed(spark, d, syntax=True).filter("path LIKE '%.py' AND NOT has_error")
    return parse.symbols_of(parsed).select("path", "line", "end_line", "kind", "name", "parent", "source", F.array_join("inherits", ",").alias("inherits"))


@query(SYNTAX + r""", z AS (SELECT path, line, unnest(regexp_extract_all(s, 'NAME\(', 1)) AS callee FROM q WHERE NOT regexp_matches(s, '^\s*(class|def)\s'))
  SELECT z.path, z.line::INT AS line, callee, (SELECT arg_max(p.name, p.line) FROM e p WHERE p.path = z.path AND p.kind = 'function' AND p.line < z.line AND p.end_line >= z.line) AS caller FROM z""".replace("NAME", NAME))
def syntax_calls(spark, d):
    parsed = _parsed(spark, d, syntax=True).filter("path LIKE '%.py' AND NOT has_error")
    return parse.calls_of(parsed).select("path", "line", "callee", "caller")


@query(duck("code") + " SELECT path FROM code WHERE ends_with(path, '.py') AND contains(text, 'def broken(:')")
def parse_errors(spark, d):
    return _parsed(spark, d, syntax=True).filter("has_error").select("path")


# every match of every pattern: texts cut at the matches, and the line ends before each counted
def _rule_sql(k: int, kind: str, category: str, severity: str, pattern: str, flags: int) -> str:
    more = ""
    if "(?!" in pattern:  # not in this dialect: the rest of the line is looked at afterwards
        pattern, more = pattern.replace("(?!.*Loader)", "[^\\n]*"), " WHERE NOT contains(m[i], 'Loader')"
    literal = ("(?m)" * bool(flags) + pattern).replace("'", "''")
    return f"""SELECT path, text, {k} AS rule_ord, '{kind}' AS kind, '{category}' AS category, '{severity}' AS severity, length(array_to_string(g[1:i], '') || array_to_string(m[1:i - 1], '')) - length(replace(array_to_string(g[1:i], '') || array_to_string(m[1:i - 1], ''), chr(10), '')) + 1 AS line
  FROM (SELECT path, text, g, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT path, text, string_split_regex(text, '{literal}') AS g, regexp_extract_all(text, '{literal}') AS m FROM seen)){more}"""


CONTRIBUTION = duck("code", "smells") + ", seen AS (SELECT path, text FROM code UNION ALL SELECT path, text FROM smells), hits AS (" + " UNION ALL ".join(_rule_sql(k, *rule) for k, rule in enumerate(findings.PATTERNS)) + r"""),
g AS (SELECT kind, category, severity, path, line, trim(string_split(text, chr(10))[line]) AS evidence, rule_ord FROM hits
  UNION ALL SELECT 'missing_docs', 'missing_docs', 'low', path, 1, '', 26 FROM seen WHERE ends_with(path, '.py') AND len(string_split(regexp_replace(text, '\n$', ''), chr(10))) > 20 AND NOT contains(text, repeat(chr(34), 3)) AND NOT contains(text, repeat(chr(39), 3)))"""


def _searched(spark, d) -> DataFrame:
    return view(spark, d, "code").select("path", "text", "size_bytes").unionByName(view(spark, d, "smells").select("path", "text", "size_bytes"))


@query(CONTRIBUTION + " SELECT kind, category, severity, path, line::INT AS line, evidence FROM g")
def contribution_findings(spark, d):
    return findings.contribution_findings(_searched(spark, d)).drop("rule_ord")


@query(CONTRIBUTION + """, t AS (SELECT * FROM (SELECT DISTINCT * FROM g) WHERE contains(replace(category, '_', ' '), 'eval') OR contains(path, 'm1') ORDER BY """ + SEVERITY + """, path, line, rule_ord LIMIT 50),
n AS (SELECT count(*) AS finding_count, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM t)
SELECT finding_count, critical, high, medium, low, greatest(5, least(95, 95 - critical * 15 - high * 8 - medium * 3 - low))::INT AS score,
  least(0.92, 0.5 + least((SELECT count(*) FROM seen WHERE strlen(text) <= 512000), 10) * 0.04)::DOUBLE AS confidence FROM n""")
def contribution_score(spark, d):
    """Findings about eval and those of files with m1 in their path, the first 50 by severity."""
    files = _searched(spark, d)
    found = findings.contribution_findings(files)
    both = findings.focused(found, "eval").unionByName(findings.focused(found, "M1")).distinct()
    read = F.lit(findings.read_files(files).count())
    return findings.contribution_score(findings.first_contributions(both), read).drop(*[f"{k}_count" for k in findings.KINDS])


# --- files, names and texts


@query(FILES + ", b AS (SELECT *, doc_id % 3 = 0 AS bad FROM files) SELECT path, CASE WHEN NOT bad THEN sha256(text) END AS strict, sha256(text || CASE WHEN bad THEN chr(65533) ELSE '' END) AS replaced, sha256(text) AS ignored FROM b")
def text_modes(spark, d):
    bad = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("80")))).otherwise(F.col("text").cast("binary"))
    f = view(spark, d, "files").select("path", bad.alias("content"))
    for mode, name in (("strict", "strict"), ("replace", "replaced"), ("ignore", "ignored")):
        f = repository.read_text(f, mode).withColumn(name, F.sha2("text", 256))
    return f.select("path", "strict", "replaced", "ignored")


@query(FILES + " SELECT path, extension, language, size_bytes, sha256(text) AS sha256 FROM files")
def file_hashes(spark, d):
    f = view(spark, d, "files").select("path", F.lit(False).alias("is_dir"), F.col("text").cast("binary").alias("content"))
    return repository.describe(f).select("path", "extension", "language", F.octet_length("content").cast("long").alias("size_bytes"), "sha256")


NAMES = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'my repo ' || doc_id || '!.zip' WHEN 1 THEN '..hid-' || doc_id || '-.zip' WHEN 2 THEN '...' WHEN 3 THEN 'up/lo ad' || doc_id || '.tar.gz' ELSE 'a+b_' || doc_id END AS name FROM documents"


@query("WITH n AS (" + NAMES + r"""), b AS (SELECT doc_id, regexp_replace(name, '^.*/', '') AS b FROM n), s AS (SELECT doc_id, regexp_replace(regexp_replace(b, '^(.+)\.[^.]+$', '\1'), '[^A-Za-z0-9_.-]+', '-', 'g') AS s FROM b)
SELECT doc_id, coalesce(nullif(regexp_replace(s, '^[.-]+|[.-]+$', '', 'g'), ''), 'repository') AS name FROM s""")
def safe_names(spark, d):
    return spark.sql(NAMES.replace("FROM documents", "FROM {documents}"), documents=table(spark, d, "documents")).select("doc_id", repository.safe_name(F.col("name")).alias("name"))


URLS = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'https://github.com/o' || doc_id || '/r.x' WHEN 1 THEN 'https://github.com/o/r' || doc_id || '.git' WHEN 2 THEN 'http://github.com/o/r' WHEN 3 THEN 'https://example.com/o/r' WHEN 4 THEN 'https://github.com/o/r/x' ELSE 'https://github.com/o/r' || doc_id || '/' END AS url FROM documents"


@query("WITH u AS (" + URLS + ") SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN url || '.git' WHEN 1 THEN url WHEN 5 THEN 'https://github.com/o/r' || doc_id || '.git' END AS clone_url FROM u")
def github_urls(spark, d):
    return spark.sql(URLS.replace("FROM documents", "FROM {documents}"), documents=table(spark, d, "documents")).select("doc_id", repository.github_url(F.col("url")).alias("clone_url"))


@query(FILES + """, p AS (SELECT '' AS path, path AS f, '' AS x FROM files UNION ALL SELECT split_part(path, '/', 1), path, '' FROM files UNION ALL SELECT split_part(path, '/', 1) || '/source', path, path FROM files)
SELECT path, CASE WHEN path <> '' THEN CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END END AS parent, CASE WHEN contains(path, '/') THEN 'source' ELSE path END AS name,
  CASE WHEN path = '' THEN 0 WHEN contains(path, '/') THEN 2 ELSE 1 END AS depth, count(*) FILTER (x <> '') AS file_count, count(*) AS total_file_count FROM p GROUP BY path""")
def explorer_tree(spark, d):
    return reports.tree(view(spark, d, "files"))


EXEMPT = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'src/app.py' WHEN 1 THEN 'src/Tests/x' || doc_id || '.py' WHEN 2 THEN 'src/test_x.py' WHEN 3 THEN 'src/a.test.ts' WHEN 4 THEN 'src/a.spec.ts' WHEN 5 THEN 'lib/mod.rs'
  WHEN 6 THEN 'lib/d' || doc_id || '.py' WHEN 7 THEN '__tests__/q.js' ELSE 'lib/testing.py' END AS path FROM documents"""


@query("WITH e AS (" + EXEMPT + ") SELECT doc_id, path, doc_id % 9 NOT IN (6, 8) AS exempt FROM e")
def exemptions(spark, d):
    e = spark.sql(EXEMPT.replace("FROM documents", "FROM {documents}"), documents=table(spark, d, "documents"))
    return e.select("doc_id", "path", findings.exempt(F.col("path")).alias("exempt"))


@query(RESOLVED.replace("WITH ", EDGES + ", ", 1) + """, f AS (SELECT path FROM files WHERE path NOT IN (SELECT target FROM edges WHERE target IS NOT NULL) AND split_part(path, '/', 1) <> 'tests'),
c AS (SELECT id FROM nodes WHERE id NOT IN (SELECT target FROM r WHERE target IS NOT NULL))
SELECT (SELECT count(*) FROM files) AS file_count, (SELECT count(*) FROM nodes) AS callable_count, (SELECT count(*) FROM f) + (SELECT count(*) FROM c) AS finding_count, (SELECT count(*) FROM f) AS unused_file_count, (SELECT count(*) FROM c) AS unused_callable_count""")
def dead_stats(spark, d):
    files, nodes = view(spark, d, "files"), view(spark, d, "nodes")
    dead = findings.dead_files(files, view(spark, d, "edges")).unionByName(findings.dead_callables(nodes, _resolved(spark, d)), allowMissingColumns=True)
    return findings.dead_stats(files, nodes, dead)


# --- stack traces


@query(duck("files", "traces") + """ SELECT doc_id AS trace_id, CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' WHEN 3 THEN 'go' ELSE 'unknown' END AS language,
  CASE doc_id % 5 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'TypeError' WHEN 2 THEN 'IOException' WHEN 3 THEN 'panic' END AS error_type, CASE doc_id % 5 WHEN 0 THEN 'bad ' || doc_id WHEN 1 THEN 'no ' || doc_id WHEN 2 THEN 'x' WHEN 3 THEN 'boom ' || doc_id END AS message,
  CASE doc_id % 5 WHEN 2 THEN 1 WHEN 4 THEN 0 ELSE 2 END AS n_frames, CASE doc_id % 5 WHEN 0 THEN '/srv/app/' || path || '|' || CASE WHEN doc_id % 10 = 0 THEN 'webpack://lib//./x.py' WHEN doc_id % 3 = 0 THEN 'C:' || chr(92) || 'lib' || chr(92) || 'x.py' ELSE '//lib/x.py' END WHEN 1 THEN '/srv/' || path WHEN 2 THEN 'A' || doc_id || '.java' WHEN 3 THEN path || '.go|main.go' ELSE '' END AS files FROM files""")
def stack_traces(spark, d):
    t = parse.parse_traces(view(spark, d, "traces"))
    return t.select("trace_id", "language", "error_type", "message", F.size("frames").alias("n_frames"), F.array_join("files", "|").alias("files"))


@query(duck("files") + """ SELECT doc_id AS trace_id, CASE WHEN doc_id % 5 < 2 THEN path ELSE (SELECT path FROM files WHERE doc_id = 3) END AS path, CASE WHEN doc_id % 5 < 2 THEN (doc_id % 90 + 1)::INT END AS line,
  CASE WHEN doc_id % 5 >= 2 THEN 0.5 WHEN doc_id % 10 = 3 OR (doc_id % 5 < 2 AND doc_id % 10 = 3) THEN 0.9 ELSE 0.85 END::DOUBLE AS score FROM files""")
def root_causes(spark, d):
    files, traces = view(spark, d, "files"), view(spark, d, "traces")
    t = parse.parse_traces(traces).select("trace_id", "language", F.posexplode("frames").alias("pos", "f")).select("trace_id", "language", "pos", F.col("f.file_path").alias("query"), F.col("f.line").alias("line"))
    frames = t.join(impact.match_files(t, files), "query", "left")
    return impact.root_cause(frames, files.filter("doc_id % 10 = 3").select(F.col("doc_id").alias("pos"), "path"), traces)


# --- reviews of a change of three files, and of a hundredth


@query(FILES + """, q AS (SELECT doc_id * 4 AS pos, path FROM files UNION ALL SELECT doc_id * 4 + 2, 'lib/new' || doc_id || '.py' FROM files) SELECT pos, path FROM q""")
def changed_paths(spark, d):
    names = F.array(F.concat(F.lit("./"), "path"), F.concat(F.lit("/srv/app/"), "path"), F.concat(F.lit(" ./lib/new"), "doc_id", F.lit(".py ")), F.lit("  "))
    q = view(spark, d, "files").select("doc_id", F.posexplode(names).alias("k", "query")).select((F.col("doc_id") * 4 + F.col("k")).alias("pos"), "query")
    return review.changed_paths(q, view(spark, d, "files"))


FEW, MANY = "doc_id IN (3, 13, 23)", "doc_id % 100 = 3"
VIOLATIONS = LAYERED.removeprefix(EDGES)


def _changed(where: str) -> str:
    return IMPACT.removeprefix(EDGES).replace("doc_id % 10 = 3", where)


PR = DEBT + VIOLATIONS + "{changed}" + """, imp AS (SELECT path FROM every ORDER BY score DESC, path LIMIT 12), found AS (
  SELECT 0 AS section, 0 AS nth, 'change_size' AS category, 'medium' AS severity, NULL AS path WHERE (SELECT count(*) FROM seed) >= 8
  UNION ALL SELECT 1, 0, 'diff_size', 'high', NULL WHERE {lines} >= 300
  UNION ALL SELECT 2, 0, 'testing', 'medium', NULL WHERE NOT EXISTS (SELECT 1 FROM seed WHERE split_part(path, '/', 1) = 'tests')
  UNION ALL SELECT 3, row_number() OVER (ORDER BY {severity}, path, coalesce(line, 0), rule_ord), 'technical_debt:' || category, severity, path FROM a WHERE path IN (SELECT path FROM seed)
  UNION ALL SELECT 4, row_number() OVER (ORDER BY {severity}, source, target), 'architecture:' || rule_id, severity, source FROM w WHERE source IN (SELECT path FROM imp) OR target IN (SELECT path FROM imp)),
listed AS (SELECT * FROM found ORDER BY section, nth LIMIT 12)"""
POINTS = "CASE severity WHEN 'critical' THEN 35 WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 4 END"
LEVEL = "CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 35 THEN 'medium' ELSE 'low' END"


def _pr_sql(where: str, lines: int) -> str:
    return PR.replace("{changed}", _changed(where).format(a=0.72, b=0.62, s=0.95)).replace("{lines}", str(lines)).replace("{severity}", SEVERITY)


def _pr(spark, d, where: str, lines: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    changed = view(spark, d, "files").filter(where).select(F.col("doc_id").alias("pos"), "path")
    edges = view(spark, d, "edges")
    hit = impact.pr_impact(changed, edges)
    return changed, hit, review.pr_findings(changed, hit, _debt(spark, d)[0], findings.violations(edges), lines)


@query(_pr_sql(FEW, 40) + " SELECT category, severity, path FROM listed")
def pr_findings(spark, d):
    return _pr(spark, d, FEW, 40)[2].select("category", "severity", "path")


@query(_pr_sql(MANY, 450) + """, n AS (SELECT (SELECT count(*) FROM seed) AS changed_file_count, (SELECT count(*) FROM imp) AS impacted_file_count, count(*) AS finding_count, sum(%s) AS points FROM listed),
s AS (SELECT *, least(100, least(changed_file_count * 5, 25) + least(greatest(impacted_file_count - changed_file_count, 0) * 8, 25) + 20 + least(points, 45))::INT AS risk_score FROM n)
SELECT changed_file_count, impacted_file_count, finding_count, risk_score, %s AS risk_level, least(0.92, 0.45 + least(changed_file_count, 5) * 0.07 + least(finding_count, 3) * 0.04)::DOUBLE AS confidence FROM s""" % (POINTS, LEVEL))
def pr_report(spark, d):
    return review.pr_report(*_pr(spark, d, MANY, 450), 450).drop("recommendations", "summary").withColumn("confidence", F.round("confidence", 9))


ARCH = KEY + VIOLATIONS + "{changed}" + """, keys AS (SELECT *, row_number() OVER (ORDER BY symbol_count + dependency_count + dependent_count DESC, path) AS nth FROM k ORDER BY nth LIMIT 8),
imp AS (SELECT path, CASE split_part(path, '/', 1) WHEN 'components' THEN 'ui' WHEN 'api' THEN 'api' WHEN 'services' THEN 'service' WHEN 'repositories' THEN 'persistence' WHEN 'tests' THEN 'test' ELSE 'source' END AS layer
  FROM (SELECT path, CASE WHEN score = 0.96 AND path IN (SELECT path FROM keys) THEN 0.99 ELSE score END AS score FROM every) ORDER BY score DESC, path LIMIT 12),
near AS (SELECT *, row_number() OVER (ORDER BY %s, source, target) AS nth FROM w WHERE source IN (SELECT path FROM imp) OR target IN (SELECT path FROM imp) QUALIFY nth <= 12),
fans AS (SELECT source AS path, 0 AS kind, count(*) AS n FROM edges WHERE target IS NOT NULL AND source IN (SELECT path FROM seed) GROUP BY source UNION ALL SELECT target, 1, count(*) FROM edges WHERE target IN (SELECT path FROM seed) GROUP BY target),
found AS (SELECT 0 AS section, 0 AS nth, 'layer_spread' AS category, 'high' AS severity, NULL AS path WHERE (SELECT count(DISTINCT layer) FROM imp) >= 3
  UNION ALL SELECT 1, nth, 'key_component_changed', 'high', path FROM keys WHERE path IN (SELECT path FROM seed)
  UNION ALL SELECT 2, row_number() OVER (ORDER BY doc_id, kind), CASE WHEN kind = 0 THEN 'high_fan_out' ELSE 'high_fan_in' END, CASE WHEN kind = 0 THEN 'medium' ELSE 'high' END, fans.path FROM fans JOIN files ON files.path = fans.path WHERE n >= 3
  UNION ALL SELECT 3, nth, 'boundary:' || rule_id, severity, source FROM near),
listed AS (SELECT * FROM found ORDER BY section, nth LIMIT 12)""" % SEVERITY


def _arch_sql(where: str) -> str:
    return ARCH.replace("{changed}", _changed(where).format(a=0.74, b=0.66, s=0.96))


def _arch(spark, d, where: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    files, edges = view(spark, d, "files"), view(spark, d, "edges")
    changed = files.filter(where).select(F.col("doc_id").alias("pos"), "path")
    keys = reports.key_files(files, view(spark, d, "symbols"), edges)
    hit = impact.arch_impact(changed, edges, keys)
    near = review.scoped(findings.violations(edges), hit).orderBy(findings.rank(F.col("severity")), "source", "target").limit(review.MAX_ITEMS)
    return changed, hit, review.arch_findings(changed, hit, keys, edges, near), near


@query(_arch_sql(FEW) + " SELECT category, severity, path FROM listed")
def arch_findings(spark, d):
    return _arch(spark, d, FEW)[2].select("category", "severity", "path")


@query(_arch_sql(MANY) + """, n AS (SELECT (SELECT count(*) FROM seed) AS changed_file_count, (SELECT count(*) FROM imp) AS impacted_file_count, (SELECT count(*) FROM near) AS violation_count, count(*) AS finding_count, sum(%s) AS points FROM listed),
s AS (SELECT *, least(100, least(changed_file_count * 6, 24) + least(greatest(impacted_file_count - changed_file_count, 0) * 8, 28) + least(points, 52))::INT AS risk_score FROM n)
SELECT changed_file_count, impacted_file_count, violation_count, finding_count, risk_score, %s AS risk_level,
  least(0.94, 0.5 + least(changed_file_count, 5) * 0.05 + least(finding_count, 4) * 0.04 + least(violation_count, 3) * 0.03)::DOUBLE AS confidence FROM s""" % (POINTS, LEVEL))
def arch_report(spark, d):
    return review.arch_report(*_arch(spark, d, MANY)).drop("recommendations", "summary").withColumn("confidence", F.round("confidence", 9))


# --- summary and chunks


@query(KEY + """, f AS (SELECT 0 AS sec, row_number() OVER (ORDER BY symbol_count + dependency_count + dependent_count DESC, path) AS nth, path FROM k QUALIFY nth <= 8
  UNION ALL SELECT 1, row_number() OVER (ORDER BY kind NOT IN ('class', 'interface'), path, line, name) AS nth, path FROM symbols WHERE kind <> 'import' QUALIFY nth <= 8
  UNION ALL SELECT 2, row_number() OVER (ORDER BY edge_ord) AS nth, source FROM edges QUALIFY nth <= 8)
SELECT path FROM f GROUP BY path ORDER BY min((sec, nth)) LIMIT 8""")
def evidence_paths(spark, d):
    return reports.evidence_paths(view(spark, d, "files"), view(spark, d, "symbols"), view(spark, d, "edges")).select("path")


@query(duck("files", "edges", "symbols", "nodes", "calls") + """ SELECT (SELECT count(*) FROM files) AS file_count, (SELECT count(DISTINCT language) FROM files) AS language_count, (SELECT 2 * count(DISTINCT split_part(path, '/', 1)) FROM files) AS directory_count,
  (SELECT count(*) FROM files) AS parsed_file_count, (SELECT count(*) FROM symbols) AS symbol_count, (SELECT count(*) FROM edges WHERE target IS NOT NULL) AS dependency_count, (SELECT count(*) FROM nodes) AS callable_count,
  (SELECT count(*) FROM calls) AS call_count, (SELECT count(*) FROM embeddings) AS indexed_embedding_count, 0::BIGINT AS skipped_parse_file_count""")
def summary_stats(spark, d):
    f = view(spark, d, "files")
    return reports.summary_stats(f, repository.directories(f), f, view(spark, d, "symbols"), view(spark, d, "edges"), view(spark, d, "nodes"), view(spark, d, "calls"), table(spark, d, "embeddings"))


CHUNK = duck("files", "symbols") + """, x AS (SELECT path, string_split(text, chr(10)) AS x FROM files),
c AS (SELECT s.path, s.line, s.end_line, s.kind, s.name, array_to_string(x[s.line:s.end_line], chr(10)) || CASE WHEN s.end_line < len(x) THEN chr(10) ELSE '' END AS content FROM symbols s JOIN x ON x.path = s.path WHERE kind <> 'import' AND s.line <= len(x)),
h AS (SELECT *, 'symbol:' || path || ':' || line || ':' || end_line AS head FROM c WHERE regexp_matches(content, '\\S')),
i AS (SELECT *, head || ':' || substr(sha256(head || ':' || kind || ':' || name), 1, 16) AS id FROM h)"""


@query(CHUNK + " SELECT id, path, kind AS symbol_kind, name AS symbol_name, length(content)::INT AS char_count, sha256(content) AS content FROM i")
def symbol_chunks(spark, d):
    c = chunks.symbol_chunks(view(spark, d, "files"), view(spark, d, "symbols"))
    return c.select("id", "path", "symbol_kind", "symbol_name", "char_count", F.sha2("content", 256).alias("content"))


@query(CHUNK + ", t AS (SELECT id, lower(content) AS t FROM i), n AS (SELECT id, " + ", ".join(
    "(" + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words) + f") AS {name}" for name, words in (("a", ("auth", "token", "user")), ("b", ("main", "handler", "server")))
) + " FROM t) SELECT id, CASE WHEN a = 0 THEN 0.1 ELSE a END::DOUBLE AS first, CASE WHEN b = 0 THEN 0.1 ELSE b END::DOUBLE AS second FROM n")
def embedded_chunks(spark, d):
    c = chunks.embed(chunks.symbol_chunks(view(spark, d, "files"), view(spark, d, "symbols")))
    return c.select("id", F.col("embedding")[0].alias("first"), F.col("embedding")[1].alias("second"))


@query("""WITH m AS (SELECT conv_id, turn, role, text, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN len(list_intersect(w, ['architecture', 'architectural', 'flow', 'flows', 'depend', 'depends', 'dependency', 'dependencies', 'how'])) > 0 THEN 'architecture' WHEN conv_id % 2 = 0 THEN 'retrieval' ELSE 'summary' END AS mode FROM m""")
def question_modes(spark, d):
    q = table(spark, d, "conversations").filter("role = 'user'")
    return q.select("conv_id", "turn", reports.route_of(F.col("text"), F.col("conv_id") % 2 == 0).alias("mode"))


# --- stores: written twice, read back


@query(FILES + ", d AS (SELECT DISTINCT unnest([split_part(path, '/', 1), split_part(path, '/', 1) || '/source']) AS path FROM files) SELECT path, false AS is_dir, sha256(text) AS sha256 FROM files UNION ALL SELECT path, true, NULL FROM d")
def stored_scan(spark, d):
    f = repository.describe(view(spark, d, "files").select("path", F.lit(False).alias("is_dir"), "size_bytes", F.lit(None).cast("timestamp").alias("modified_at"), F.col("text").cast("binary").alias("content")))
    with passing_folder(spark) as folder:
        for part in (f.filter("path LIKE 'api/%'"), f):  # the second scan replaces the first
            stores.save_scan(part, repository.directories(part), folder, "repo")
        got = stores.load_scan(spark, folder, "repo")
        dirs = got["directories"].select("path", F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("sha256"))
        return settle(got["files"].select("path", F.lit(False).alias("is_dir"), "sha256").unionByName(dirs))


@query(GRAPH + " SELECT source, relationship, target FROM ke WHERE source IN (SELECT id FROM kn WHERE NOT contains(labels, 'External')) AND target IN (SELECT id FROM kn WHERE NOT contains(labels, 'External'))")
def stored_graph(spark, d):
    """Edges whose nodes are both stored, without the external nodes."""
    nodes, edges = _graph(spark, d)
    with passing_folder(spark) as folder:
        stores.save_graph(nodes.filter("NOT exists(labels, x -> x LIKE 'External%')"), edges, folder, "repo", matched=True)
        return settle(stores.load_graph(spark, folder, "repo")[1].select("source", "relationship", "target"))


@query(CHUNK + " SELECT id, path, sha256(content) AS content FROM i")
def stored_vectors(spark, d):
    c = chunks.embed(chunks.symbol_chunks(view(spark, d, "files"), view(spark, d, "symbols")))
    with passing_folder(spark) as folder:
        memory.replace_repository(c, folder, "repo", unique=["id"])
        return settle(stores.load_vectors(spark, folder, "repo").select("id", "path", F.sha2("content", 256).alias("content")))


@query(duck("code") + ", n AS (SELECT path, doc_id, text || CASE WHEN doc_id % 10 = 3 THEN chr(10) || 'more = 1' ELSE '' END AS text FROM code WHERE doc_id % 50 <> 7) SELECT path, sha256(text) AS content, CASE WHEN doc_id % 10 = 3 THEN 2 ELSE 1 END::BIGINT AS version FROM n")
def incremental_index(spark, d):
    """Files indexed, then a tenth of them changed and a fiftieth gone: the version that cut and embedded each."""
    code = view(spark, d, "code").select("doc_id", "path", "language", "text")
    more = code.filter("doc_id % 50 <> 7").withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("\nmore = 1"))).otherwise(F.col("text")))
    make = lambda changed: {"parsed": parse.parse(changed), "vectors": chunks.embed(chunks.file_chunks(changed))}
    with passing_folder(spark) as folder:
        store = snapshots.Snapshots(spark, folder)
        for files in (code, more):
            snapshots.reindex(store, "repo", files.select("path", F.sha2("text", 256).alias("sha256"), "language", "text"), make)
        return settle(snapshots.live(store, "repo", "vectors").select("path", F.sha2("content", 256).alias("content"), F.col("segment").alias("version")))


# --- documents


MERMAID = r"""'n_' || left(coalesce(nullif(regexp_replace(regexp_replace({c}, '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'node'), 80) || '["' || {c} || '"]'"""


DRAWN = lambda c: MERMAID.replace("{c}", c)


@query(RESOLVED.replace("WITH ", KEY + ", ", 1) + """, f AS (SELECT 0 AS sec, row_number() OVER (ORDER BY symbol_count + dependency_count + dependent_count DESC, path) AS nth, path FROM k QUALIFY nth <= 8
  UNION ALL SELECT 1, row_number() OVER (ORDER BY kind NOT IN ('class', 'interface'), path, line, name) AS nth, path FROM symbols WHERE kind <> 'import' QUALIFY nth <= 8
  UNION ALL SELECT 2, row_number() OVER (ORDER BY edge_ord) AS nth, source FROM edges QUALIFY nth <= 8),
ev AS (SELECT path, min((sec, nth)) AS place FROM f GROUP BY path ORDER BY place LIMIT 8),
de AS (SELECT source, target, edge_ord FROM edges WHERE target IS NOT NULL ORDER BY edge_ord LIMIT 12),
ca AS (SELECT * FROM r WHERE source IS NOT NULL AND target IS NOT NULL ORDER BY path, l_orderkey, l_linenumber LIMIT 12)
SELECT 'architecture' AS kind, 'flowchart TD' || chr(10) || '  repo["Parts"]' || chr(10) || string_agg('  repo --> ' || """ + DRAWN("path") + """, chr(10) ORDER BY place) AS code FROM ev
UNION ALL SELECT 'dependency', 'flowchart LR' || chr(10) || string_agg('  ' || """ + DRAWN("source") + " || ' --> ' || " + DRAWN("target") + """, chr(10) ORDER BY edge_ord) FROM de
UNION ALL SELECT 'call', 'flowchart LR' || chr(10) || string_agg('  ' || """ + DRAWN("source") + """ || ' -->|"' || callee || '"| ' || """ + DRAWN("target") + ", chr(10) ORDER BY path, l_orderkey, l_linenumber) FROM ca")
def dependency_diagram(spark, d):
    """All three diagrams of a repository."""
    files, symbols, edges = view(spark, d, "files"), view(spark, d, "symbols"), view(spark, d, "edges")
    return reports.diagram_rows("Parts", reports.evidence_paths(files, symbols, edges), edges, _resolved(spark, d))


ASKED = "len(list_intersect(regexp_extract_all(lower({c}), '[a-z0-9_]+'), ['the', 'core', 'of', 'api'])) > 0"


def _many(n: str, one: str, many: str) -> str:
    return f"({n} || CASE {n} WHEN 1 THEN ' {one}' ELSE ' {many}' END)"


# Key files, key symbols, first edges and counts of the whole repository; the components among the key files and what is said of them.
EXPLAINED = duck("nodes", "calls").replace("WITH ", KEY + ", ", 1) + """, t AS (SELECT *, row_number() OVER (ORDER BY symbol_count + dependency_count + dependent_count DESC, path) AS nth FROM k QUALIFY nth <= 8),
y AS (SELECT *, row_number() OVER (ORDER BY kind NOT IN ('class', 'interface'), path, line, name) AS nth FROM symbols WHERE kind <> 'import' QUALIFY nth <= 8),
m AS (SELECT * FROM t WHERE {path} OR path IN (SELECT path FROM y WHERE {name})), ym AS (SELECT * FROM y WHERE {both}),
c AS (SELECT * FROM (SELECT * FROM m UNION ALL SELECT * FROM t WHERE (SELECT count(*) FROM m) = 0) ORDER BY nth LIMIT 5),
o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY nth) AS own FROM (SELECT * FROM ym UNION ALL SELECT * FROM y WHERE (SELECT count(*) FROM ym) = 0) QUALIFY own <= 3),
held AS (SELECT path, string_agg(name, ', ' ORDER BY own) AS names, string_agg(name, '|' ORDER BY own) AS symbols, string_agg(kind || ' ' || name || ', line ' || line, '|' ORDER BY own) AS evidence FROM o GROUP BY path),
e8 AS (SELECT source, row_number() OVER (ORDER BY edge_ord) AS nth FROM edges QUALIFY nth <= 8),
ev AS (SELECT path, min((sec, nth)) AS place FROM (SELECT 1 AS sec, nth, path FROM t UNION ALL SELECT 2, nth, path FROM y UNION ALL SELECT 3, nth, source FROM e8) GROUP BY path ORDER BY place LIMIT 8),
ep AS (SELECT path, min(place) AS place FROM (SELECT path, (0, nth) AS place FROM c UNION ALL SELECT path, place FROM ev) GROUP BY path ORDER BY place LIMIT 8),
n AS (SELECT (SELECT count(*) FROM files) AS f, (SELECT 2 * count(DISTINCT split_part(path, '/', 1)) FROM files) AS d, (SELECT language FROM files GROUP BY language ORDER BY count(*) DESC, language LIMIT 1) AS most,
  (SELECT count(*) FROM edges WHERE target IS NOT NULL) AS i, (SELECT count(*) FROM edges WHERE target IS NULL) AS x, (SELECT count(*) FROM calls) AS calls,
  (SELECT count(*) FROM embeddings) AS embedded, (SELECT count(*) FROM t) AS keys, (SELECT count(*) FROM y) AS names, (SELECT string_agg(path, '|' ORDER BY place) FROM ep) AS evidence_paths)
SELECT path, dependency_count::BIGINT AS dependencies, dependent_count::BIGINT AS dependents, 0.74::DOUBLE AS confidence,
  concat_ws(', ', language || ' file', CASE WHEN dependent_count > 0 THEN 'imported by ' || {used} END, CASE WHEN dependency_count > 0 THEN 'imports ' || {uses} END, 'holds ' || held.names) || '.' AS role,
  coalesce(symbols, '') AS symbols, coalesce(evidence, '') AS evidence, {f} || ' in ' || {d} || ', mostly ' || most || '.' AS overview,
  coalesce(nullif(concat_ws('|', CASE WHEN i > 0 THEN {i} END, CASE WHEN x > 0 THEN {x} END), ''), 'No file imports another.') AS dependency_flow,
  CASE WHEN calls > 0 THEN {calls} ELSE 'No call was found.' END AS call_flow,
  {keys} || ' and ' || {names} || '.' || CASE WHEN embedded = 0 THEN '|Nothing is embedded yet.' ELSE '' END AS observations, evidence_paths
FROM c LEFT JOIN held USING (path) CROSS JOIN n""".format(
    path=ASKED.format(c="path"), name=ASKED.format(c="name"), both=ASKED.format(c="name || ' ' || path"), used=_many("dependent_count", "file", "files"), uses=_many("dependency_count", "file", "files"),
    f=_many("f", "file", "files"), d=_many("d", "directory", "directories"), i=_many("i", "internal dependency", "internal dependencies"), x=_many("x", "external dependency", "external dependencies"),
    calls=_many("calls", "call site", "call sites"), keys=_many("keys", "key file", "key files"), names=_many("n.names", "key symbol", "key symbols"),
)


@query(EXPLAINED)
def explained_components(spark, d):
    """The whole explanation with a focus: components, and flows of dependencies and calls."""
    f, symbols, edges = view(spark, d, "files"), view(spark, d, "symbols"), view(spark, d, "edges")
    told = reports.explained(f, repository.directories(f), symbols, edges, view(spark, d, "calls"), f, view(spark, d, "nodes"), table(spark, d, "embeddings"), "the core of the API")
    lists = ("symbols", "evidence", "dependency_flow", "call_flow", "observations", "evidence_paths")
    return told.drop("pos").withColumns({c: F.array_join(c, "|") for c in lists})


@query(duck("files") + """, r AS (SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN path || ':' || (doc_id % 90 + 1) ELSE (SELECT path FROM files WHERE doc_id = 3) END AS place, CASE doc_id % 5 WHEN 0 THEN 'bad ' || doc_id WHEN 1 THEN 'no ' || doc_id WHEN 2 THEN 'x' WHEN 3 THEN 'boom ' || doc_id END AS message FROM files)
SELECT doc_id AS trace_id, 'Begin at ' || place || '.' || coalesce('|Reproduce: ' || message, '') AS advice FROM r""")
def bug_advice(spark, d):
    said = parse.parse_traces(view(spark, d, "traces")).select("trace_id", "message")
    r = root_causes(spark, d).join(said, "trace_id")
    return r.select("trace_id", F.array_join(review.bug_advice(F.col("path"), F.col("line"), F.col("message"), F.lit(0)), "|").alias("advice"))


SETUP = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'package.json' WHEN 1 THEN 'src/Makefile' WHEN 2 THEN 'go.mod' ELSE 'Makefile' END AS path FROM documents"


@query("WITH f AS (" + SETUP + ") SELECT DISTINCT CASE path WHEN 'package.json' THEN 'npm install' WHEN 'go.mod' THEN 'go mod download' ELSE 'make' END AS command FROM f WHERE NOT contains(path, '/')")
def setup_commands(spark, d):
    f = spark.sql(SETUP.replace("FROM documents", "FROM {documents}"), documents=table(spark, d, "documents"))
    return reports.setup_rows(f).select("command")
