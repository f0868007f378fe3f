r"""Document fingerprints: Merkle trees over sections, paragraphs and content-defined pieces.

Sections are parted by empty lines, paragraphs by line ends, and a paragraph is cut at the
first white space behind 6 characters of a piece (or after 24 without): one rule for texts of
every length, and behind an insertion the cuts soon fall on the same words again.  A leaf
is the MD5 of its piece, a paragraph that of its leaves, a section that of its paragraphs, the
root the SHA-256 of the sections.  The fingerprint is ``root:nodes:leaves``: nodes are
``section/paragraph,paragraph;section/...`` and leaves are those of a paragraph run together,
``,`` between paragraphs and ``;`` between sections, all with 12 hex digits.

Equal texts have equal fingerprints and roots tell them apart.  ``edits`` locates the
differences: only sections that the other tree lacks are opened, and in them the paragraphs
that the other's opened sections lack are the edits; what was only moved or pushed on by an
insertion is none.  Likeness is the share of common leaves, each counted as often as it occurs.

Defined cases: a null text is empty (one section, one paragraph, no leaf); rows of equal
doc_id are ordered by the MD5 of their texts; null doc_ids are lowest; extra columns are
ignored; in a table of one row the next document is the row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, table

#: A piece is a word or two: finer ones recur in unrelated texts, coarser ones leave short texts nothing to share.
PIECE = r"(?s).{6,23}?[ \t]+|.{1,24}"
DIGITS = 12
BUCKET_ROWS = 2_000
SEGMENTS = 128
SPAN = 1_000


def tree(text: Column) -> Column:
    """``print`` (the fingerprint) and ``leaves`` (as numbers, repeats included) of a text."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.md5(x.cast("binary")))
    node = lambda xs: F.md5(F.array_join(xs, "").cast("binary"))
    short = lambda x: F.substring(x, 1, DIGITS)
    paragraph = lambda p: F.transform(F.array(leaves(p)), lambda x: F.struct(node(x).alias("node"), F.transform(x, short).alias("leaves")))[0]
    section = lambda ps: F.struct(node(F.transform(ps, lambda p: p["node"])).alias("node"), ps.alias("ps"))
    sections = F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.array(F.transform(F.split(s, "\n", -1), paragraph)), section)[0])

    def parts(t: Column) -> Column:
        root = F.sha2(F.array_join(F.transform(t, lambda s: s["node"]), "").cast("binary"), 256)
        nodes = F.array_join(F.transform(t, lambda s: F.concat(short(s["node"]), F.lit("/"), F.array_join(F.transform(s["ps"], lambda p: short(p["node"])), ","))), ";")
        flat = F.array_join(F.transform(t, lambda s: F.array_join(F.transform(s["ps"], lambda p: F.array_join(p["leaves"], "")), ",")), ";")
        every = F.flatten(F.transform(t, lambda s: F.flatten(F.transform(s["ps"], lambda p: F.transform(p["leaves"], lambda x: F.xxhash64(x))))))
        return F.struct(F.concat_ws(":", root, nodes, flat).alias("print"), every.alias("leaves"))

    return F.transform(F.array(sections), parts)[0]  # the tree is bound once


def fingerprint(text: Column) -> Column:
    return tree(text)["print"]


def leaves(print_: Column) -> Column:
    """The leaves of a fingerprint as numbers."""
    flat = F.translate(F.split_part(print_, F.lit(":"), F.lit(3)), ",;", "")
    return F.transform(F.regexp_extract_all(flat, F.lit(".{%d}" % DIGITS), F.lit(0)), lambda x: F.xxhash64(x))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared leaves over all leaves of two lists: one fold over both in order."""
    side = lambda xs, k: F.transform(xs, lambda x: F.shiftleft(x, 1).bitwiseOR(F.lit(k)))
    both = F.sort_array(F.concat(side(a, 0), side(b, 1)))
    start = F.struct(F.lit(-1).cast("long").alias("leaf"), F.lit(0).alias("more"), F.lit(0).alias("lost"))

    def put(z: Column, x: Column) -> Column:
        leaf, one = F.shiftright(x, 1), F.lit(1) - F.lit(2) * x.bitwiseAND(F.lit(1)).cast("int")
        same = z["leaf"] == leaf
        return F.struct(
            leaf.alias("leaf"), F.when(same, z["more"] + one).otherwise(one).alias("more"),
            F.when(same, z["lost"]).otherwise(z["lost"] + F.abs(z["more"])).alias("lost"))

    all_ = F.size(a) + F.size(b)
    lost = F.aggregate(both, start, put, lambda z: z["lost"] + F.abs(z["more"]))
    return (all_ - lost).cast("double") / F.greatest(all_, F.lit(1))


def same_root(a: Column, b: Column) -> Column:
    return F.substring(a, 1, 64) == F.substring(b, 1, 64)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1; 1 where the roots agree."""
    x = F.struct(leaves(a).alias("a"), leaves(b).alias("b"))
    return F.when(same_root(a, b), F.lit(1.0)).otherwise(F.transform(F.array(x), lambda t: dice(t["a"], t["b"]))[0])


def _sections(print_: Column) -> Column:
    return F.transform(F.split(F.split_part(print_, F.lit(":"), F.lit(2)), ";", -1), lambda s: F.struct(
        F.substring(s, 1, DIGITS).alias("node"), F.split(F.substring(s, DIGITS + 2, 2**31 - 1), ",", -1).alias("ps")))


def _gone(a: Column, b: Column) -> Column:
    """Positions of the paragraphs of sections ``a`` that sections ``b`` lack."""
    names = lambda x: F.transform(x, lambda s: s["node"])
    open_ = F.flatten(F.transform(F.filter(b, lambda s: ~F.array_contains(names(a), s["node"])), lambda s: s["ps"]))
    flat = F.flatten(F.transform(a, lambda s: F.transform(s["ps"], lambda p: F.when(~F.array_contains(names(b), s["node"]), p))))

    def positions(x: Column) -> Column:
        times = lambda xs, p: F.size(F.filter(xs, lambda y: y == p))
        late = lambda p, k: p.isNotNull() & (times(F.slice(x["flat"], F.lit(1), k + 1), p) > times(x["open"], p))
        return F.filter(F.transform(x["flat"], lambda p, k: F.when(late(p, k), k)), lambda k: k.isNotNull())

    return F.transform(F.array(F.struct(flat.alias("flat"), open_.alias("open"))), positions)[0]


def edits(a: Column, b: Column) -> Column:
    """``removed`` and ``added``: positions (0-based) of paragraphs of ``a`` that ``b`` lacks, and of ``b`` that ``a`` lacks."""
    both = F.struct(_sections(a).alias("a"), _sections(b).alias("b"))
    return F.transform(F.array(both), lambda t: F.struct(_gone(t["a"], t["b"]).alias("removed"), _gone(t["b"], t["a"]).alias("added")))[0]


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Positions of paragraphs of ``a`` that ``b`` lacks."""
    return edits(a, b)["removed"]


def _buckets(docs: DataFrame, bucket_rows: int) -> DataFrame:
    """Adds ``_bucket``, an array that rises with (_id, falling _h), of about ``bucket_rows`` rows each.

    Limits are percentiles, cut evenly; buckets that still have many rows are cut again: by id,
    or by the hash of the text where they hold one id alone.
    """
    want = max(1, -(-docs.count() // bucket_rows))
    cuts = min(want, SEGMENTS)
    limits = docs.agg(F.percentile_approx("_id", [k / cuts for k in range(cuts + 1)], 100_000)).first()[0] or [0, 0]
    limits = sorted(set(limits))
    each = -(-want // cuts)
    bucket = None
    for k, (lo, hi) in reversed(list(enumerate(zip(limits[:-1], limits[1:])))):
        inside = F.floor((F.col("_id").cast("double") - float(lo)) / (max(1.0, float(hi) - float(lo)) / each)).cast("long")
        at = F.lit(k * each).cast("long") + F.least(F.greatest(inside, F.lit(0)), F.lit(each - 1))
        bucket = F.when(F.col("_id") >= lo, at) if bucket is None else bucket.when(F.col("_id") >= lo, at)
    bucket = F.lit(0).cast("long") if bucket is None else bucket.otherwise(F.lit(-1).cast("long"))
    docs = docs.withColumn("_bucket", F.array(bucket))
    for _ in range(4):
        full = docs.groupBy("_bucket").agg(F.count("*").alias("_n"), F.min("_id").alias("_lo"), F.max("_id").alias("_hi")).filter(F.col("_n") > 4 * bucket_rows)
        full = full.withColumn("_parts", F.ceil(F.col("_n") / bucket_rows)).drop("_n")
        n_full = full.count()
        if not n_full:
            break
        docs = docs.join(F.broadcast(full) if n_full <= BROADCAST_ROWS else full, "_bucket", "left")
        wide = F.col("_hi").cast("double") - F.col("_lo").cast("double") + 1
        by_id = F.floor((F.col("_id").cast("double") - F.col("_lo").cast("double")) / wide * F.col("_parts"))
        by_text = F.col("_parts") - 1 - F.floor(F.col("_h") / float(1 << 60) * F.col("_parts"))
        at = F.when(F.col("_parts").isNull(), 0).when(F.col("_lo") < F.col("_hi"), by_id).otherwise(by_text).cast("long")
        docs = docs.withColumn("_bucket", F.concat("_bucket", F.array(F.greatest(F.lit(0), F.least(at, F.coalesce("_parts", F.lit(1)) - 1))))).drop("_lo", "_hi", "_parts")
    return docs


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``next_text``: the text of the row that follows by descending doc_id, at the end the first.

    Rows go to buckets of neighbouring ids and are sorted within them; only the first text of
    each bucket is looked up by the bucket before: within spans of buckets, and, one row a
    span, from span to span.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    md = F.md5(F.col("text").cast("binary"))
    docs = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(-(2**63))), "_h": F.conv(F.substring(md, 1, 15), 16, 10).cast("long")})
    docs = _buckets(docs, bucket_rows)
    order = (F.col("_id").desc(), F.md5(F.col("text").cast("binary")))
    rows = docs.withColumn("next_text", F.lead("text").over(Window.partitionBy("_bucket").orderBy(*order)))
    heads = docs.groupBy("_bucket").agg(F.max("_id").alias("_id"))  # ids alone
    if docs.count() <= bucket_rows * BROADCAST_ROWS:  # a head a bucket
        heads = F.broadcast(heads)
    firsts = docs.join(heads, ["_bucket", "_id"], "left_semi").groupBy("_bucket").agg(F.min_by("text", md).alias("_first"))
    firsts = firsts.withColumn("_span", F.floor(F.col("_bucket")[0] / SPAN))
    spans = firsts.groupBy("_span").agg(F.max_by("_first", "_bucket").alias("_top")).withColumn("_all", F.lit(0))
    down = Window.partitionBy("_all").orderBy(F.col("_span").desc())  # one row a span
    spans = spans.select("_span", F.coalesce(F.lead("_top").over(down), F.first("_top").over(down)).alias("_below"))
    inside = Window.partitionBy("_span").orderBy(F.col("_bucket").desc())
    links = firsts.select("_span", F.col("_bucket").alias("_b"), F.lead("_first").over(inside).alias("_after")).join(spans, "_span")
    links = links.select("_b", F.coalesce("_after", "_below").alias("_head_text"))
    # rows are dealt by bucket already: only the few heads move here
    rows = rows.join(links, rows._bucket == links._b, "left")
    return rows.select("doc_id", "text", F.coalesce("next_text", "_head_text").alias("next_text"))


def edit_probe(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with its likeness to that and to the next document."""
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), tree(F.col("text")).alias("a"), tree(F.col("next_text")).alias("c"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "a", tree(F.col("edited")).alias("b"), "c")
    near = lambda x, y: F.when(same_root(x["print"], y["print"]), F.lit(1.0)).otherwise(dice(x["leaves"], y["leaves"]))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.col("a.print").alias("fingerprint"), F.col("b.print").alias("edited_fingerprint"),
        near(F.col("a"), F.col("b")).alias("near_edited"), near(F.col("a"), F.col("c")).alias("near_next"),
    )


def op10_merkle_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edit_probe(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS next_text
  FROM documents WINDOW w AS (ORDER BY doc_id DESC, md5(coalesce(text, '')) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), e AS (
  SELECT doc_id, text, next_text, length(text) AS n_chars,
    substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited
  FROM d
), k AS (
  SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, unnest([1, 2, 3]) AS which, unnest([text, edited, next_text]) AS t FROM e
), tree AS (
  SELECT doc_id, n_chars, edited_sha256, which,
    list_transform(string_split(t, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
      lambda p: list_transform(regexp_extract_all(p, '(?s).{6,23}?[ \t]+|.{1,24}'), lambda x: md5(x)))) AS l
  FROM k
), n AS (
  SELECT *, list_transform(l, lambda s: list_transform(s, lambda p: md5(array_to_string(p, '')))) AS ps FROM tree
), m AS (
  SELECT *, list_transform(ps, lambda s: md5(array_to_string(s, ''))) AS ss FROM n
), f AS (
  SELECT doc_id, n_chars, edited_sha256, which, sha256(array_to_string(ss, '')) AS root,
    array_to_string(list_transform(range(1, len(ss) + 1), lambda i: substr(ss[i], 1, 12) || '/' || array_to_string(list_transform(ps[i], lambda p: substr(p, 1, 12)), ',')), ';') AS nodes,
    array_to_string(list_transform(l, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(list_transform(p, lambda x: substr(x, 1, 12)), '')), ',')), ';') AS flat,
    list_transform(flatten(flatten(l)), lambda x: substr(x, 1, 12)) AS leaves
  FROM m
), c AS (
  SELECT doc_id, which, leaf, count(*) AS n FROM (SELECT doc_id, which, unnest(leaves) AS leaf FROM f) GROUP BY doc_id, which, leaf
), s AS (
  SELECT a.doc_id, b.which, sum(least(a.n, b.n)) AS n FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.leaf = b.leaf AND a.which = 1 AND b.which > 1 GROUP BY a.doc_id, b.which
), g AS (
  SELECT doc_id, n_chars, edited_sha256,
    max(root || ':' || nodes || ':' || flat) FILTER (which = 1) AS fingerprint, max(root || ':' || nodes || ':' || flat) FILTER (which = 2) AS edited_fingerprint,
    max(root) FILTER (which = 1) AS ra, max(root) FILTER (which = 2) AS rb, max(root) FILTER (which = 3) AS rc,
    max(len(leaves)) FILTER (which = 1) AS a, max(len(leaves)) FILTER (which = 2) AS b, max(len(leaves)) FILTER (which = 3) AS c
  FROM f GROUP BY doc_id, n_chars, edited_sha256
)
SELECT g.doc_id, CAST(n_chars AS BIGINT) AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN ra = rb THEN 1.0::DOUBLE ELSE (2 * coalesce(x.n, 0))::DOUBLE / greatest(a + b, 1) END AS near_edited,
  CASE WHEN ra = rc THEN 1.0::DOUBLE ELSE (2 * coalesce(y.n, 0))::DOUBLE / greatest(a + c, 1) END AS near_next
FROM g LEFT JOIN s x ON x.doc_id = g.doc_id AND x.which = 2 LEFT JOIN s y ON y.doc_id = g.doc_id AND y.which = 3
"""
