"""Personal data: base patterns, and terms that give protected entities away.

Base spans are e-mail addresses, IP addresses, card and phone numbers by fixed patterns
(leftmost matches of each kind, failing ones dropped without retry), each searched in time
linear in the text.  Every different value found is a protected entity.

The method is information-theoretic sanitisation.  Corpus counts of documents tell how much a
term t reveals of an entity e: disclosure = PMI(t; e) / IC(e), where IC(e) = -ln p(e) and
PMI(t; e) = ln(p(t, e) / (p(t) p(e))); it is 1 if t occurs only beside e.  Where a document holds e,
a term of disclosure ``THRESHOLD`` or more is generalised to its first ``GENERAL`` characters, if
that class of terms does not disclose any entity of the document itself, and removed otherwise.
Counts are of different texts, so that copies of one text prove nothing, and a pair counts
only if ``LEAST_TEXTS`` different texts hold both.  Documents without a base span are never
changed, whatever their words.

Scale: only texts with a base span give terms, one row a text.  Terms, and entities, that occur in
the same of these texts are one class (equal number and equal sum of 128 hash bits), so that
pairs are counted between classes; counts within these texts bound disclosure from above, and
only terms that pass by this bound are counted over the whole corpus: in place, if they are
few (``BROADCAST_ROWS``), and by a join of all terms beyond that.  Texts meet their flagged terms
by the hash of the text; texts without ``@`` or digit have no base span and take no part in it.

Defined cases: null and empty texts have no spans; null doc_ids and repeated rows are rows like
others; long texts are searched whole; overlapping spans of different kinds all stand in the
spans, and in the clean text the first of them; extra columns are kept, and the added ones
replace columns of their names.  Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BROADCAST_ROWS, checkpoint, give_back, slices, table
from .terms import TERM, terms

KINDS = ("email", "ip", "card", "phone")
THRESHOLD, LEAST_TEXTS, GENERAL = 0.9, 3, 4
SPAN = "struct<kind: string, start: long, end: long>"
SPANS = f"array<{SPAN}>"

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Domains first, then the local part before: no word is tried from each of its characters."""
    end = 0
    for m in DOMAIN.finditer(text):
        at = m.start()
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield start, end


def _luhn(digits: str) -> bool:
    twice = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind; the value is the entity, in one spelling."""
    if not text:
        return []
    out = [("email", s, e, text[s:e].translate(_LOWER)) for s, e in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span(), m[0]) for m in IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span(), digits))
        for m in PHONE.finditer(text) if "+" in text else ():
            digits = "".join(DIGIT.findall(m[0]))
            if 9 <= len(digits) <= 15:
                out.append(("phone", *m.span(), "+" + digits))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def masked(text: str, spans: list[tuple]) -> str:
    """The text with blanks in place of base spans."""
    pieces, at = [], 0
    for _, s, e, *_ in spans:
        s, e = max(s, at), max(e, at)
        pieces += text[at:s], " " * (e - s)
        at = e
    return "".join([*pieces, text[at:]])


def with_general(words: set[str]) -> set[str]:
    """The terms and the classes that they generalise to: their first characters and a star."""
    return words | {w[:GENERAL] + "*" for w in words if len(w) > GENERAL}


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entities and terms of the texts that hold base spans."""
    for part in slices(batches):
        rows = []
        for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            spans = base_spans(text)
            if spans:
                words = {w.decode() for w in terms(masked(text, spans))}
                rows.append((key, sorted({f"{k}:{v}" for k, _, _, v in spans}), sorted(with_general(words))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())))], names=["text_key", "entities", "terms"])
    give_back()


def _counted(wanted: frozenset[str] | None):
    """(term, text_key) of the wanted terms of every text, or of all terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keys, found = [], []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = {w.decode() for w in terms(text)}
                words = with_general(words) if wanted is None else with_general(words) & wanted
                found += words
                keys += [key] * len(words)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(keys, pa.binary())], names=["term", "text_key"])
        give_back()

    return run


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _classes(held: DataFrame, what: str, name: str, least: int) -> DataFrame:
    """name, class and number of texts of the values of an array column that so many texts hold.

    Values of the same texts are one class: equal number and equal sums of two hashes.
    """
    rows = held.select("text_key", F.explode(what).alias(name))
    sums = [F.sum(F.xxhash64("text_key", F.lit(salt)).cast("decimal(38,0)")) for salt in (1, 2)]
    rows = rows.groupBy(name).agg(F.count("*").alias("n"), *(s.alias(f"h{k}") for k, s in enumerate(sums))).filter(F.col("n") >= least)
    return rows.select(name, F.col("n").alias(f"{name}_n"), F.sha2(F.concat_ws(":", "n", "h0", "h1"), 256).alias(f"{name}_class"))


def disclosing(docs: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_TEXTS) -> tuple[DataFrame, DataFrame]:
    """Terms that disclose (term, entity class, disclosure), and the flagged terms of each text."""
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text <> ''").select(text_key(F.col("text")).alias("text_key"), "text")
    held = texts.filter(F.col("text").rlike("[@0-9]")).mapInArrow(_held, "text_key binary, entities array<string>, terms array<string>")
    held = checkpoint(held.dropDuplicates(["text_key"]))
    total = texts.agg(F.count_distinct("text_key")).first()[0]
    entity, term = checkpoint(_classes(held, "entities", "entity", least)), checkpoint(_classes(held, "terms", "term", least))
    entities = held.select("text_key", F.explode("entities").alias("entity")).join(entity, "entity").select("text_key", "entity_class", "entity_n").distinct()
    # p(e | t) must reach p(e) ** (1 - threshold), and no more than all texts of e hold t
    floor = lambda n: F.pow(n / F.lit(float(max(total, 1))), F.lit(1 - threshold))
    most = entities.groupBy("text_key").agg(F.max(F.col("entity_n") / floor(F.col("entity_n"))).alias("most"))
    inner = held.join(most, "text_key").select("text_key", "most", F.explode("terms").alias("term")).join(term, "term").filter("term_n <= most")
    inner = inner.select("text_key", "term_class", "term_n").distinct()
    pairs = inner.join(entities, "text_key").groupBy("term_class", "entity_class", "term_n", "entity_n").agg(F.count("*").alias("both"))
    pairs = checkpoint(pairs.filter((F.col("both") >= least) & (F.col("both") >= F.col("term_n") * floor(F.col("entity_n")) * (1 - 1e-9))))
    wanted = checkpoint(term.join(pairs.select("term_class").distinct(), "term_class").select("term"))
    if wanted.count() <= BROADCAST_ROWS:
        found = texts.mapInArrow(_counted(frozenset(r[0] for r in wanted.collect())), "term string, text_key binary")
    else:
        found = texts.mapInArrow(_counted(None), "term string, text_key binary").join(wanted, "term", "left_semi")
    counts = found.distinct().groupBy("term").agg(F.count("*").alias("n"))
    told = term.join(pairs, ["term_class", "term_n"]).join(counts, "term")
    pmi = F.ln(F.col("both") * F.lit(float(total)) / (F.col("n") * F.col("entity_n")))
    told = told.withColumn("disclosure", pmi / F.ln(F.lit(float(total)) / F.col("entity_n"))).filter((F.col("disclosure") >= threshold - 1e-9) & (F.col("entity_n") < total))
    told = checkpoint(told.select("term", "entity_class", "entity_n", F.col("n").alias("term_n"), "both", "disclosure"))
    flagged = held.select("text_key", F.explode("terms").alias("term")).join(told.select("term", "entity_class"), "term").join(entities, ["text_key", "entity_class"])
    flagged = flagged.groupBy("text_key").agg(F.collect_set("term").alias("flagged"))
    return told, flagged


def _sanitised(text_at: int, flagged_at: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            base, added, clean = [], [], []
            for text, flags in zip(part.column(text_at).to_pylist(), part.column(flagged_at).to_pylist()):
                spans, more, words = base_spans(text), [], set(flags or ())
                if words:
                    for m in TERM.finditer(masked(text, spans)):
                        word = m[0].translate(_LOWER)
                        if word in words:
                            general = len(word) > GENERAL and word[:GENERAL] + "*" not in words
                            more.append(("general" if general else "removed", *m.span()))
                pieces, at = [], 0
                for kind, s, e in sorted([x[:3] for x in spans] + more, key=lambda x: (x[1], -x[2])):
                    if s >= at:
                        pieces += text[at:s], text[s : s + GENERAL] + "*" if kind == "general" else "[removed]" if kind == "removed" else f"[{kind}]"
                    at = max(at, e)
                base.append([dict(zip(("kind", "start", "end"), x)) for x in spans])
                added.append([dict(zip(("kind", "start", "end"), x)) for x in more])
                clean.append("".join([*pieces, text[at:]]) if pieces else text)
            columns = [c for i, (n, c) in enumerate(zip(part.schema.names, part.columns)) if i != flagged_at and n not in ADDED]
            made = [pa.array(v, schema.field(n).type) for n, v in zip(ADDED, (base, added, clean))]
            yield pa.RecordBatch.from_arrays([*columns, *made], schema=schema)
        give_back()

    return run


ADDED = ("base_spans", "added_spans", "clean_text")


def sanitise(docs: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_TEXTS) -> DataFrame:
    """``docs`` with base_spans, added_spans (kind, start, end; kinds general and removed) and clean_text."""
    names = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(*[F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in names])
    flagged = disclosing(rows, threshold, least)[1]
    out = T.StructType([*rows.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in zip(ADDED, (SPANS, SPANS, "string")))])
    maybe = F.coalesce(F.col("text").rlike("[@0-9]"), F.lit(False))
    none = F.lit(None).cast(SPANS)
    plain = rows.filter(~maybe).select("*", F.coalesce(none, F.array()).cast(SPANS).alias(ADDED[0]), F.coalesce(none, F.array()).cast(SPANS).alias(ADDED[1]), F.col("text").alias(ADDED[2]))
    key = "__pii_key"
    while key in names:
        key += "_"
    joined = rows.filter(maybe).withColumn(key, text_key(F.col("text"))).join(flagged.withColumnRenamed("text_key", key).withColumnRenamed("flagged", f"{key}_flagged"), key, "left")
    joined = joined.select(*names, f"{key}_flagged")
    return plain.unionByName(joined.mapInArrow(_sanitised(names.index("text"), len(names), to_arrow_schema(out)), out))


def op13_pii(spark, sf_dir: str) -> DataFrame:
    rows = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    joined = lambda spans: F.array_join(F.transform(spans, line), ",")
    every = F.array_sort(F.transform(F.concat("base_spans", "added_spans"), lambda x: F.struct(
        x["start"].alias("start"), F.array_position(F.array(*map(F.lit, (*KINDS, "general", "removed"))), x["kind"]).alias("nth"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(every).alias("spans"),
    )
