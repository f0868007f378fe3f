"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

The rules label URLs; trees learn from a bounded sample of those (about ``LABELLED_ROWS``
different URLs, by a hash) and judge the URLs that no rule fits.  Features: length, depth,
share of digits, entropy, number of parameters, and the share of blocked sample rows for the
host's last label and last two labels (smoothed; both classes weigh the same, so a suffix that
the sample lacks counts a half).  For a row that the trees learn from, those shares are taken
over the other ``FOLDS`` folds of hosts, so that no row tells its own label.  Features are
binned at sample quantiles and the sample is aggregated to distinct cells of bins; these cells
(LABELLED_ROWS at most) are gathered once and the trees grow on their histograms.

Defined cases: a null URL or one without ``://`` has empty host and path, so no rule fits
and the trees judge it; without labelled rows, or with one class only, the trees are empty
and the prior decides (no rows: allow); repeated rows get a row each; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, table

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
LABELLED_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 6, 3, 12, 0.4, 1.0
FOLDS = 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_url(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls without one."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (rule, verdict) if rules else (F.lit(None).cast("string"),) * 2


def lexical(url: Column, host: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    n = F.length(text)
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    labels = F.split(host, r"\.")
    return {
        "length": n.cast("double"),
        "depth": F.size(F.split(text, "/")).cast("double"),
        "digits": F.when(n > 0, F.length(F.regexp_replace(text, "[^0-9]", "")) / n).otherwise(0.0),
        "entropy": F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))),
        "params": F.size(F.regexp_extract_all(text, F.lit("[?&;][^=&;#]+="), F.lit(0))).cast("double"),
        "tld": F.element_at(labels, -1),
        "domain": F.array_join(F.slice(F.concat(F.array(F.lit("")), labels), -2, 2), "."),
    }


NUMERIC = ("length", "depth", "digits", "entropy", "params")
FEATURES = (*NUMERIC, "tld_blocked", "domain_blocked")


class UrlModel:
    """Bin limits, suffix tables (at most LABELLED_ROWS rows) and trees over bins."""

    def __init__(self, limits: dict, prior: float, suffixes: dict[str, DataFrame] | None, base: float, trees: list):
        self.limits, self.prior, self.suffixes, self.base, self.trees = limits, prior, suffixes, base, trees

    def binned(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f"b_{f}": sum(((F.col(f) > t).cast("int") for t in self.limits.get(f, ())), F.lit(0)) for f in FEATURES})

    def bins(self, rows: DataFrame) -> DataFrame:
        for name in ("tld", "domain"):
            if self.suffixes:
                rows = rows.join(F.broadcast(self.suffixes[name]), name, "left")  # bounded by the sample
                rows = rows.withColumn(f"{name}_blocked", F.coalesce(f"{name}_blocked", F.lit(self.prior)))
            else:
                rows = rows.withColumn(f"{name}_blocked", F.lit(self.prior))
        return self.binned(rows)

    def margin(self) -> Column:
        out = F.lit(self.base)
        for tree in self.trees:
            out = out + _tree(tree)
        return out


def _tree(node) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    feature, cut, left, right = node
    return F.when(F.col(f"b_{feature}") <= cut, _tree(left)).otherwise(_tree(right))


def _share(blocked: Column, weight: Column) -> Column:
    return (blocked + 5) / (weight + 10)


def grow(cells: list[tuple[int, tuple, float]], depth: int, margins: list[float]):
    """The next tree on cells (blocked, bins, weight), as nested (feature, cut, left, right) over leaves."""
    slopes = []
    for (blocked, _, weight), m in zip(cells, margins):
        p = 1 / (1 + math.exp(-m))
        slopes.append(((p - blocked) * weight, p * (1 - p) * weight))

    def node(rows: list[int], level: int):
        g, h = sum(slopes[i][0] for i in rows), sum(slopes[i][1] for i in rows)
        best = (1e-6, None, None)
        for f in range(len(FEATURES)) if level < depth else ():
            by: dict[int, list[float]] = {}
            for i in rows:
                x = by.setdefault(cells[i][1][f], [0.0, 0.0])
                x[0] += slopes[i][0]
                x[1] += slopes[i][1]
            gl = hl = 0.0
            seen = sorted(by)
            for b, after in zip(seen, seen[1:]):
                gl, hl = gl + by[b][0], hl + by[b][1]
                gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
                if gain > best[0] + 1e-9:
                    best = (gain, f, (b + after) // 2)  # halfway to the next bin with rows
        if best[1] is None:
            leaf = -RATE * g / (h + RIDGE)
            for i in rows:
                margins[i] += leaf
            return leaf
        _, f, cut = best
        left, right = [i for i in rows if cells[i][1][f] <= cut], [i for i in rows if cells[i][1][f] > cut]
        return FEATURES[f], cut, node(left, level + 1), node(right, level + 1)

    return node(list(range(len(cells))), 0)


def train(labelled: DataFrame, bound: int = LABELLED_ROWS, trees: int = TREES, depth: int = DEPTH) -> UrlModel:
    """Fit on (url, host, blocked): about ``bound`` different URLs at most, chosen by a hash."""
    labelled = labelled.withColumn("h", F.xxhash64("url", F.lit("sample")))
    n = labelled.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    if n > bound:
        labelled = labelled.filter(F.shiftrightunsigned("h", 11) < int(bound / n * (1 << 53)))
    labelled = labelled.groupBy("url", "host", "blocked").agg(F.count("*").alias("times"))
    rows = labelled.select("blocked", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).alias("fold"), *[c.alias(k) for k, c in lexical(F.col("url"), F.col("host")).items()])
    rows = checkpoint(rows.coalesce(4))
    n, hits, *cuts = rows.agg(
        F.count("*"), F.coalesce(F.sum("blocked"), F.lit(0)),
        *[F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 1000) for f in NUMERIC],
    ).first()
    prior = hits / n if n else 0.0
    if not n or hits in (0, n):
        return UrlModel({}, prior, None, 10.0 if n and hits else -10.0, [])
    even = F.when(F.col("blocked") == 1, n / (2 * hits)).otherwise(n / (2 * (n - hits)))  # both classes weigh the same
    limits = {f: sorted(set(c)) for f, c in zip(NUMERIC, cuts)}
    limits |= {f"{s}_blocked": [k / BINS for k in range(1, BINS)] for s in ("tld", "domain")}
    suffixes, learn = {}, rows
    for s in ("tld", "domain"):  # at most a row a sample row each
        sums = [F.sum(even * F.col("blocked")).alias("_b"), F.sum(even).alias("_w")]
        all_ = rows.groupBy(s).agg(*sums)
        suffixes[s] = checkpoint(all_.select(s, _share(F.col("_b"), F.col("_w")).alias(f"{s}_blocked")))
        own = rows.groupBy(s, "fold").agg(*sums).withColumnsRenamed({"_b": "_own_b", "_w": "_own_w"})
        learn = learn.join(F.broadcast(own), [s, "fold"]).join(F.broadcast(all_), s)
        learn = learn.withColumn(f"{s}_blocked", _share(F.col("_b") - F.col("_own_b"), F.col("_w") - F.col("_own_w"))).drop("_b", "_w", "_own_b", "_own_w")
    model = UrlModel(limits, 0.5, suffixes, 0.0, [])
    names = [f"b_{f}" for f in FEATURES]
    cells = model.binned(learn).groupBy("blocked", *names).agg(F.sum(even).alias("weight")).collect()
    cells = sorted((r["blocked"], tuple(r[c] for c in names), r["weight"]) for r in cells)
    margins = [0.0] * len(cells)
    for _ in range(trees):
        model.trees.append(grow(cells, depth, margins))
    return model


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """host, path, rule, verdict and score (null where a rule decides) beside each row's page_id and url."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string")).withColumns({"host": host, "path": path})
    rule, says = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_says": says})
    model = train(rows.filter(F.col("_says").isNotNull()).select("url", "host", (F.col("_says") == "block").cast("int").alias("blocked")))
    ruled = rows.filter(F.col("_says").isNotNull()).withColumn("score", F.lit(None).cast("double"))
    free = rows.filter(F.col("_says").isNull())
    free = model.bins(free.withColumns(lexical(F.col("url"), F.col("host")))).withColumn("score", 1 / (1 + F.exp(-model.margin())))
    free = free.withColumn("_says", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    names = ["page_id", "url", "host", "path", "rule", F.col("_says").alias("verdict"), "score"]
    return ruled.select(names).unionByName(free.select(names))


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select(F.col("page_id").cast("long"), "host", "path", "rule", "verdict")
