"""Text and path functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters a-z, digits and underscores, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)))


def lines(text: Column) -> Column:
    """Lines by every Unicode line end, without an empty last one."""
    cut = F.split(text, LINE_END, -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}\u001c-\u001f\u0085]+|[\s\p{Z}\u001c-\u001f\u0085]+$", "")


def count_of(text: Column, part: str) -> Column:
    """Occurrences of ``part`` that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def parts(path: Column) -> Column:
    return F.split(path, "/", -1)


def base_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """Last suffix with its dot, lower-case; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def normal_path(path: Column) -> Column:
    """Path without empty and ``.`` segments and with ``..`` resolved."""
    nothing = F.array().cast("array<string>")
    keep = F.aggregate(parts(path), nothing, lambda a, x: F.when(x.isin("", "."), a)
                       .when((x == "..") & (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1)) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
                       .otherwise(F.concat(a, F.array(x))))
    return F.when(F.size(keep) == 0, ".").otherwise(F.array_join(keep, "/"))


def posix_path(path: Column) -> Column:
    """Path without repeated slashes and ``.`` segments; two leading slashes stay, ``..`` too, and nothing is ``.``."""
    kept = F.array_join(F.filter(parts(path), lambda x: ~x.isin("", ".")), "/")
    root = F.when(F.rlike(path, F.lit("^//(?!/)")), "//").when(F.startswith(path, F.lit("/")), "/").otherwise("")
    return F.coalesce(F.nullif(F.concat(root, kept), F.lit("")), F.when(path.isNotNull(), "."))


def file_order(path: Column) -> Column:
    """Sort key of a walk that lists the files of a folder before its subfolders."""
    p = parts(path)
    return F.transform(p, lambda x, k: F.struct((k < F.size(p) - 1).cast("int").alias("is_dir"), x.alias("name")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where lengths differ or a norm is zero."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = d(a), d(b)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(x, y) / norm)
