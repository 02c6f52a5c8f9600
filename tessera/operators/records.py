"""Prepared records: every comparable view of a name and an address in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import normalize as n

FIELDS = ["nname", "naddr", "skel", "name_sort", "acronym", "first_w", "ntok", "hn", "nums", "atok", "postal", "nonascii", "domain", "dba", "noaddr"]


def _first(a: Column) -> Column:
    return F.coalesce(F.get(a, F.lit(0)), F.lit(""))


def prepare(df: DataFrame, keep_raw: bool = False, lists: n.Lists = n.LISTS) -> DataFrame:
    """df (name, addr and others) with FIELDS; with keep_raw also raw, "name ; addr" as it was."""
    named = df.withColumns({"nname": n.norm_name(F.col("name"), lists), "naddr": n.norm_addr(F.col("addr"), lists)})
    words, parts = n.tokens(F.col("nname")), n.tokens(F.col("naddr"))
    numbers = F.filter(parts, n.is_number)
    name = F.coalesce("name", F.lit(""))
    out = named.withColumns(
        {
            "skel": n.name_skeleton(F.col("nname")),
            "name_sort": n.name_sort(F.col("nname")),
            "acronym": n.acronym(F.col("nname")),
            "first_w": _first(words),
            "ntok": F.filter(F.transform(words, n.skeleton), lambda t: F.length(t) >= 2),
            "hn": _first(numbers),
            "nums": F.array_sort(F.array_distinct(numbers)),
            "atok": F.filter(parts, lambda t: ~n.is_number(t) & (F.length(t) >= 3)),
            "postal": F.coalesce(F.try_element_at(F.filter(numbers, lambda t: F.length(t).isin(5, 6)), F.lit(-1)), F.lit("")),
            "nonascii": name.rlike("[^\\x00-\\x7F]"),
            "domain": name.rlike(n.HAS_DOMAIN),
            "dba": name.rlike(n.HAS_DBA),
            "noaddr": F.col("naddr") == "",
        }
    )
    return out.withColumn("raw", F.concat(F.trim(name), F.lit(" ; "), F.trim(F.coalesce("addr", F.lit(""))))) if keep_raw else out
