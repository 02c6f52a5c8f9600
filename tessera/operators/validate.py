"""Findings about id-list files: rows (code, n, examples), no row without a finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _finding(code: str, rows: DataFrame, example: str) -> DataFrame:
    """Number of rows and the first five distinct examples; only those and one sum meet."""
    each = rows.groupBy(F.col(example).cast("string").alias("e")).agg(F.count("*").alias("c"))
    first = each.where("e is not null").orderBy("e").limit(5).select(F.lit(0).cast("long").alias("c"), "e")
    both = each.agg(F.sum("c").alias("c")).select("c", F.lit(None).cast("string").alias("e")).unionByName(first)
    found = both.agg(F.sum("c").alias("n"), F.array_join(F.array_sort(F.collect_list("e")), ",").alias("examples"))
    return found.where("n > 0").select(F.lit(code).alias("code"), "n", "examples")


def split_lists(lines: DataFrame) -> DataFrame:
    """lines (left, right, has_tab) as rows (s1_id, ids); blank lines without a tab don't count."""
    ids = F.filter(F.transform(F.split("right", ","), lambda x: F.trim(x)), lambda x: x != "")
    return lines.where("has_tab").select(F.col("left").alias("s1_id"), ids.alias("ids"))


def findings(lists: DataFrame, required: DataFrame, known: DataFrame | None = None, prefixes: tuple[str, ...] = ("S2-", "S3-")) -> DataFrame:
    """What is wrong with lists (s1_id, ids) against the required ids (id) and, where given, all known ones (id)."""
    each = lists.select("s1_id", F.explode("ids").alias("q_id"))
    bad_prefix = reduce(lambda a, b: a & b, [~F.startswith("q_id", F.lit(p)) for p in prefixes])
    found = [
        _finding("duplicate_row", lists.groupBy("s1_id").count().where("count > 1"), "s1_id"),
        _finding("repeated_id", lists.where(F.size("ids") != F.size(F.array_distinct("ids"))), "s1_id"),
        _finding("self_match", each.where(F.startswith("q_id", F.lit("S1-"))), "q_id"),
        _finding("bad_prefix", each.where(bad_prefix & ~F.startswith("q_id", F.lit("S1-"))), "q_id"),
        _finding("missing_entity", required.select("id").distinct().join(lists, F.col("id") == F.col("s1_id"), "left_anti"), "id"),
        _finding("extra_entity", lists.select("s1_id").distinct().join(required, F.col("id") == F.col("s1_id"), "left_anti"), "s1_id"),
    ]
    if known is not None:
        found.append(_finding("unknown_id", each.select("q_id").distinct().join(known, F.col("id") == F.col("q_id"), "left_anti"), "q_id"))
    return reduce(DataFrame.unionByName, found)


def line_findings(lines: DataFrame, header: tuple[str, str]) -> DataFrame:
    """What is wrong with raw lines (line, left, right, has_tab): no such header, and lines without a tab."""
    name = "\t".join(header)
    head = lines.where(F.lower(F.trim("line")) == name)
    wrong = head.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("wrong_header").alias("code"), F.lit(1).cast("long").alias("n"), F.lit(name).alias("examples"))
    return wrong.unionByName(_finding("missing_tab", lines.where("not has_tab and trim(line) <> ''"), "line"))


def not_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """A warning: matches (s1_id, ids) that aren't among the candidates (s1_id, ids)."""
    pairs = lambda df: df.select("s1_id", F.explode("ids").alias("q_id")).distinct()
    return _finding("match_not_candidate", pairs(matches).join(pairs(candidates), ["s1_id", "q_id"], "left_anti"), "q_id")


def totals(lists: DataFrame) -> DataFrame:
    """One row: rows, empties, ids, distinct entities."""
    return lists.agg(F.count("*").alias("rows"), F.count_if(F.size("ids") == 0).alias("empties"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("ids"), F.count_distinct("s1_id").alias("entities"))
