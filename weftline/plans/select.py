"""Compact queries: a select string, a where string and an order string, as Spark expressions.

Spark parses the strings.  Only what Spark's grammar lacks is done here: chained ranges (``10 < x < 20``), and grouping that
follows from the select list, where the plain columns beside aggregates are the keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPERAND = r"[A-Za-z0-9_.`+-]+"
_CHAIN = re.compile(rf"(?<![A-Za-z0-9_.`])({_OPERAND})\s*(<=?|>=?)\s*({_OPERAND})\s*(<=?|>=?)\s*({_OPERAND})")
_QUOTED = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"")
#: The aggregates that a select string may call.
AGGREGATES = frozenset("count sum avg min max countdistinct count_distinct approx_count_distinct median mode stddev stddev_pop stddev_samp variance var_pop var_samp first last any_value bool_and bool_or every some collect_list collect_set group_concat listagg percentile percentile_approx corr covar_pop covar_samp skewness kurtosis max_by min_by bit_and bit_or bit_xor".split())
_CALL = re.compile(r"([A-Za-z_]\w*)\s*\(")
_ALIAS = re.compile(r"^(.*?)\s+as\s+(`[^`]+`|\w+)\s*$", re.I | re.S)


def condition(where: str | None) -> str:
    """A where string for Spark: empty means every row; a < x < b is a < x and x < b.  Quoted strings are left alone."""
    if not where or not where.strip():
        return "1 = 1"
    parts, at = [], 0
    for m in _QUOTED.finditer(where):
        parts += [where[at : m.start()], m[0]]
        at = m.end()
    parts.append(where[at:])
    return "".join(p if k % 2 else _CHAIN.sub(r"(\1 \2 \3 and \3 \4 \5)", p) for k, p in enumerate(parts))


def items(select: str) -> list[str]:
    """The entries of a select list; commas inside brackets or quotes do not part them."""
    out, depth, quote, held = [], 0, "", ""
    for c in select:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        if c == "," and not depth and not quote:
            out.append(held.strip())
            held = ""
        else:
            held += c
    return [x for x in [*out, held.strip()] if x]


def is_aggregate(item: str) -> bool:
    return any(m[1].lower() in AGGREGATES for m in _CALL.finditer(_QUOTED.sub("''", item)))


def query(df: DataFrame, select: str, where: str | None = None, orderby: str | None = None) -> DataFrame:
    """select over the rows of df that where keeps.  With an aggregate in the list its plain entries are the group; without
    one, rows come as they are."""
    entries = items(select)
    kept = df.where(condition(where))
    if any(map(is_aggregate, entries)):
        keys = [x for x in entries if not is_aggregate(x)]
        bare = [m[1] if (m := _ALIAS.match(x)) else x for x in keys]
        named = [F.expr(e).alias(f"_key{k}") for k, e in enumerate(bare)]
        grouped = kept.groupBy(*named).agg(*[F.expr(x) for x in entries if is_aggregate(x)])
        sums = iter([c for c in grouped.columns if not re.fullmatch(r"_key\d+", c)])
        places = iter(range(len(keys)))
        columns = []
        for x in entries:
            if is_aggregate(x):
                columns.append(F.col(f"`{next(sums)}`"))
            else:
                k = next(places)
                columns.append(F.col(f"_key{k}").alias(m[2].strip("`") if (m := _ALIAS.match(x)) else x.strip("`").split(".")[-1]))
        kept = grouped.select(*columns)
    else:
        kept = kept.selectExpr(*entries)
    return ordered(kept, orderby)


def ordered(df: DataFrame, orderby: str | None) -> DataFrame:
    """df by an order string such as ``tally desc, start``."""
    if not orderby or not orderby.strip():
        return df
    keys = []
    for x in items(orderby):
        name, _, way = x.rpartition(" ") if x.lower().endswith((" asc", " desc")) else (x, "", "asc")
        keys.append(F.expr(name).desc() if way.lower() == "desc" else F.expr(name).asc())
    return df.orderBy(*keys)


def known_columns(df: DataFrame, names: str | list[str] | None) -> DataFrame:
    """The named columns that df has, in the order of the request; unknown names are left out, none means all.  A string is
    parted at spaces, commas, dots and hyphens."""
    asked = re.split(r"[\s,.-]+", names) if isinstance(names, str) else names
    chosen = [c for c in asked or [] if c in df.columns]
    return df.select(*chosen) if asked else df


def union_tables(spark, paths: list[str]) -> DataFrame:
    """The rows of several columnar folders together; duplicates stay, columns match by name."""
    first, *rest = [spark.read.parquet(p) for p in paths]
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
