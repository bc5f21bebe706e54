"""Snippets for writing oracle SQL (DuckDB) that follows the library's
exactness recipe: exact integer sums divided once, rounding through decimal."""

from __future__ import annotations


def R(x: str, n: int) -> str:
    """Round half away from zero through decimal, as DOUBLE."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,9)), {n}) AS DOUBLE)"


def BR(x: str, n: int) -> str:
    """Round half to even through decimal, as DOUBLE."""
    return f"CAST(round_even(CAST({x} AS DECIMAL(38,9)), {n}) AS DOUBLE)"


def US(later: str, earlier: str) -> str:
    """``later - earlier`` in microseconds."""
    return f"date_diff('microsecond', {earlier}, {later})"


def DAYS(later: str, earlier: str) -> str:
    return f"({US(later, earlier)} / 86400000000.0e0)"


def WHOLE_DAYS(later: str, earlier: str) -> str:
    return f"CAST(round({DAYS(later, earlier)}) AS BIGINT)"


def DIV(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / CAST(NULLIF({den}, 0) AS DOUBLE))"


def AVG_DAYS(us: str) -> str:
    """Exact mean of microsecond durations, in days."""
    return f"({DIV(f'CAST(sum({us}) AS BIGINT)', f'count({us})')} / 86400000000.0e0)"


def AVG_INT(x: str) -> str:
    return DIV(f"CAST(sum({x}) AS BIGINT)", f"count({x})")


def AVG_MONEY(x: str) -> str:
    return DIV(f"sum(CAST({x} AS DECIMAL(18,2)))", f"count({x})")


def MONEY_SUM(x: str) -> str:
    return f"sum(CAST({x} AS DECIMAL(18,2)))"


def CW(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


def PCT(num: str, den: str, n: int) -> str:
    return R(f"(CAST({num} AS DOUBLE) * 100.0e0 / CAST(NULLIF({den}, 0) AS DOUBLE))", n)


def PCT_WHEN(cond: str, n: int) -> str:
    return PCT(CW(cond), "count(*)", n)


def CASE_LE(x: str, cuts, labels) -> str:
    parts = " ".join(f"WHEN {x} <= {c} THEN '{lab}'" for c, lab in zip(cuts, labels))
    return f"CASE {parts} ELSE '{labels[-1]}' END"


def RIGHT_CLOSED(x: str, edges, labels) -> str:
    parts = " ".join(f"WHEN {x} > {lo} AND {x} <= {hi} THEN '{lab}'"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"CASE {parts} END"


def PERCENTILE(source: str, value: str, q: float, keys: tuple[str, ...] = (), alias: str = "p") -> str:
    """Exact percentile per group by rank selection, numpy's linear rule
    (``source`` is a FROM item exposing ``keys`` and ``value``)."""
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    kcols = "".join(f"{k}, " for k in keys)
    grp = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""(
      SELECT {kcols}CASE WHEN d >= 0.5 THEN b - (b - a) * (1.0e0 - d) ELSE a + (b - a) * d END AS {alias}
      FROM (SELECT {kcols}max(CASE WHEN rn = floor(pos) THEN v END) AS a,
                   max(CASE WHEN rn = ceil(pos) THEN v END) AS b,
                   any_value(pos - floor(pos)) AS d
            FROM (SELECT {kcols}v, row_number() OVER ({part} ORDER BY v) - 1 AS rn,
                         CAST(count(*) OVER ({part}) - 1 AS DOUBLE) * {float(q)!r}e0 AS pos
                  FROM (SELECT {kcols}CAST({value} AS DOUBLE) AS v FROM {source}) WHERE v IS NOT NULL)
            WHERE rn = floor(pos) OR rn = ceil(pos) {grp}))"""
