"""DuckDB SQL of the keyed bootstrap: every draw a row, mixed in 128-bit integers."""

from __future__ import annotations

_TWO64 = "CAST('18446744073709551616' AS UHUGEINT)"


def _times(x: str, by: str) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * CAST('{by}' AS UHUGEINT)) % {_TWO64} AS UBIGINT)"


def _mixed(cte: str, source: str, keep: str) -> str:
    """CTEs that end in `cte`: the columns `keep` of source and u, from its base and number i."""
    return f"""{cte}0 AS (SELECT {keep}, CAST((CAST(base AS UHUGEINT) + CAST({_times("CAST(i + 1 AS UBIGINT)", "11400714819323198485")} AS UHUGEINT)) % {_TWO64} AS UBIGINT) AS z FROM ({source})),
{cte}1 AS (SELECT {keep}, {_times("xor(z, z >> 30)", "13787848793156543929")} AS z FROM {cte}0),
{cte}2 AS (SELECT {keep}, {_times("xor(z, z >> 27)", "10723151780598845931")} AS z FROM {cte}1),
{cte} AS (SELECT {keep}, CAST(xor(z, z >> 31) >> 11 AS DOUBLE) / 9007199254740992e0 AS u FROM {cte}2)"""


def bootstrap(values: str, keys: list[str], resamples: int, size: int, seed: int = 0) -> str:
    """p_gt and its 95 % interval from `values`: the keys, side (is N) and value."""
    k, on = ", ".join(keys), " AND ".join(f"a.{c} = b.{c}" for c in keys)
    ak = ", ".join(f"a.{c}" for c in keys)
    base = lambda part: "CAST('0x' || substring(md5('" + f"{seed}:' || " + " || ':' || ".join(f"CAST(a.{c} AS VARCHAR)" for c in keys) + f" || ':' || b || ':' || CAST(side AS INTEGER) || ':' || {part}), 1, 15) AS UBIGINT)"
    return f"""WITH v AS (SELECT {k}, side, value FROM ({values})),
d AS (SELECT {k}, value, row_number() OVER (PARTITION BY {k} ORDER BY value) AS rank FROM v GROUP BY {k}, value),
e AS (SELECT {ak}, a.side, b.rank, (b.rank - 1) // {size} AS r, row_number() OVER (PARTITION BY {ak}, a.side ORDER BY b.rank) - 1 AS place FROM v a JOIN d b ON {on} AND a.value = b.value),
f AS (SELECT *, place - min(place) OVER (PARTITION BY {k}, side, r) AS inner_place FROM e),
n AS (SELECT {k}, side, count(*) AS n FROM v GROUP BY {k}, side),
{_mixed("g", f"SELECT {k}, side, b, n, base, unnest(range(n)) AS i FROM (SELECT {ak}, side, n, b, {base("'-1'")} AS base FROM n a, range({resamples}) t(b))", f"{k}, side, b, n")},
t AS (SELECT {ak}, a.side, a.b, b.r, count(*) AS t FROM g a JOIN f b ON {on} AND a.side = b.side AND b.place = CAST(floor(a.u * a.n) AS BIGINT) GROUP BY {ak}, a.side, a.b, b.r),
m AS (SELECT {k}, side, r, count(*) AS m FROM f GROUP BY {k}, side, r),
{_mixed("h", f"SELECT {k}, side, b, r, m, base, unnest(range(t)) AS i FROM (SELECT {ak}, a.side, a.b, a.r, b.m, a.t, {base('a.r').replace('|| b ||', '|| a.b ||').replace('(side AS', '(a.side AS')} AS base FROM t a JOIN m b ON {on} AND a.side = b.side AND a.r = b.r)", f"{k}, side, b, r, m")},
c AS (SELECT {ak}, a.b, b.rank, count(*) FILTER (NOT a.side) AS mh, count(*) FILTER (a.side) AS mn FROM h a JOIN f b ON {on} AND a.side = b.side AND a.r = b.r AND b.inner_place = CAST(floor(a.u * a.m) AS BIGINT) GROUP BY {ak}, a.b, b.rank),
w AS (SELECT {k}, b, sum(CAST(mh AS DOUBLE) * up) AS w FROM (SELECT *, sum(mn) OVER (PARTITION BY {k}, b ORDER BY rank) AS up FROM c) GROUP BY {k}, b),
s AS (SELECT {k}, count(*) FILTER (NOT side) AS nh, count(*) FILTER (side) AS nn FROM v GROUP BY {k}),
p AS (SELECT {ak}, sum(CASE WHEN a.value >= b.value THEN 1e0 ELSE 0e0 END) / count(*) AS p_gt FROM v a JOIN v b ON {on} AND NOT a.side AND b.side GROUP BY {ak}),
q AS (SELECT {ak}, quantile_cont(w / (CAST(nh AS DOUBLE) * nn), 0.025) AS ci_low, quantile_cont(w / (CAST(nh AS DOUBLE) * nn), 0.975) AS ci_high FROM w a JOIN s b ON {on} GROUP BY {ak})
SELECT {ak}, round(p_gt, 9) AS p_gt, round(ci_low, 9) AS ci_low, round(ci_high, 9) AS ci_high FROM p a LEFT JOIN q b ON {on}"""
