"""Queries by name, each with the SQL that says the same in another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


#: Lookback and horizon of the registered queries.
L, H = 24, 6

# Common table expressions of the SQL side. p: hourly panel of events; w: its windows; q: test queries; f: (query, step) rows.
P = """h as (select user_id as series_id, date_trunc('hour', ts) as ts, cast(sum(cast(round(value * 100) as bigint)) as bigint) as c from events group by 1, 2),
g as (select ts, row_number() over (order by ts) - 1 as t from (select unnest(generate_series((select min(ts) from h), (select max(ts) from h), interval 1 hour)) as ts)),
p as (select s.series_id, 0 as variate, g.t, g.ts, cast(coalesce(h.c, 0) as bigint) as c from (select distinct series_id from h) s cross join g left join h on h.series_id = s.series_id and h.ts = g.ts)"""
WINDOWS = """w as (select *, count(*) over x as n, cast(sum(c) over x as bigint) as s1, cast(sum(c * c) over x as bigint) as s2, max(c) over x as mx, min(c) over x as mn
  from p window x as (partition by series_id, variate order by t rows between 23 preceding and current row))"""
SPLITS = """dims as (select count(*) as total, cast(floor(0.6 * count(*)) as bigint) as a, cast(floor(0.8 * count(*)) as bigint) as b from g),
sp as (select 'train' as split, 0 as lo, a as hi from dims union all select 'valid1', a, b from dims union all select 'test1', b, total from dims)"""
#: q: admissible queries of each split at a stride of H.
SPLIT_Q = """q as (select sp.split, w.* from w join sp on w.t >= greatest(23, sp.lo - 1) and w.t + 6 <= sp.hi - 1 and (w.t - greatest(23, sp.lo - 1)) % 6 = 0)"""
STD = "sqrt(greatest(cast(n as double) * cast(s2 as double) - cast(s1 as double) * cast(s1 as double), 0.0)) / cast(n as double)"
BASE = f"with {P}, {WINDOWS}, {SPLITS}, {SPLIT_Q}"
TEST_Q = "tq as (select * from q where split = 'test1' and mx > mn)"
#: Weekly shipments: two variates.
S = """r as (select l_suppkey as series_id, date_trunc('week', l_shipdate) as ts, 0 as variate, cast(round(l_quantity * 100) as bigint) as c from lineitem
  union all select l_suppkey, date_trunc('week', l_shipdate), 1, cast(round(l_extendedprice * 100) as bigint) from lineitem),
h as (select series_id, variate, ts, cast(sum(c) as bigint) as c from r group by 1, 2, 3),
g as (select ts, row_number() over (order by ts) - 1 as t from (select unnest(generate_series((select min(ts) from h), (select max(ts) from h), interval 7 day)) as ts)),
p as (select s.series_id, s.variate, g.t, g.ts, cast(coalesce(h.c, 0) as bigint) as c from (select distinct series_id, variate from h) s cross join g left join h on h.series_id = s.series_id and h.variate = s.variate and h.ts = g.ts)"""
#: Two variates of hourly events: value and count.
MV = """r as (select user_id as series_id, date_trunc('hour', ts) as ts, 0 as variate, cast(round(value * 100) as bigint) as c from events union all select user_id, date_trunc('hour', ts), 1, 1 from events),
h as (select series_id, variate, ts, cast(sum(c) as bigint) as c from r group by 1, 2, 3),
g as (select ts, row_number() over (order by ts) - 1 as t from (select unnest(generate_series((select min(ts) from h), (select max(ts) from h), interval 1 hour)) as ts)),
p as (select s.series_id, s.variate, g.t, g.ts, cast(coalesce(h.c, 0) as bigint) as c from (select distinct series_id, variate from h) s cross join g left join h on h.series_id = s.series_id and h.variate = s.variate and h.ts = g.ts)"""
#: Monthly orders of nations, with names and regions.
M = """h as (select c_nationkey as series_id, date_trunc('month', o_orderdate) as ts, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as c from orders join customer on o_custkey = c_custkey group by 1, 2),
g as (select ts, row_number() over (order by ts) - 1 as t from (select unnest(generate_series((select min(date_trunc('month', o_orderdate)) from orders), (select max(date_trunc('month', o_orderdate)) from orders), interval 1 month)) as ts)),
p as (select n_nationkey as series_id, 0 as variate, g.t, g.ts, cast(coalesce(h.c, 0) as bigint) as c, n_name as series_name, n_regionkey as cluster_id from (select distinct series_id from h) s join nation on n_nationkey = s.series_id cross join g left join h on h.series_id = s.series_id and h.ts = g.ts)"""
