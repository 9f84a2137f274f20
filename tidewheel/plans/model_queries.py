"""Queries on aggregations, forecasts, losses, normalizations and statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import normalize as nrm
from ..operators import blocks
from ..operators import windows as win
from ..operators.tails import tail_means
from ..sources import panels as src
from ..sources.shared import stash
from .panel_queries import spans_of, split_panel, split_panel_mv, synthetic_population
from .registry import BASE, MV, H, L, M, P, SPLIT_Q, SPLITS, STD, TEST_Q, WINDOWS, query

HOURLY = f"with {P}"
DEV = f"({STD} / 100 + 1e-8)"
MEAN = "(abs(cast(s1 as double) / n / 100) + 1e-8)"


def no_minus(x):
    """Zero without a sign."""
    return F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(0.0))


def evaluated(spark, sf_dir, method: str = "persistence", split: str = "test1", keep_constant: bool = False, extra: tuple[str, ...] = ()):
    """Losses of a fixed-rule forecast on every step of a split's windows."""
    panel = src.events_hourly(spark, sf_dir)
    spans = [s for s in win.split_ranges(win.dates_of(panel), [0.6, 0.2, 0.2]) if s[0] == split]
    q = blocks.windows(panel, spans, L, H, H, past=method not in ("persistence", "expected"))
    q = q if keep_constant else q.filter("mx > mn")
    rows = q.select("split", "series_id", "t", "c", "n", "s1", "s2", *extra, *(["x"] if "x" in q.columns else []), F.posexplode("y").alias("step", "y")).withColumn("step", F.col("step") + 1)
    return ev.losses(rows.withColumn("pred", ev.forecast(method, F.col("step"), L, H, period=24)))


def rows_sql(pred: str, extra: str = "") -> str:
    """SQL of `evaluated`: f has one row for each query and step, l its losses."""
    return f"""{BASE}, {TEST_Q}, f as (select q.series_id, q.t, y.t - q.t as step, q.n, q.s1, q.s2, q.c, y.c as y, {pred} as pred from tq q cross join (select unnest(range(1, 7)) as ahead) join p y on y.series_id = q.series_id and y.t = q.t + ahead {extra}),
l as (select *, ((y - pred) / 100) * ((y - pred) / 100) as mse, (((y - pred) / 100) / {DEV}) * (((y - pred) / 100) / {DEV}) as nmse, abs((y - pred) / 100) as mae, abs(((y - pred) / 100) / {DEV}) as nmae, (((y - pred) / 100) / {MEAN}) * (((y - pred) / 100) / {MEAN}) as relative_mse from f)"""


PREDICTIONS = {
    "persistence": ("cast(q.c as double)", ""),
    "expected": ("cast(q.s1 as double) / q.n", ""),
    "repeat": ("cast(z.c as double)", "join p z on z.series_id = q.series_id and z.t = y.t - 6"),
    "lookback": ("cast(z.c as double)", "join p z on z.series_id = q.series_id and z.t = y.t - 24"),
    "periodic": ("cast(z.c as double)", "join p z on z.series_id = q.series_id and z.t = y.t - 24"),
}


def summary_sql(metric: str, by: str = "") -> str:
    g, on = (f"{by}, ", f"partition by {by} ") if by else ("", "")
    return f"""um as (select {g}series_id, avg({metric}) as m, sum({metric}) as s, sum({metric} * {metric}) as ss, count({metric}) as k from l group by all),
rk as (select *, row_number() over ({on}order by m desc, series_id) as rank, greatest(1, ceil(count(*) over ({on.strip()}) * 0.1)) as tail from um)
select {g}round(sum(s) / sum(k), 6) as {metric}, round(sqrt(greatest(sum(ss) / sum(k) - (sum(s) / sum(k)) * (sum(s) / sum(k)), 0.0)), 4) as std_{metric}, round(avg(m), 6) as user_{metric}, round(stddev_pop(m), 4) as std_user_{metric}, round(avg(case when rank <= tail then m end), 6) as w10_{metric}, count(*) as users from rk {"group by " + by if by else ""}"""


for _name in PREDICTIONS:  # MDL1-4 and 6 (one period), LOS1, AGG11-13
    query(f"mdl_{_name}_summary", rows_sql(*PREDICTIONS[_name]) + ", " + summary_sql("mse"))(lambda spark, sf_dir, m=_name: ev.summaries(evaluated(spark, sf_dir, m), "mse"))

for _loss in ev.LOSSES:  # LOS1-3
    query(f"los_{_loss}_summary", rows_sql(*PREDICTIONS["persistence"]) + ", " + summary_sql(_loss))(lambda spark, sf_dir, m=_loss: ev.summaries(evaluated(spark, sf_dir), m))


@query("mdl1_report_persistence", rows_sql(*PREDICTIONS["persistence"]) + """, um as (select series_id, avg(mse) as m from l group by 1), r as (select *, row_number() over (order by m desc, series_id) as rk, count(*) over () as n from um)
select round((select avg(mse) from l), 6) as mse, round((select avg(nmse) from l), 6) as nmse, round((select avg(mae) from l), 6) as mae, round(avg(m), 6) as user_mse, round(avg(case when rk <= greatest(1, ceil(0.1 * n)) then m end), 6) as w10_mse, count(*) as users from r""")
def report_persistence(spark, sf_dir):
    """Losses of all steps and of users; the worst tenth comes from histograms of users."""
    rows = evaluated(spark, sf_dir)
    users = stash(rows.groupBy("series_id").agg(*(F.sum(m).alias(m) for m in ("mse", "nmse", "mae")), F.count("*").alias("k")).withColumn("m", F.col("mse") / F.col("k")))
    whole = users.agg(*(F.round(F.sum(m) / F.sum("k"), 6).alias(m) for m in ("mse", "nmse", "mae")), F.round(F.avg("m"), 6).alias("user_mse"), F.count("*").alias("users"))
    tail = tail_means(users, [], "m").select(F.round("tail_mean", 6).alias("w10_mse"))
    return whole.join(F.broadcast(tail), how="left").select("mse", "nmse", "mae", "user_mse", "w10_mse", "users")  # one row


@query("trn4_evaluate_one_pass", rows_sql(*PREDICTIONS["persistence"]) + " select series_id, t as query_id, step, round(mse, 6) as mse, round(nmse, 6) as nmse, round(mae, 6) as mae, round(nmae, 6) as nmae, round(relative_mse, 4) as relative_mse from l")
def one_pass(spark, sf_dir):
    return evaluated(spark, sf_dir).select("series_id", F.col("t").alias("query_id"), F.col("step").cast("long").alias("step"), *(F.round(m, 4 if m == "relative_mse" else 6).alias(m) for m in ev.LOSSES))


@query("trn5_metadata", f"{BASE} select split, series_id, 'serie_' || series_id as series_name, count(*) as rows, min(t) as first_query, max(t) as last_query, 0 as run_id from q group by 1, 2")
def metadata(spark, sf_dir):
    q = split_panel(spark, sf_dir)
    return q.groupBy("split", "series_id").agg(F.count("*").alias("rows"), F.min("t").alias("first_query"), F.max("t").alias("last_query")).select("split", "series_id", F.concat(F.lit("serie_"), "series_id").alias("series_name"), "rows", "first_query", "last_query", F.lit(0).alias("run_id"))


@query("mdl17_constant_rule", f"with {MV}, {WINDOWS}, {SPLITS}, {SPLIT_Q} select series_id, t, bool_and({STD} / 100 <= 1e-8) as constant, max(case when variate = 0 then c end) as last from q where split = 'test1' group by 1, 2")
def constant_rule(spark, sf_dir):
    q = split_panel_mv(spark, sf_dir, "test1")
    return q.groupBy("series_id", "t").agg(F.bool_and(win.std(F.col("n"), F.col("s1"), F.col("s2")) / 100 <= 1e-8).alias("constant"), F.max(F.when(F.col("variate") == 0, F.col("c"))).alias("last"))


@query("mdl14_composed_forecast", rows_sql("cast(q.c as double)") + f" select series_id, t, step, coalesce(nullif(round(((c / 100.0 - s1::double / n / 100) / {DEV}) * {DEV} + s1::double / n / 100, 6), 0), 0) as pred from l")
def composed(spark, sf_dir):
    """Normalize, forecast in normalized units, and invert."""
    rows = evaluated(spark, sf_dir)
    mean, dev = F.col("s1").cast("double") / F.col("n") / 100, win.std(F.col("n"), F.col("s1"), F.col("s2")) / 100 + win.EPS
    return rows.select("series_id", "t", F.col("step").cast("long").alias("step"), no_minus(F.round((F.col("c") / 100 - mean) / dev * dev + mean, 6)).alias("pred"))


@query("agg14_merged_payloads", f"""{rows_sql(*PREDICTIONS['persistence'])}, a as (select series_id, mse from l union all select series_id, mae from l), um as (select series_id, avg(mse) as m from a group by 1), rk as (select *, row_number() over (order by m desc, series_id) as rank, count(*) over () as n from um)
select round((select avg(mse) from a), 6) as mse, round(avg(m), 6) as user_mse, round(avg(case when rank <= greatest(1, ceil(0.1 * n)) then m end), 6) as w10_mse from rk""")
def merged(spark, sf_dir):
    rows = evaluated(spark, sf_dir)
    both = rows.select("series_id", "mse").unionByName(rows.select("series_id", F.col("mae").alias("mse")))
    return ev.summaries(both, "mse").select("mse", "user_mse", "w10_mse")


@query("agg15_evaluate_modes", rows_sql(*PREDICTIONS["persistence"]) + " select 'mean' as mode, 0 as key, round(avg(mse), 6) as value from l union all select 'steps', step, round(avg(mse), 6) from l group by step union all select 'all', t, round(avg(mse), 6) from l group by t")
def modes(spark, sf_dir):
    rows = evaluated(spark, sf_dir)
    part = lambda name, key: rows.groupBy(key.cast("long").alias("key")).agg(F.round(F.avg("mse"), 6).alias("value")).select(F.lit(name).alias("mode"), "key", "value")
    return part("mean", F.lit(0)).unionByName(part("steps", F.col("step"))).unionByName(part("all", F.col("t")))


@query("agg16_horizon_profile", rows_sql(*PREDICTIONS["persistence"]) + " select step, round(avg(mse), 6) as mse, round(avg(mae), 6) as mae from l group by 1")
def profile(spark, sf_dir):
    return evaluated(spark, sf_dir).groupBy(F.col("step").cast("long").alias("step")).agg(F.round(F.avg("mse"), 6).alias("mse"), F.round(F.avg("mae"), 6).alias("mae"))


@query("agg17_user_scatter", rows_sql(*PREDICTIONS["persistence"]) + ", s as (select series_id, t, avg(mse) as v from l group by 1, 2) select series_id, round(avg(v), 4) as mean, round(stddev_pop(v), 3) as std, round(sign(avg(v)) * ln(1 + abs(avg(v) / 0.5)) * 0.5, 6) as symlog from s group by 1")
def scatter(spark, sf_dir):
    samples = evaluated(spark, sf_dir).groupBy("series_id", "t").agg(F.avg("mse").alias("v"))
    m = F.avg("v")
    return samples.groupBy("series_id").agg(F.round(m, 4).alias("mean"), F.round(F.stddev_pop("v"), 3).alias("std"), F.round(F.signum(m) * F.log(1 + F.abs(m / 0.5)) * 0.5, 6).alias("symlog"))


@query("agg18_box_rows", rows_sql(*PREDICTIONS["persistence"]) + ", s as (select series_id, t, avg(mae) as v from l group by 1, 2) select series_id, round(quantile_cont(v, 0.25), 6) as q1, round(quantile_cont(v, 0.5), 6) as median, round(quantile_cont(v, 0.75), 6) as q3, count(*) as windows from s group by 1")
def box(spark, sf_dir):
    samples = evaluated(spark, sf_dir).groupBy("series_id", "t").agg(F.avg("mae").alias("v"))
    return samples.groupBy("series_id").agg(*(F.round(F.percentile("v", p), 6).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))), F.count("*").alias("windows"))


@query("flt24_exotic_windows", rows_sql(*PREDICTIONS["persistence"]) + ", s as (select series_id, t, avg(mse) as v from l group by 1, 2) select series_id, t, round(v, 6) as v from s where v > 2000")
def exotic(spark, sf_dir):
    samples = evaluated(spark, sf_dir).groupBy("series_id", "t").agg(F.avg("mse").alias("v"))
    return samples.filter("v > 2000").select("series_id", "t", F.round("v", 6).alias("v"))


@query("srt6_top_users", rows_sql(*PREDICTIONS["persistence"]) + " select series_id, round(avg(mse), 6) as mse from l group by 1 order by avg(mse) desc, series_id limit 20")
def top_users(spark, sf_dir):
    users = evaluated(spark, sf_dir).groupBy("series_id").agg(F.avg("mse").alias("m"))
    return users.orderBy(F.col("m").desc(), "series_id").limit(20).select("series_id", F.round("m", 6).alias("mse"))


@query("set1_union_of_splits", f"{BASE} select 'valid1' as part, series_id, t from q where split = 'valid1' union all select 'test1', series_id, t from q where split = 'test1'")
def union_splits(spark, sf_dir):
    q = split_panel(spark, sf_dir)
    part = lambda name: q.filter(F.col("split") == name).select(F.lit(name).alias("part"), "series_id", "t")
    return part("valid1").unionByName(part("test1"))


@query("set2_distinct_users", "select distinct user_id as series_id, event_type from events")
def distinct_users(spark, sf_dir):
    return src.table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id"), "event_type").distinct()


@query("set3_missing_names", "select c_custkey from customer except select o_custkey from orders")
def missing_names(spark, sf_dir):
    customer, orders = src.table(spark, sf_dir, "customer"), src.table(spark, sf_dir, "orders")
    return customer.select("c_custkey").distinct().join(orders.select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_anti")


# Resampling -------------------------------------------------------------------

DAILY = "with b as (select user_id as series_id, date_trunc('day', ts) as ts, arg_min(c, ts) as first, arg_max(c, ts) as last, cast(sum(c) as bigint) as sum, avg(c) as mean from (select user_id, ts, max(cast(round(value * 100) as bigint)) as c from events group by 1, 2) group by 1, 2)"


def daily(spark, sf_dir):
    """One value for each user and timestamp, so that first and last are unique."""
    events = src.table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("series_id"), F.lit(0).alias("variate"), "ts").agg(F.max(src.cents(F.col("value"))).alias("c"))


GRID = "g as (select unnest(generate_series((select min(date_trunc('day', ts)) from events), (select max(date_trunc('day', ts)) from events), interval 1 day)) as ts), k as (select s.series_id, g.ts from (select distinct series_id from b) s cross join g)"
for _how in ("sum", "mean", "first", "last"):  # AGG1, AGG2
    query(f"agg_resample_{_how}", f"{DAILY}, {GRID} select k.series_id, k.ts, {'round(coalesce(b.mean, 0), 6)' if _how == 'mean' else f'coalesce(b.{_how}, 0)'} as c from k left join b on b.series_id = k.series_id and b.ts = k.ts")(
        lambda spark, sf_dir, how=_how: src.densify(src.resample(daily(spark, sf_dir), "day", how), src.date_grid(src.table(spark, sf_dir, "events"), "day")).select("series_id", "ts", F.round("c", 6).alias("c") if how == "mean" else F.col("c"))
    )


@query("agg3_exact_timestamps", f"{DAILY}, {GRID}, e as (select user_id as series_id, date_trunc('minute', ts) as ts, min(cast(round(value * 100) as bigint)) as c from events group by 1, 2) select k.series_id, k.ts, coalesce(e.c, 0) as c from k left join e on e.series_id = k.series_id and e.ts = k.ts")
def exact_timestamps(spark, sf_dir):
    events = src.table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("series_id"), F.lit(0).alias("variate"), F.date_trunc("minute", "ts").alias("ts"), src.cents(F.col("value")).alias("c"))
    return src.asfreq(rows, src.date_grid(events, "day")).select("series_id", "ts", "c")


# Window statistics ------------------------------------------------------------

FUT = "fw as (select series_id, variate, t, count(*) over x as fn, cast(sum(c) over x as bigint) as f1, cast(sum(c * c) over x as bigint) as f2 from p window x as (partition by series_id, variate order by t rows between 1 following and 6 following))"
FSTD = "sqrt(greatest(cast(fn as double) * cast(f2 as double) - cast(f1 as double) * cast(f1 as double), 0.0)) / cast(fn as double)"


def stat_windows(spark, sf_dir, only=None):
    panel = src.events_hourly(spark, sf_dir)
    q = blocks.windows(panel, spans_of(panel, only), L, H, H, past=False)
    total = lambda f: F.aggregate("y", F.lit(0).cast("long"), lambda a, v: a + f(v))
    return q.withColumns({"fn": F.size("y").cast("long"), "f1": total(lambda v: v), "f2": total(lambda v: v * v)})


@query("agg4_window_moments", f"{BASE}, {FUT} select q.split, q.series_id, q.t, round(cast(s1 as double) / n / 100, 6) as mean, round({STD} / 100, 6) as std, round(cast(f1 as double) / fn / 100, 6) as future_mean, round({FSTD} / 100, 6) as future_std from q join fw on fw.series_id = q.series_id and fw.t = q.t")
def moments(spark, sf_dir):
    mean = lambda s, n: F.round(F.col(s).cast("double") / F.col(n) / 100, 6)
    dev = lambda n, a, b: F.round(win.std(F.col(n), F.col(a), F.col(b)) / 100, 6)
    return stat_windows(spark, sf_dir).select("split", "series_id", "t", mean("s1", "n").alias("mean"), dev("n", "s1", "s2").alias("std"), mean("f1", "fn").alias("future_mean"), dev("fn", "f1", "f2").alias("future_std"))


@query("agg5_window_extremes", f"{BASE} select split, series_id, t, mx, mn, c as last, round(sqrt(cast(s2 as double) / n) / 100, 6) as rms from q")
def extremes(spark, sf_dir):
    return split_panel(spark, sf_dir).select("split", "series_id", "t", "mx", "mn", F.col("c").alias("last"), F.round(F.sqrt(F.col("s2").cast("double") / F.col("n")) / 100, 6).alias("rms"))


@query("agg6_gamma_statistics", f"""{BASE}, {FUT}, a as (select q.split, ({FSTD} / 100) / {DEV} as alpha, (cast(f1 as double) / fn / 100 - cast(s1 as double) / n / 100) / {DEV} as beta from q join fw on fw.series_id = q.series_id and fw.t = q.t where mx > mn)
select split, round(avg(alpha), 6) as alpha, round(avg(beta), 6) as beta, count(*) as windows from a group by 1""")
def gamma(spark, sf_dir, only=None):
    dev = win.std(F.col("n"), F.col("s1"), F.col("s2")) / 100 + win.EPS
    fdev = win.std(F.col("fn"), F.col("f1"), F.col("f2")) / 100
    rows = stat_windows(spark, sf_dir, only).filter("mx > mn").select("split", (fdev / dev).alias("alpha"), ((F.col("f1").cast("double") / F.col("fn") / 100 - F.col("s1").cast("double") / F.col("n") / 100) / dev).alias("beta"))
    return rows.groupBy("split").agg(F.round(F.avg("alpha"), 6).alias("alpha"), F.round(F.avg("beta"), 6).alias("beta"), F.count("*").alias("windows"))


@query("agg7_collection_statistics", f"""with {P}, {WINDOWS}, k as (select * from w where not (t >= 23 and mx = mn)), s as (select series_id, count(*) as n, cast(sum(c) as bigint) as s1, cast(sum(c * c) as double) as s2 from k group by 1)
select (select count(*) from p) as cells, cast(sum(n) as bigint) as values_, (select count(*) from p) - cast(sum(n) as bigint) as removed_values, round(sum(s1)::double / sum(n) / 100, 6) as mean, round(avg(sqrt(greatest(n * s2 - s1::double * s1::double, 0.0)) / n / 100), 4) as stds, round(sqrt(greatest(sum(n)::double * sum(s2) - sum(s1)::double * sum(s1)::double, 0.0)) / sum(n) / 100, 4) as std, count(*) as series from s""")
def collection(spark, sf_dir):
    """As described: with constant windows removed, it is the value at the window's query date that is left out, not the window."""
    w = win.with_moments(src.events_hourly(spark, sf_dir), L)
    gone = (F.col("t") >= L - 1) & (F.col("mx") == F.col("mn"))
    c = F.when(~gone, F.col("c"))
    s = w.groupBy("series_id").agg(F.count("*").alias("cells"), F.count(c).alias("n"), F.sum(c).alias("s1"), F.sum(c * c).cast("double").alias("s2")).filter("n > 0")
    n, s1, s2 = F.sum("n").cast("double"), F.sum("s1").cast("double"), F.sum("s2")
    own = F.sqrt(F.greatest(F.col("n") * F.col("s2") - F.col("s1").cast("double") * F.col("s1").cast("double"), F.lit(0.0))) / F.col("n") / 100
    everything = w.agg(F.count("*").alias("cells"))
    out = s.agg(F.sum("n").alias("values_"), F.round(s1 / n / 100, 6).alias("mean"), F.round(F.avg(own), 4).alias("stds"), F.round(F.sqrt(F.greatest(n * s2 - s1 * s1, F.lit(0.0))) / n / 100, 4).alias("std"), F.count("*").alias("series"))
    return out.join(F.broadcast(everything)).select("cells", "values_", (F.col("cells") - F.col("values_")).alias("removed_values"), "mean", "stds", "std", "series")


@query("agg8_loader_statistics", f"""{BASE}, {FUT}, a as (select q.*, fn, f1, f2 from q join fw on fw.series_id = q.series_id and fw.t = q.t)
select split, count(*) as accessible_windows, count(*) filter (where mx = mn) as constant_windows, round(avg(s1::double / n / 100), 6) as lookback_mean, round(avg({STD} / 100), 6) as lookback_std, round(avg(f1::double / fn / 100), 6) as future_mean, round(avg({FSTD} / 100), 6) as future_std,
 round(sum(s1)::double / sum(n) / 100, 6) as lookback_value_mean, round(sqrt(greatest(sum(s2)::double / sum(n) - (sum(s1)::double / sum(n)) * (sum(s1)::double / sum(n)), 0.0)) / 100, 4) as lookback_value_std, min(mn) as lookback_value_min, max(mx) as lookback_value_max, round(sum(f1)::double / sum(fn) / 100, 6) as future_value_mean from a group by 1""")
def loader(spark, sf_dir):
    a = stat_windows(spark, sf_dir)
    d = lambda c: F.col(c).cast("double")
    n, s1, s2 = F.sum("n").cast("double"), F.sum("s1").cast("double"), F.sum("s2").cast("double")
    return a.groupBy("split").agg(
        F.count("*").alias("accessible_windows"), F.count_if(F.col("mx") == F.col("mn")).alias("constant_windows"), F.round(F.avg(d("s1") / F.col("n") / 100), 6).alias("lookback_mean"), F.round(F.avg(win.std(F.col("n"), F.col("s1"), F.col("s2")) / 100), 6).alias("lookback_std"),
        F.round(F.avg(d("f1") / F.col("fn") / 100), 6).alias("future_mean"), F.round(F.avg(win.std(F.col("fn"), F.col("f1"), F.col("f2")) / 100), 6).alias("future_std"), F.round(s1 / n / 100, 6).alias("lookback_value_mean"),
        F.round(F.sqrt(F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0))) / 100, 4).alias("lookback_value_std"), F.min("mn").alias("lookback_value_min"), F.max("mx").alias("lookback_value_max"), F.round(F.sum("f1").cast("double") / F.sum("fn") / 100, 6).alias("future_value_mean"),
    )


@query("agg10_loader_metadata", f"{BASE}, e as (select sp.split, count(*) as potential from w join sp on w.t >= greatest(23, sp.lo - 1) and w.t + 6 <= sp.hi - 1 group by 1) select q.split, e.potential, count(*) as accessible, count(*) filter (where mx = mn) as constant_removed, cast(ceil(count(*) filter (where mx > mn) / 256.0) as bigint) as batches, count(distinct series_id) as users from q join e on e.split = q.split group by 1, 2")
def loader_metadata(spark, sf_dir):
    every = split_panel(spark, sf_dir, 1)
    stride = F.dense_rank().over(Window.partitionBy("split").orderBy("t"))
    grid = every.select("split", "t").distinct().withColumn("k", (stride - 1) % H).filter("k = 0").select("split", "t", F.lit(True).alias("on"))
    rows = every.join(F.broadcast(grid), ["split", "t"], "left")
    on, ok = F.col("on").isNotNull(), F.col("mx") > F.col("mn")
    return rows.groupBy("split").agg(F.count("*").alias("potential"), F.count_if(on).alias("accessible"), F.count_if(on & ~ok).alias("constant_removed"), F.ceil(F.count_if(on & ok) / 256).alias("batches"), F.count_distinct("series_id").alias("users"))


@query("agg31_sizes", f"{BASE} select 24 as lookback, count(distinct variate) as variates, 6 as horizon, count(*) as windows from q")
def sizes(spark, sf_dir):
    return split_panel(spark, sf_dir).agg(F.count_distinct("variate").alias("variates"), F.count("*").alias("windows")).select(F.lit(L).alias("lookback"), "variates", F.lit(H).alias("horizon"), "windows")


@query("agg32_split_metadata", f"with {P}, {SPLITS} select sp.split, count(distinct p.series_id) as series, count(distinct p.t) as dates, min(p.t) as first, max(p.t) as last from p join sp on p.t >= sp.lo and p.t < sp.hi group by 1")
def split_metadata(spark, sf_dir):
    panel = src.events_hourly(spark, sf_dir)
    case = F.lit(None)
    for name, lo, hi in win.split_ranges(win.dates_of(panel), [0.6, 0.2, 0.2]):
        case = F.when((F.col("t") >= lo) & (F.col("t") < hi), name).otherwise(case)
    return panel.withColumn("split", case).filter("split is not null").groupBy("split").agg(F.count_distinct("series_id").alias("series"), F.count_distinct("t").alias("dates"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("agg29_population_metrics", """with s as (select unnest(range(16)) as series_id), d as (select unnest(range(360)) as t), p as (select series_id, t, cast(case when series_id = 0 and t >= 60 and t < 96 then 5000 when series_id = 1 and t >= 300 and t < 336 then 5000 else 5000 + 100 * series_id + (case when series_id < 8 then 10 else -10 end) * t % 900 + (series_id * 7919 + t * 104729) % 400 + 300 * (abs(t % 24 - 12)) end as bigint) as c from s cross join d),
l as (select series_id, power((y.c - q.c) / 100.0, 2) as mse from p q join p y using (series_id) where q.t >= 287 and q.t <= 353 and y.t > q.t and y.t <= q.t + 6), """ + summary_sql("mse"))
def population_metrics(spark, sf_dir):
    p = win.with_future(synthetic_population(spark).withColumn("variate", F.lit(0)), H).filter("t >= 287 and t <= 353")
    rows = p.select("series_id", "c", F.explode("y").alias("y")).select("series_id", F.pow((F.col("y") - F.col("c")) / 100, F.lit(2.0)).alias("mse"))
    return ev.summaries(rows, "mse")


@query("agg30_interval_means", "select cast(floor(l_linenumber / 2) as bigint) as interval, round(avg(l_discount), 6) as loss, count(*) as steps from lineitem group by 1")
def interval_means(spark, sf_dir):
    return src.table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_linenumber") / 2).alias("interval")).agg(F.round(F.avg("l_discount"), 6).alias("loss"), F.count("*").alias("steps"))


# Normalizations -----------------------------------------------------------------

_X = "(c / 100.0::double)"
_MEANX, _STDX = "(s1::double / n / 100)", f"({STD} / 100)"
_MINX, _RANGE, _RMS = "(mn / 100.0::double)", "(mx / 100.0::double - mn / 100.0::double)", "(sqrt(s2::double / n) / 100)"
_G = "gs as (select round(sum(s1)::double / sum(n) / 100, 6) as gm, round(sqrt(greatest(sum(s2)::double / sum(n) - (sum(s1)::double / sum(n)) * (sum(s1)::double / sum(n)), 0.0)) / 100, 6) as gd, min(mn) / 100.0::double as lo, max(mx) / 100.0::double as hi from q where split = 'train')"
_FORWARD = {
    "identity": _X, "standard": f"({_X} - gm) / (gd + 1e-8)", "min_max": f"({_X} - lo) / (hi - lo + 1e-8)", "in_min_max": f"({_X} - {_MINX}) / ({_RANGE} + 1e-8)", "instance": f"({_X} - {_MEANX}) / ({_STDX} + 1e-8)",
    "revin": f"(({_X} - {_MEANX}) / ({_STDX} + 1e-8)) * 1.5 + 0.25", "revin_last": f"(({_X} - {_X}) / ({_STDX} + 1e-8)) * 1.5 + 0.25", "revin_arcsinh": f"asinh((({_X} - {_MEANX}) / ({_STDX} + 1e-8))) * 1.5 + 0.25", "sigmoid": f"1 / (1 + exp(-{_X}))", "tanh": f"tanh({_X})",
    "relative_mean": f"{_X} / (abs({_MEANX}) + 1e-8)", "rms": f"{_X} / ({_RMS} + 1e-8)", "grevin": f"(({_X} - 0.9 * {_MEANX}) * (1 + 0.8 * (1 / ({_STDX} + 1e-8) - 1))) * 1.2 + 0.1", "guarded": f"({_X} - {_MEANX}) / (case when {_STDX} <= 1e-8 then 1.0 else {_STDX} end)",
}
_INVERSE = {
    "identity": "z", "standard": "z * (gd + 1e-8) + gm", "min_max": "z * (hi - lo + 1e-8) + lo", "in_min_max": f"z * ({_RANGE} + 1e-8) + {_MINX}", "instance": f"z * ({_STDX} + 1e-8) + {_MEANX}",
    "revin": f"(z - 0.25) / (1.5 + 1e-8) * ({_STDX} + 1e-8) + {_MEANX}", "revin_last": f"(z - 0.25) / (1.5 + 1e-8) * ({_STDX} + 1e-8) + {_X}", "revin_arcsinh": f"sinh((z - 0.25) / (1.5 + 1e-8)) * ({_STDX} + 1e-8) + {_MEANX}", "sigmoid": "ln(greatest(least(z, 1 - 1e-6), 1e-6) / (1 - greatest(least(z, 1 - 1e-6), 1e-6)))",
    "tanh": "0.5 * (ln(1 + greatest(least(z, 1 - 1e-6), -1 + 1e-6)) - ln(1 - greatest(least(z, 1 - 1e-6), -1 + 1e-6)))", "relative_mean": f"z * (abs({_MEANX}) + 1e-8)", "rms": f"z * ({_RMS} + 1e-8)",
    "grevin": f"(1.1 * z + 0.05) / (1 + 0.8 * (1 / ({_STDX} + 1e-8) - 1)) + 0.9 * {_MEANX}", "guarded": f"z * (case when {_STDX} <= 1e-8 then 1.0 else {_STDX} end) + {_MEANX}",
}


def normalized(spark, sf_dir, name):
    q = split_panel(spark, sf_dir)
    rows = q.filter("mx > mn")
    if name in ("standard", "min_max"):
        n, s1, s2 = F.sum("n").cast("double"), F.sum("s1").cast("double"), F.sum("s2").cast("double")
        whole = q.filter("split = 'train'").agg(F.round(s1 / n / 100, 6).alias("gm"), F.round(F.sqrt(F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0))) / 100, 6).alias("gd"), (F.min("mn") / 100).alias("lo"), (F.max("mx") / 100).alias("hi"))
        rows = rows.join(F.broadcast(whole))
    forward, inverse = nrm.NORMALIZATIONS[name]
    z = rows.withColumn("z", forward(F.col("c") / 100))
    return z.select("split", "series_id", "t", no_minus(F.round("z", 6)).alias("z"), no_minus(F.round(inverse(F.col("z")), 4)).alias("back"))


for _name in _FORWARD:
    query(f"nrm_{_name}", f"{BASE}, {_G}, z as (select q.*, gs.*, {_FORWARD[_name]} as z from q cross join gs where mx > mn) select split, series_id, t, coalesce(nullif(round(z, 6), 0), 0) as z, coalesce(nullif(round({_INVERSE[_name]}, 4), 0), 0) as back from z")(lambda spark, sf_dir, n=_name: normalized(spark, sf_dir, n))


#: What training proposes to every preset: frozen groups don't take it.
_STEP = dict(a=0.5, gamma=1.2, nu=0.1, alpha=0.7, beta=0.3)
_ZI, _BACKI = f"(({_X} - {_MEANX}) * (1 / ({_STDX} + 1e-8)))", f"/ (1 / ({_STDX} + 1e-8)) + {_MEANX}"


@query("nrm11_presets", f"""{BASE}, {FUT}, ab as (select round(avg(({FSTD} / 100) / {DEV}), 6) as alpha, round(avg((cast(f1 as double) / fn / 100 - cast(s1 as double) / n / 100) / {DEV}), 6) as beta from q join fw on fw.series_id = q.series_id and fw.t = q.t where mx > mn and split = 'train'),
z as (select q.*, ab.*, series_id % 3 as cluster_id, {_ZI} as i from q cross join ab where mx > mn and split = 'test1'),
v as (select *, case cluster_id when 1 then 1.5 else 1.2 end as g from z)
select series_id, t, 'in' as preset, coalesce(nullif(round(i, 6), 0), 0) as z, coalesce(nullif(round(i {_BACKI}, 4), 0), 0) as back from v
union all select series_id, t, 'revin', coalesce(nullif(round(i * 1.2 + 0.1, 6), 0), 0), coalesce(nullif(round(((i * 1.2 + 0.1) * (1 / 1.2::double) - 0.1 / 1.2::double) {_BACKI}, 4), 0), 0) from v
union all select series_id, t, 'previn', coalesce(nullif(round(i * g + 0.1, 6), 0), 0), coalesce(nullif(round(((i * g + 0.1) * (1 / g::double) - 0.1 / g::double) {_BACKI}, 4), 0), 0) from v
union all select series_id, t, 'cmin', coalesce(nullif(round(i, 6), 0), 0), coalesce(nullif(round((alpha * i + beta) {_BACKI}, 4), 0), 0) from v""")
def presets(spark, sf_dir):
    """Presets after one proposed step: `in` is frozen, `revin` and `previn` (with one cluster of its own) move gamma and nu and stay tied, `cmin` starts from the training statistics."""
    stats = gamma(spark, sf_dir, "train").first()  # one row
    start = preset_start(None if stats is None else stats.asDict())
    q = split_panel(spark, sf_dir, only="test1").filter("mx > mn").withColumn("cluster_id", F.col("series_id") % 3)
    both = {n: nrm.of_clusters(n, p, {1: {"gamma": 1.5}} if n == "previn" else {}) for n, p in start.items()}
    x = F.col("c") / 100
    rows = q.select("series_id", "t", F.explode(F.array(*(F.struct(F.lit(n).alias("preset"), f(x).alias("z"), g(f(x)).alias("back")) for n, (f, g) in both.items()))).alias("r"))
    return rows.select("series_id", "t", "r.preset", no_minus(F.round("r.z", 6)).alias("z"), no_minus(F.round("r.back", 4)).alias("back"))


def preset_start(stats):
    """Parameters of each preset after the proposed step; alpha and beta of `cmin` stay as the statistics give them."""
    step = lambda n: nrm.updated(n, nrm.preset(n), _STEP)
    return {"in": step("in"), "revin": step("revin"), "previn": step("previn"), "cmin": nrm.preset("cmin", stats)}


@query("nrm12_whole_panel_z_score", f"with {P}, s as (select round(sum(c)::double / count(*) / 100, 6) as m, round(sqrt(greatest(sum(c * c)::double / count(*) - (sum(c)::double / count(*)) * (sum(c)::double / count(*)), 0.0)) / 100, 6) as d from p) select series_id, t, round((c / 100.0 - m) / (d + 1e-8), 6) as z from p cross join s")
def whole_z(spark, sf_dir):
    p = src.events_hourly(spark, sf_dir)
    n, s1, s2 = F.count("*"), F.sum("c").cast("double"), F.sum(F.col("c") * F.col("c")).cast("double")
    s = p.agg(F.round(s1 / n / 100, 6).alias("m"), F.round(F.sqrt(F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0))) / 100, 6).alias("d"))
    return p.join(F.broadcast(s)).select("series_id", "t", F.round((F.col("c") / 100 - F.col("m")) / (F.col("d") + win.EPS), 6).alias("z"))


@query("nrm13_target_normalization", rows_sql("cast(q.c as double)") + f" select series_id, t, step, round((y / 100.0 - {_MEANX}) / ({_STDX} + 1e-8), 6) as z from l")
def target_normalization(spark, sf_dir):
    rows = evaluated(spark, sf_dir)
    mean, dev = F.col("s1").cast("double") / F.col("n") / 100, win.std(F.col("n"), F.col("s1"), F.col("s2")) / 100 + win.EPS
    return rows.select("series_id", "t", F.col("step").cast("long").alias("step"), F.round((F.col("y") / 100 - mean) / dev, 6).alias("z"))


@query("nrm16_statistics_fallback", f"{BASE}, s as (select split, avg(case when mx > mn then s1::double / n / 100 end) as m from q group by 1) select w.split, round(coalesce(s.m, tr.m, 0.0), 6) as mean from (values ('train'), ('valid1'), ('test1'), ('test2')) w(split) left join s using (split) cross join (select m from s where split = 'train') tr")
def statistics_fallback(spark, sf_dir):
    s = split_panel(spark, sf_dir).groupBy("split").agg(F.avg(F.when(F.col("mx") > F.col("mn"), F.col("s1").cast("double") / F.col("n") / 100)).alias("m"))
    asked = spark.createDataFrame([("train",), ("valid1",), ("test1",), ("test2",)], "split string")
    train = s.filter("split = 'train'").select(F.col("m").alias("train"))
    return asked.join(F.broadcast(s), "split", "left").join(F.broadcast(train)).select("split", F.round(F.coalesce("m", "train", F.lit(0.0)), 6).alias("mean"))


@query("jon11_cluster_parameters", f"with {M}, w as (select *, count(*) over x as n, cast(sum(c) over x as bigint) as s1, cast(sum(c::hugeint * c) over x as double) as s2 from p window x as (partition by series_id order by t rows between 5 preceding and current row)), k as (select * from (values (0, 1.1::double, 0.2::double), (2, 0.9, -0.1)) v(cluster_id, g, b)) select series_id, t, round(coalesce(k.g, 1.0) * (c / 100.0 - s1::double / n / 100) / (sqrt(greatest(n * s2 - s1::double * s1::double, 0.0)) / n / 100 + 1e-8) + coalesce(k.b, 0.0), 5) as z from w left join k using (cluster_id) where n = 6")
def cluster_parameters(spark, sf_dir):
    """Parameters of a series' cluster, or the shared ones where the cluster has none."""
    w = win.over(-5, 0)
    p = src.orders_monthly(spark, sf_dir).withColumn("n", F.count("c").over(w)).withColumn("s1", F.sum("c").over(w)).withColumn("s2", F.sum(F.col("c").cast("decimal(20,0)") * F.col("c").cast("decimal(18,0)")).over(w).cast("double")).filter("n = 6")
    k = spark.createDataFrame([(0, 1.1, 0.2), (2, 0.9, -0.1)], "cluster_id int, g double, b double")
    dev = F.sqrt(F.greatest(F.col("n") * F.col("s2") - F.col("s1").cast("double") * F.col("s1").cast("double"), F.lit(0.0))) / F.col("n") / 100 + win.EPS
    z = F.coalesce("g", F.lit(1.0)) * (F.col("c") / 100 - F.col("s1").cast("double") / F.col("n") / 100) / dev + F.coalesce("b", F.lit(0.0))
    return p.join(F.broadcast(k), "cluster_id", "left").select("series_id", "t", F.round(z, 5).alias("z"))
