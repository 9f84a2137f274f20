"""Queries on sampling, scalars, arrays, linear models, runs, catalogs, reports and experiment families."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as arr
from ..functions import scalars as sc
from ..operators import evaluate as ev
from ..operators import linear as lin
from ..operators import report as rep
from ..operators import sampling as smp
from ..operators import blocks, training
from ..operators import windows as win
from ..sources import panels as src
from .model_queries import PREDICTIONS, evaluated, no_minus, rows_sql, stat_windows, summary_sql
from .panel_queries import split_panel
from .registry import BASE, H, L, P, SPLITS, STD, WINDOWS, query

HOURLY = f"with {P}"
SEED = 7

# Splits, clusters and sampling ------------------------------------------------


@query("smp1_date_blocks", f"with {P}, {SPLITS} select split, lo, hi, hi - lo as dates from sp")
def date_blocks(spark, sf_dir):
    total = src.date_grid(src.table(spark, sf_dir, "events")).count()
    return spark.createDataFrame(win.split_ranges(total, [0.6, 0.2, 0.2]), "split string, lo long, hi long").withColumn("dates", F.col("hi") - F.col("lo"))


@query("smp2_split_names", "select * from (values (1, 0, 'test1'), (2, 0, 'train'), (2, 1, 'test1'), (3, 0, 'train'), (3, 1, 'valid1'), (3, 2, 'test1')) v(blocks, nth, name)")
def split_names(spark, sf_dir):
    return spark.createDataFrame([(k, i, n) for k, names in win.SPLIT_NAMES.items() for i, n in enumerate(names)], "blocks int, nth int, name string")


@query("smp3_individual_split", f"with u as (select distinct user_id as series_id from events), r as (select series_id, row_number() over (order by md5('{SEED}:' || series_id), series_id) as k, count(*) over () as n from u) select series_id, case when k <= cast(floor(0.6 * n) as bigint) then 'train' when k <= cast(floor(0.8 * n) as bigint) then 'valid2' else 'test2' end as split from r")
def individual_split(spark, sf_dir):
    users = src.table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id")).distinct()
    key = smp.draw_key(SEED, "series_id")
    n = users.count()
    k = win.ranked(users, [], F.substring(key, 1, 3), [key, "series_id"], "k")
    return k.select("series_id", F.when(F.col("k") <= math.floor(n * 0.6), "train").when(F.col("k") <= math.floor(n * 0.8), "valid2").otherwise("test2").alias("split"))


@query("smp5_iid_clusters", f"with u as (select distinct user_id as series_id from events), r as (select series_id, row_number() over (order by md5('{SEED}:' || series_id), series_id) as k, count(*) over () as n from u) select series_id, cast(case when k <= ceil(n / 3.0) then 0 when k <= ceil(n / 3.0) + ceil((n - ceil(n / 3.0)) / 2.0) then 1 else 2 end as int) as cluster_id from r")
def iid_clusters(spark, sf_dir):
    users = src.table(spark, sf_dir, "events").select(F.col("user_id").alias("series_id")).distinct()
    n = users.count()
    sizes = [n // 3 + (1 if i < n % 3 else 0) for i in range(3)]
    return smp.cluster_ids(users, sizes, SEED)


@query("srt7_largest_remainder", "with n as (select count(distinct user_id) as n from events), r as (select i, n * ratio as raw, n from n cross join (values (0, 0.5::double), (1, 0.3), (2, 0.2)) v(i, ratio)), k as (select *, floor(raw) as base, row_number() over (order by raw - floor(raw) desc, i) as rank from r) select i, cast(base + case when rank <= n - (select sum(base) from k) then 1 else 0 end as bigint) as size from k")
def remainder(spark, sf_dir):
    n = src.table(spark, sf_dir, "events").select("user_id").distinct().count()
    return spark.createDataFrame([(i, s) for i, s in enumerate(smp.largest_remainder(n, [0.5, 0.3, 0.2]))], "i int, size long")


@query("smp7_random_date", f"{BASE}, d as (select distinct t from q where split = 'train'), one as (select t from d order by md5('{SEED}:' || t), t limit 1), u as (select q.series_id, q.t, row_number() over (order by md5('{SEED}:' || q.series_id || ':' || q.t), q.series_id) as k from q join one on one.t = q.t where split = 'train') select series_id, t from u where k <= 64")
def random_date(spark, sf_dir):
    q = split_panel(spark, sf_dir).filter("split = 'train'")
    one = q.select("t").distinct().orderBy(smp.draw_key(SEED, "t"), "t").limit(1)
    return q.join(F.broadcast(one), "t", "left_semi").orderBy(smp.draw_key(SEED, "series_id", "t"), "series_id").limit(64).select("series_id", "t")


@query("smp8_users_of_each_date", f"{BASE}, u as (select split, t, series_id, row_number() over (partition by split, t order by md5('{SEED}:' || series_id || ':' || t), series_id) as k from q) select split, t, series_id from u where k <= 4")
def users_of_date(spark, sf_dir):
    return smp.first_by(split_panel(spark, sf_dir), ["split", "t"], smp.draw_key(SEED, "series_id", "t"), ["series_id"], 4).select("split", "t", "series_id")


@query("smp9_date_of_each_user", f"{BASE}, u as (select split, t, series_id, row_number() over (partition by split, series_id order by md5('{SEED}:' || series_id || ':' || t), t) as k from q where mx > mn) select split, t, series_id from u where k = 1")
def date_of_user(spark, sf_dir):
    return smp.first_by(split_panel(spark, sf_dir).filter("mx > mn"), ["split", "series_id"], smp.draw_key(SEED, "series_id", "t"), ["t"], 1).select("split", "t", "series_id")


@query("smp10_all_pairs", f"{BASE} select split, t, series_id from q")
def all_pairs(spark, sf_dir):
    return split_panel(spark, sf_dir).select("split", "t", "series_id")


@query("smp11_weighted_draws", f"{BASE}, u as (select q.split, q.t, q.series_id, w.draw, row_number() over (partition by split, series_id, w.draw order by md5('{SEED}:' || series_id || ':' || t || ':' || w.draw), t) as k from q cross join (select unnest(range(1, 4)) as draw) w) select split, series_id, draw, t from u where k = 1")
def weighted(spark, sf_dir):
    q = split_panel(spark, sf_dir).select("split", "t", "series_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("draw"))
    return smp.first_by(q, ["split", "series_id", "draw"], smp.draw_key(SEED, "series_id", "t", "draw"), ["t"], 1).select("split", "series_id", "draw", "t")


@query("smp12_subset_of_dates", f"{BASE}, d as (select distinct t from q where split = 'train'), k as (select t from d order by md5('{SEED}:' || t), t limit (select greatest(1, cast(floor(count(*) * 0.25) as bigint)) from d)) select q.series_id, q.t from q join k on k.t = q.t where split = 'train'")
def subset_dates(spark, sf_dir):
    q = split_panel(spark, sf_dir).filter("split = 'train'")
    return q.join(F.broadcast(smp.sample_keys(q.select("t").distinct(), "t", 0.25, SEED)), "t", "left_semi").select("series_id", "t")


@query("smp13_shuffled_batches", f"{BASE} select split, series_id, t, (row_number() over (partition by split order by md5('{SEED}:' || series_id || ':' || t), series_id, t) - 1) // 256 as batch from q")
def shuffled(spark, sf_dir):
    return smp.batches(split_panel(spark, sf_dir), ["split"], SEED, ["series_id", "t"], 256).select("split", "series_id", "t", "batch")


@query("smp14_reduced_samples", f"{BASE}, d as (select t, row_number() over (order by t) - 1 as i from (select distinct t from q where split = 'train')) select q.series_id, q.t from q join d on d.t = q.t where split = 'train' and i % 4 = 0 and q.series_id % 2 = 0")
def reduced(spark, sf_dir):
    q = split_panel(spark, sf_dir).filter("split = 'train' and series_id % 2 = 0")
    d = q.select("t").distinct().withColumn("i", F.row_number().over(Window.orderBy("t")) - 1).filter("i % 4 = 0")
    return q.join(F.broadcast(d), "t", "left_semi").select("series_id", "t")


@query("smp16_sample_groups", f"{BASE} select split, series_id, t, dense_rank() over (partition by split order by t) - 1 as item from q")
def groups(spark, sf_dir):
    """Items are dates, so only distinct dates are numbered: pairs of a date never meet in one task for it."""
    q = split_panel(spark, sf_dir).select("split", "series_id", "t")
    dates = q.select("split", "t").distinct().withColumn("item", (F.row_number().over(Window.partitionBy("split").orderBy("t")) - 1).cast("long"))
    return q.join(F.broadcast(dates), ["split", "t"])


@query("smp18_clustered_statistics", f"{BASE} select q.split, cast(q.series_id % 3 as int) as cluster_id, count(*) as windows, count(distinct q.series_id) as users, round(avg(s1::double / n / 100), 6) as mean from q group by 1, 2")
def clustered(spark, sf_dir):
    q = split_panel(spark, sf_dir).withColumn("cluster_id", (F.col("series_id") % 3).cast("int"))
    return q.groupBy("split", "cluster_id").agg(F.count("*").alias("windows"), F.count_distinct("series_id").alias("users"), F.round(F.avg(F.col("s1").cast("double") / F.col("n") / 100), 6).alias("mean"))


@query("agg9_bounded_statistics", f"{BASE}, k as (select *, row_number() over (partition by split order by md5('{SEED}:' || series_id || ':' || t), series_id, t) as nth from q) select split, count(*) as windows, round(avg(s1::double / n / 100), 6) as mean, max(mx) as most from k where nth <= 500 group by 1")
def bounded(spark, sf_dir):
    kept = smp.first_by(split_panel(spark, sf_dir), ["split"], smp.draw_key(SEED, "series_id", "t"), ["series_id", "t"], 500)
    return kept.groupBy("split").agg(F.count("*").alias("windows"), F.round(F.avg(F.col("s1").cast("double") / F.col("n") / 100), 6).alias("mean"), F.max("mx").alias("most"))


@query("srt3_window_limit", f"{BASE} select series_id, t from q where split = 'train' order by t, series_id limit 1000")
def window_limit(spark, sf_dir):
    return split_panel(spark, sf_dir).filter("split = 'train'").orderBy("t", "series_id").limit(1000).select("series_id", "t")


# Scalars ------------------------------------------------------------------------


@query("scl2_transcendentals", "select l_orderkey, l_linenumber, l_partkey, round(asinh(l_discount * 10), 6) as a, round(sinh(l_discount), 6) as s, round(1 / (1 + exp(-l_discount)), 6) as g, round(tanh(l_tax), 6) as h from lineitem")
def transcendentals(spark, sf_dir):
    d = F.col("l_discount")
    return src.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.asinh(d * 10), 6).alias("a"), F.round(F.sinh(d), 6).alias("s"), F.round(1 / (1 + F.exp(-d)), 6).alias("g"), F.round(F.tanh("l_tax"), 6).alias("h"))


@query("scl3_signed_powers", "select event_id, round((value - 50) * abs(value - 50), 4) as square, round(sign(value - 50) * sqrt(abs(value - 50) + 1e-8), 6) as root, cast(sign(value - 50) as double) as sgn, -(value - 50) as mirror from events")
def signed_powers(spark, sf_dir):
    x = F.col("value") - 50
    return src.table(spark, sf_dir, "events").select("event_id", F.round(sc.signed_square(x), 4).alias("square"), F.round(sc.signed_root(x), 6).alias("root"), F.signum(x).alias("sgn"), (-x).alias("mirror"))


@query("scl4_symlog", "select event_id, round(sign(value - 50) * ln(1 + abs((value - 50) / 0.5)) * 0.5, 6) as y from events")
def symlogs(spark, sf_dir):
    return src.table(spark, sf_dir, "events").select("event_id", F.round(sc.symlog(F.col("value") - 50, 0.5), 6).alias("y"))


@query("scl5_slugs", "select p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from part")
def slugs(spark, sf_dir):
    return src.table(spark, sf_dir, "part").select("p_partkey", sc.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query("scl6_latex_escape", r"select p_partkey, replace(replace(replace(replace('A&B_' || p_brand || ' 50%', '&', '\&'), '%', '\%'), '#', '\#'), '_', '\_') as text from part")
def latex(spark, sf_dir):
    return src.table(spark, sf_dir, "part").select("p_partkey", sc.latex_escape(F.concat(F.lit("A&B_"), "p_brand", F.lit(" 50%"))).alias("text"))


@query("scl10_number_format", "select l_linenumber, printf('%.3f', m) || case when n > 1 then ' ± ' || printf('%.3f', s) else '' end as shown from (select l_linenumber, avg(l_quantity) as m, stddev_samp(l_quantity) as s, count(*) as n from lineitem group by 1)")
def number_format(spark, sf_dir):
    g = src.table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("s"))
    return g.select("l_linenumber", sc.number(F.col("m"), F.col("s"), 3).alias("shown"))


@query("scl11_setting_parse", "select distinct l_linenumber, cast(24 * l_linenumber as int) as lookback, cast(6 * l_linenumber as int) as horizon from lineitem")
def setting_parse(spark, sf_dir):
    text = F.concat_ws("_", F.col("l_linenumber") * 24, F.col("l_linenumber") * 6)
    a, b = sc.setting(text)
    return src.table(spark, sf_dir, "lineitem").select("l_linenumber", a.alias("lookback"), b.alias("horizon")).distinct()


@query("scl12_gates", f"{BASE} select split, series_id, t, round(greatest(least(1 + 0.5 * (1 / ({STD} / 100 + 1e-8) - 1), 1.0), 0.0), 6) as gate from q where mx > mn")
def gates(spark, sf_dir):
    dev = win.std(F.col("n"), F.col("s1"), F.col("s2")) / 100
    return split_panel(spark, sf_dir).filter("mx > mn").select("split", "series_id", "t", F.round(sc.clamp(sc.gate(0.5, dev)), 6).alias("gate"))


@query("scl13_time_features", f"{HOURLY} select t, coalesce(nullif(round(sin(2 * pi() * extract(hour from ts) / 24), 6), 0), 0) as sin_hour, coalesce(nullif(round(cos(2 * pi() * extract(hour from ts) / 24), 6), 0), 0) as cos_hour from g")
def time_features(spark, sf_dir):
    angle = F.lit(2.0) * F.pi() * F.hour("ts") / 24
    return src.date_grid(src.table(spark, sf_dir, "events")).select("t", no_minus(F.round(F.sin(angle), 6)).alias("sin_hour"), no_minus(F.round(F.cos(angle), 6)).alias("cos_hour"))


# Arrays --------------------------------------------------------------------------

E = "e as (select vec_id, [round(x::double, 4) for x in embedding] as x from embeddings), v as (select vec_id, unnest(x) as x, unnest(range(len(x))) as i, len(x) as n from e)"


def vectors(spark, sf_dir):
    return src.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("x"))


def spread(frame, name):
    return frame.select("vec_id", F.posexplode(name).alias("i", name)).select("vec_id", F.col("i").cast("long").alias("i"), no_minus(F.round(name, 6)).alias(name))


def clean_sql(x):
    return f"coalesce(nullif(round({x}, 6), 0), 0)"


@query("win4_moving_average", f"with {E}, m as (select a.vec_id, a.i, k.d, b.x from v a cross join (select unnest(range(-12, 13)) as d) k join v b on b.vec_id = a.vec_id and b.i = greatest(0, least(a.n - 1, a.i + k.d))) select vec_id, i, {clean_sql('sum(x) / 25')} as trend from m group by 1, 2")
def moving_average(spark, sf_dir):
    return spread(vectors(spark, sf_dir).select("vec_id", arr.moving_average(F.col("x")).alias("trend")), "trend")


@query("win5_decomposition", f"with {E}, m as (select a.vec_id, a.i, a.x as own, k.d, b.x from v a cross join (select unnest(range(-12, 13)) as d) k join v b on b.vec_id = a.vec_id and b.i = greatest(0, least(a.n - 1, a.i + k.d))) select vec_id, i, {clean_sql('max(own) - sum(x) / 25')} as residual from m group by 1, 2")
def decomposition(spark, sf_dir):
    return spread(vectors(spark, sf_dir).select("vec_id", arr.decompose(F.col("x"))[0].alias("residual")), "residual")


@query("win6_gaussian_smoothing", f"with {E}, w as (select d, exp(-(d * d) / 2.0) / (select sum(exp(-(d * d) / 2.0)) from (select unnest(range(-2, 3)) as d)) as w from (select unnest(range(-2, 3)) as d)) select a.vec_id, a.i, {clean_sql('sum(b.x * w.w)')} as smooth from v a cross join w join v b on b.vec_id = a.vec_id and b.i = a.i + w.d group by 1, 2")
def smoothing(spark, sf_dir):
    return spread(vectors(spark, sf_dir).select("vec_id", arr.smooth(F.col("x")).alias("smooth")), "smooth")


@query("win7_patches", f"with {E}, k as (select distinct vec_id, n, unnest(range(0, (n + 8 - 16) // 8 + 1)) as patch from v) select k.vec_id, k.patch, {clean_sql('sum(b.x)')} as total, arg_max(b.x, d.d) as last from k cross join (select unnest(range(16)) as d) d join v b on b.vec_id = k.vec_id and b.i = least(k.n - 1, k.patch * 8 + d.d) group by 1, 2")
def patching(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode(arr.patches(F.col("x"))).alias("patch", "p"))
    return rows.select("vec_id", F.col("patch").cast("long").alias("patch"), no_minus(F.round(F.aggregate("p", F.lit(0.0), lambda s, v: s + v), 6)).alias("total"), F.element_at("p", -1).alias("last"))


@query("win8_phase_values", f"with {E} select a.vec_id, s.step, round(avg(a.x), 6) as mean, count(*) as cycles from v a cross join (select unnest(range(1, 7)) as step) s where a.i % 12 = (a.n + s.step - 1) % 12 group by 1, 2")
def phase_values(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", "x", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))).alias("step"))
    phase = F.expr("filter(x, (v, i) -> i % 12 = (size(x) + step - 1) % 12)")
    return rows.select("vec_id", "step", F.round(F.aggregate(phase, F.lit(0.0), lambda s, v: s + v) / F.size(phase), 6).alias("mean"), F.size(phase).cast("long").alias("cycles"))


COV = "c as (select vec_id, case vec_id % 4 when 0 then x[1:1] when 1 then x[1:24] when 2 then x[1:6] else x[1:30] end as x from e)"


def covariates(spark, sf_dir):
    n = F.element_at(F.array(F.lit(1), F.lit(24), F.lit(6), F.lit(30)), (F.col("vec_id") % 4 + 1).cast("int"))
    return vectors(spark, sf_dir).select("vec_id", F.slice("x", F.lit(1), n).alias("x"))


@query("cov1_kinds", f"with {E}, {COV} select vec_id, case len(x) when 1 then 'static' when 24 then 'past' when 6 then 'future' else 'both' end as kind from c")
def kinds(spark, sf_dir):
    return covariates(spark, sf_dir).select("vec_id", arr.kind(F.col("x"), L, H).alias("kind"))


@query("cov2_coerced", f"with {E}, {COV} select vec_id, case len(x) when 1 then 24 when 24 then 24 when 30 then 24 end as past, case len(x) when 1 then 6 when 6 then 6 when 30 then 6 end as future, round(case len(x) when 30 then x[25] when 6 then x[1] when 1 then x[1] end, 6) as first_future from c")
def coerced(spark, sf_dir):
    past, future = arr.coerce(F.col("x"), L, H)
    size = lambda x: F.when(x.isNotNull(), F.size(x))
    return covariates(spark, sf_dir).select("vec_id", size(past).alias("past"), size(future).alias("future"), F.round(F.when(future.isNotNull(), future[0]), 6).alias("first_future"))


@query("cov3_merged_channels", f"with {E} select vec_id, cast(2 * len(x) as int) as n, {clean_sql('2 * list_sum(x)')} as total from e")
def merged_channels(spark, sf_dir):
    both = vectors(spark, sf_dir).select("vec_id", F.concat("x", "x").alias("y"))
    return both.select("vec_id", F.size("y").alias("n"), no_minus(F.round(F.aggregate("y", F.lit(0.0), lambda s, v: s + v), 6)).alias("total"))


@query("cov4_generated_channels", f"with {E} select vec_id, m as channel, {clean_sql('''case m when 'identity' then sum(x) when 'square' then sum(x * abs(x)) when 'root' then sum(sign(x) * sqrt(abs(x) + 1e-8)) when 'sign' then sum(sign(x)) else sum(-x) end''')} as total from v cross join (values ('identity'), ('square'), ('root'), ('sign'), ('mirror')) t(m) group by 1, 2")
def generated(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", F.explode(arr.channels(F.col("x"))).alias("channel", "y")).filter("channel <> 'kernel'")
    return rows.select("vec_id", "channel", no_minus(F.round(F.aggregate("y", F.lit(0.0), lambda s, v: s + v), 6)).alias("total"))


@query("cov5_constant_channel", f"with {E} select vec_id, cast(len(x) as int) as n, 1.5::double as value from e")
def constant_channel(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.array_repeat(F.lit(1.5), F.size("x")).alias("y")).select("vec_id", F.size("y").alias("n"), F.element_at("y", 1).alias("value"))


NOISE = arr.covariate_modes([{"name": "noise", "count": 2, "scale": 0.5, "target": "future_included"}])[0]
_BITS = "(('0x' || substr(k, {}, 8))::bigint + 1) / 4294967297.0"


@query("cov5_noise_channels", f"with {E}, n as (select vec_id, c.c as channel, i.i, md5('{SEED}:' || vec_id || ':' || c.c || ':' || i.i) as k from e cross join (select unnest(range(2)) as c) c cross join (select unnest(range({L + H})) as i) i), z as (select *, 0.5 * (sqrt(-2 * ln({_BITS.format(1)})) * cos(2 * pi() * {_BITS.format(9)})) as z from n) select vec_id, cast(channel as int) as channel, cast(count(*) filter (where i < {L}) as int) as past, cast(count(*) filter (where i >= {L}) as int) as future, {clean_sql(f'sum(z) filter (where i < {L})')} as past_total, {clean_sql(f'sum(z) filter (where i >= {L})')} as future_total from z group by 1, 2")
def noise_channels(spark, sf_dir):
    total = lambda x: no_minus(F.round(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), 6))
    pairs = F.array(*(F.struct(F.lit(k).alias("channel"), past.alias("past"), future.alias("future")) for k, (past, future) in enumerate(arr.generated(NOISE, L, H, F.col("vec_id"), seed=SEED))))
    rows = src.table(spark, sf_dir, "embeddings").select("vec_id", F.explode(pairs).alias("z"))
    return rows.select("vec_id", "z.channel", F.size("z.past").alias("past"), F.size("z.future").alias("future"), total(F.col("z.past")).alias("past_total"), total(F.col("z.future")).alias("future_total"))


@query("cov6_id_as_context", f"{BASE} select split, series_id, t, cast(series_id as double) as context from q")
def id_context(spark, sf_dir):
    return split_panel(spark, sf_dir).select("split", "series_id", "t", F.col("series_id").cast("double").alias("context"))


# Linear models ---------------------------------------------------------------------


def linear_windows(spark, sf_dir, split, panel=None):
    panel = src.events_hourly(spark, sf_dir) if panel is None else panel
    spans = win.split_ranges(win.dates_of(panel), [0.6, 0.2, 0.2])
    return blocks.windows(panel, [s for s in spans if s[0] == split], L, H, H).filter("mx > mn")


def scored(windows):
    rows = windows.select("series_id", "t", "c", "n", "s1", "s2", F.posexplode(F.arrays_zip("y", "pred")).alias("step", "z"))
    return ev.losses(rows.select("series_id", "t", "n", "s1", "s2", (F.col("step") + 1).alias("step"), F.col("z.y").alias("y"), F.col("z.pred").alias("pred")))


@query("mdl7_least_squares")
def least_squares(spark, sf_dir):
    w = lin.fit_linear(linear_windows(spark, sf_dir, "train"))
    return ev.summaries(scored(lin.predict_linear(linear_windows(spark, sf_dir, "test1"), w)), "mse")


@query("mdl8_ridge")
def ridge(spark, sf_dir):
    w = lin.fit_linear(linear_windows(spark, sf_dir, "train"), ridge=1e6)
    return ev.summaries(scored(lin.predict_linear(linear_windows(spark, sf_dir, "test1"), w)), "mse")


@query("mdl9_linear_adam")
def adam(spark, sf_dir):
    w = lin.fit_adam(linear_windows(spark, sf_dir, "train"))
    return ev.summaries(scored(lin.predict_linear(linear_windows(spark, sf_dir, "test1"), w)), "mse")


@query("mdl16_weights")
def weights(spark, sf_dir):
    return lin.weights_table(spark, lin.fit_linear(linear_windows(spark, sf_dir, "train")))


REG = f"{BASE}, r as (select q.series_id, y.t - q.t as step, cast(q.c as double) as x, cast(y.c as double) as y from q join p y on y.series_id = q.series_id and y.t > q.t and y.t <= q.t + 6 where q.split = 'train' and mx > mn)"


@query("mdl6_one_lag_regression", f"{REG} select step, round(regr_slope(y, x), 5) as slope, round(regr_intercept(y, x), 2) as intercept from r group by 1")
def one_lag(spark, sf_dir):
    rows = linear_windows(spark, sf_dir, "train").select("c", F.posexplode("y").alias("step", "y"))
    x, y = F.col("c").cast("double"), F.col("y").cast("double")
    return rows.groupBy((F.col("step") + 1).cast("long").alias("step")).agg(F.round(F.regr_slope(y, x), 5).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"))


@query("mdl15_per_user_regression", f"{REG} select series_id, step, round(regr_slope(y, x), 5) as slope, round(regr_intercept(y, x), 2) as intercept from r group by 1, 2")
def per_user(spark, sf_dir):
    """As in SQL, a user whose last values are all equal has a slope that isn't a number, and no intercept."""
    fitted = lin.fit_per_series(linear_windows(spark, sf_dir, "train"))
    known = F.col("slope").isNotNull()
    slope, intercept = F.when(known, no_minus(F.round("slope", 5))).otherwise(float("nan")), F.when(known, no_minus(F.round("intercept", 2)))
    return fitted.select("series_id", F.col("step").cast("long").alias("step"), slope.alias("slope"), intercept.alias("intercept"))


@query("mdl10_decomposed_at_start", f"{BASE}, d as (select q.series_id, q.t, sum(x.c) / 24.0 / 100 as pred from q join p x on x.series_id = q.series_id and x.t between q.t - 23 and q.t where split = 'test1' group by 1, 2) select series_id, t, round(pred, 6) as pred from d")
def decomposed(spark, sf_dir):
    """Residual and trend heads that start at 1/L give the lookback's mean. Both are linear in the lags, so the two heads are one product."""
    heads, _ = training.two_heads(L)
    one = np.r_[np.full(L, 1 / L), 0.0]
    done = lin.predict_linear(linear_windows_all(spark, sf_dir).filter("series_id is not null").select("series_id", "t", "x"), heads @ np.r_[one, one][:, None])
    return done.select("series_id", "t", F.round(F.col("pred")[0] / 100, 6).alias("pred"))


def linear_windows_all(spark, sf_dir):
    panel = src.events_hourly(spark, sf_dir)
    spans = win.split_ranges(win.dates_of(panel), [0.6, 0.2, 0.2])[-1:]
    return blocks.windows(panel, spans, L, H, H)


# Catalog -----------------------------------------------------------------------------

CAT = """d as (select l_shipmode_ as dataset, ts, c from (select 'supplier' || (l_suppkey % 10) as l_shipmode_, date_trunc('month', l_shipdate) as ts, count(*) as c from lineitem group by 1, 2)),
k as (select dataset, ts, c, lag(ts) over (partition by dataset order by ts) as before from d),
m as (select dataset, count(*) as dates, min(ts) as first, max(ts) as last, count(distinct date_diff('month', before, ts)) as gaps, max(date_diff('month', before, ts)) as gap, cast(sum(c) as bigint) as lines from k group by 1)"""


def catalog(spark, sf_dir):
    lines = src.table(spark, sf_dir, "lineitem")
    d = lines.groupBy(F.concat(F.lit("supplier"), F.col("l_suppkey") % 10).alias("dataset"), F.date_trunc("month", "l_shipdate").alias("ts")).agg(F.count("*").alias("c"))
    gap = F.months_between("ts", F.lag("ts").over(Window.partitionBy("dataset").orderBy("ts"))).cast("long")
    return d.withColumn("gap", gap).groupBy("dataset").agg(F.count("*").alias("dates"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("gap").alias("gaps"), F.max("gap").alias("gap"), F.sum("c").alias("lines"))


@query("agg27_frequency", f"with {CAT} select dataset, dates, first, last, gaps = 1 and gap = 1 as regular from m")
def frequency(spark, sf_dir):
    return catalog(spark, sf_dir).select("dataset", "dates", "first", "last", ((F.col("gaps") == 1) & (F.col("gap") == 1)).alias("regular"))


@query("flt19_admission", f"with {CAT} select dataset, case when not (gaps = 1 and gap = 1) then 'irregular' when dates < 30 then 'too_short' when lines > 1000000000 then 'too_many' else 'eligible' end as reason from m")
def admission(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c.select("dataset", F.when(~((F.col("gaps") == 1) & (F.col("gap") == 1)), "irregular").when(F.col("dates") < 30, "too_short").when(F.col("lines") > 1_000_000_000, "too_many").otherwise("eligible").alias("reason"))


@query("agg25_window_counts", f"with {CAT} select dataset, greatest(dates - 30, -1) + 1 as stride_1, case when dates >= 30 then 1 + (dates - 30) // 6 else 0 end as stride_h from m")
def window_counts(spark, sf_dir):
    room = F.col("dates") - (L + H)
    return catalog(spark, sf_dir).select("dataset", (F.greatest(room, F.lit(-1)) + 1).alias("stride_1"), F.when(room >= 0, 1 + F.floor(room / H)).otherwise(0).cast("long").alias("stride_h"))


@query("agg26_catalog_totals", f"with {CAT} select count(*) as datasets, cast(sum(dates) as bigint) as dates, cast(sum(lines) as bigint) as lines from m")
def totals(spark, sf_dir):
    return catalog(spark, sf_dir).agg(F.count("*").alias("datasets"), F.sum("dates").alias("dates"), F.sum("lines").alias("lines"))


# Runs and reports ---------------------------------------------------------------------

RUNS = "runs as (select o_custkey as identity, o_orderpriority as signature, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as run_index, o_orderdate as finished_at, o_orderstatus as status, o_totalprice as price, o_orderkey as run_id from orders)"


def runs(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("identity"), F.col("o_orderpriority").alias("signature"), F.row_number().over(w).alias("run_index"), F.col("o_orderdate").alias("finished_at"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("run_id"))


@query("win10_latest_run", f"with {RUNS} select identity, arg_max(run_id, run_index) as run_id, max(finished_at) as finished_at from runs group by 1")
def latest_run(spark, sf_dir):
    return rep.latest_runs(runs(spark, sf_dir), ["identity"]).select("identity", "run_id", "finished_at")


@query("run4_distinct_latest", f"with {RUNS} select identity, signature, run_id, identity || '__' || signature as label from (select *, row_number() over (partition by identity, signature order by finished_at desc, run_index desc) as nth from runs) where nth = 1")
def distinct_latest(spark, sf_dir):
    return rep.select_runs(runs(spark, sf_dir), "distinct", "latest", ["identity"]).select("identity", "signature", "run_id", "label")


@query("run4_latest_config", f"with {RUNS}, k as (select *, first_value(signature) over (partition by identity order by finished_at desc, run_index desc) as newest from runs) select identity, run_id, identity || '__' || signature || '__run_' || run_index as label from k where signature = newest")
def latest_config(spark, sf_dir):
    return rep.select_runs(runs(spark, sf_dir), "latest", "distinct", ["identity"]).select("identity", "run_id", "label")


@query("run4_average_configs", f"with {RUNS} select identity || '__average' as label, count(*) as runs, sum(cast(round(price * 100) as bigint))::double / count(*) as price_cents from runs group by 1")
def average_configs(spark, sf_dir):
    picked = rep.select_runs(runs(spark, sf_dir), "average", "average", ["identity"])
    return picked.groupBy("label").agg(F.count("*").alias("runs"), (F.sum(src.cents(F.col("price"))).cast("double") / F.count("*")).alias("price_cents"))


@query("flt21_config_filter", f"with {RUNS} select identity, run_id from runs where signature = '1-URGENT' and status = 'O'")
def config_filter(spark, sf_dir):
    config = F.create_map(F.lit("train.priority"), F.col("signature"), F.lit("train.status"), F.col("status"))
    rows = runs(spark, sf_dir).withColumn("config", config)
    return rows.filter((F.col("config")["train.priority"] == "1-URGENT") & (F.col("config")["train.status"] == "O")).select("identity", "run_id")


@query("flt22_selectable_runs", f"with {RUNS} select identity, run_id from runs where status = 'F' or (status = 'P' and run_index > 2 and identity % 2 = 0)")
def selectable_runs(spark, sf_dir):
    status = F.when(F.col("status") == "F", "completed").when(F.col("status") == "P", "running").otherwise("interrupted")
    return runs(spark, sf_dir).filter(rep.selectable(status, F.col("run_index") > 2, F.col("identity") % 2 == 0)).select("identity", "run_id")


@query("set4_purposes", f"with {RUNS} select identity, string_agg(distinct status, ',' order by status) as purposes, bool_or(status in ('F', 'P')) as overlaps from runs group by 1")
def purposes(spark, sf_dir):
    sets = runs(spark, sf_dir).groupBy("identity").agg(F.array_sort(F.collect_set("status")).alias("p"))
    return sets.select("identity", F.array_join("p", ",").alias("purposes"), F.arrays_overlap("p", F.array(F.lit("F"), F.lit("P"))).alias("overlaps"))


@query("set5_differing_keys", f"with {RUNS}, k as (select identity, 'priority' as key, signature as value from runs union all select identity, 'status', status from runs) select identity, key, count(distinct value) as values from k group by 1, 2 having count(distinct value) > 1")
def differing(spark, sf_dir):
    config = F.create_map(F.lit("priority"), F.col("signature"), F.lit("status"), F.col("status"))
    return rep.differing_keys(runs(spark, sf_dir).withColumn("config", config), ["identity"])


@query("src14_manifest_scan", f"with {RUNS} select identity, count(*) as manifests from runs where status <> 'P' group by 1")
def manifest_scan(spark, sf_dir):
    return runs(spark, sf_dir).filter("status <> 'P'").groupBy("identity").agg(F.count("*").alias("manifests"))


RES = """res as (select l_returnflag || l_linestatus as dataset, cast(24 * l_linenumber as int) || '_' || cast(6 * l_linenumber as int) as setting, o_orderpriority as method, cast(l_suppkey % 3 as int) as seed, round(avg(l_extendedprice * l_discount), 4) as value from lineitem join orders on o_orderkey = l_orderkey group by all),
tab as (select dataset, setting, method, round(avg(value), 4) as mean, round(case when count(*) > 1 then stddev_samp(value) end, 3) as dev, count(*) as seeds from res group by 1, 2, 3)"""


def results(spark, sf_dir):
    lines, orders = src.table(spark, sf_dir, "lineitem"), src.table(spark, sf_dir, "orders")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    keys = [F.concat("l_returnflag", "l_linestatus").alias("dataset"), F.concat_ws("_", F.col("l_linenumber") * 24, F.col("l_linenumber") * 6).alias("setting"), F.col("o_orderpriority").alias("method"), (F.col("l_suppkey") % 3).cast("int").alias("seed")]
    return rows.groupBy(*keys).agg(F.round(F.avg(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("value"))


def table_of_results(spark, sf_dir):
    t = rep.over_seeds(results(spark, sf_dir), ["dataset", "setting", "method"])
    return t.select("dataset", "setting", "method", F.round("mean", 4).alias("mean"), F.round("dev", 3).alias("dev"), "seeds")


@query("agg19_over_seeds", f"with {RES} select * from tab")
def over_seeds(spark, sf_dir):
    return table_of_results(spark, sf_dir)


@query("agg20_improvements", f"""with {RES}, b as (select dataset, setting, mean as reference from tab where method = '5-LOW'), i as (select t.dataset, t.setting, t.method, case when b.reference <> 0 then (b.reference - t.mean) / abs(b.reference) * 100 end as gain from tab t left join b using (dataset, setting) where t.method <> '5-LOW')
select dataset, setting, method, round(avg(gain), 4) as gain from i group by grouping sets ((dataset, method), (setting, method), (method))""")
def improvements(spark, sf_dir):
    both = rep.compare(table_of_results(spark, sf_dir), "5-LOW", ["dataset", "setting"]).filter("method <> '5-LOW'")
    return both.groupingSets([["dataset", "method"], ["setting", "method"], ["method"]], "dataset", "setting", "method").agg(F.round(F.avg("gain"), 4).alias("gain"))


@query("agg21_scale_exponent", f"with {RES} select setting, cast(floor(log10(quantile_cont(case when mean <> 0 then abs(mean) end, 0.5))) as bigint) as exponent from tab group by 1")
def exponent(spark, sf_dir):
    return table_of_results(spark, sf_dir).groupBy("setting").agg(rep.scale_exponent(F.col("mean")).alias("exponent"))


@query("agg22_best_cells", f"with {RES} select dataset, setting, method, abs(mean - min(mean) over (partition by dataset, setting)) <= abs(min(mean) over (partition by dataset, setting)) * 1e-12 as best from tab")
def best_cells(spark, sf_dir):
    return rep.best_flags(table_of_results(spark, sf_dir), ["dataset", "setting"]).select("dataset", "setting", "method", "best")


@query("agg23_finite_means", f"with {RES} select dataset, round(avg(value) filter (where isfinite(value)), 4) as mean, count(*) as n from res group by 1")
def finite_means(spark, sf_dir):
    ok = ~F.isnan("value") & (F.abs("value") < float("inf"))
    return results(spark, sf_dir).groupBy("dataset").agg(F.round(F.avg(F.when(ok, F.col("value"))), 4).alias("mean"), F.count("*").alias("n"))


METHODS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("agg24_pivot_means", f"with {RES} select dataset, setting, " + ", ".join(f"max(mean) filter (where method = '{m}') as m{m[0]}" for m in METHODS) + " from tab group by 1, 2")
def pivot_means(spark, sf_dir):
    t = table_of_results(spark, sf_dir).withColumn("m", F.concat(F.lit("m"), F.substring("method", 1, 1)))
    return t.groupBy("dataset", "setting").pivot("m", [f"m{i}" for i in range(1, 6)]).agg(F.max("mean"))


@query("jon13_dense_table", f"with {RES}, d as (select distinct dataset from res), s as (select distinct setting from res), m as (select distinct method from res) select d.dataset, s.setting, m.method, t.mean from d cross join s cross join m left join tab t using (dataset, setting, method)")
def dense_table(spark, sf_dir):
    """Names are few (datasets, settings, methods), so their product is small; results are joined to it."""
    t = table_of_results(spark, sf_dir)
    names = [F.broadcast(t.select(c).distinct()) for c in ("dataset", "setting", "method")]
    return names[0].crossJoin(names[1]).crossJoin(names[2]).join(t, ["dataset", "setting", "method"], "left").select("dataset", "setting", "method", "mean")


@query("jon14_results_of_selected_runs", f"with {RUNS}, s as (select identity, signature, arg_max(run_id, (finished_at, run_index)) as run_id from runs group by 1, 2) select s.run_id, s.signature, count(*) as losses, round(avg(l_discount), 6) as loss from s join lineitem on l_orderkey = s.run_id group by 1, 2")
def selected_results(spark, sf_dir):
    picked = rep.latest_runs(runs(spark, sf_dir), ["identity", "signature"]).select("run_id", "signature")
    lines = src.table(spark, sf_dir, "lineitem")
    return picked.join(lines, picked["run_id"] == lines["l_orderkey"]).groupBy("run_id", "signature").agg(F.count("*").alias("losses"), F.round(F.avg("l_discount"), 6).alias("loss"))


@query("flt20_report_filters", f"with {RES} select * from res where lower(dataset) in ('af', 'no') and setting = '24_6' and (method = '1-URGENT' or method like '2-%')")
def report_filters(spark, sf_dir):
    m = F.col("method")
    return results(spark, sf_dir).filter(F.lower("dataset").isin("af", "no") & (F.col("setting") == "24_6") & ((m == "1-URGENT") | m.startswith("2-")))


@query("flt23_metric_frame", f"with {RES} select dataset, method, value * 100 as value from res where dataset in ('AF', 'RF') and method in ('1-URGENT', '5-LOW') and setting = '48_12' and seed = 1")
def metric_frame(spark, sf_dir):
    return results(spark, sf_dir).filter(F.col("dataset").isin("AF", "RF") & F.col("method").isin("1-URGENT", "5-LOW") & (F.col("setting") == "48_12") & (F.col("seed") == 1)).select("dataset", "method", (F.col("value") * 100).alias("value"))


@query("srt4_natural_settings", f"with {RES} select setting, row_number() over (order by cast(split_part(setting, '_', 1) as int), cast(split_part(setting, '_', 2) as int)) as nth from (select distinct setting from res)")
def natural(spark, sf_dir):
    a, b = sc.setting(F.col("setting"))
    return results(spark, sf_dir).select("setting").distinct().withColumn("nth", F.row_number().over(Window.orderBy(a, b)).cast("long"))


@query("srt5_name_order", f"with {RES} select dataset, method, row_number() over (order by lower(dataset), lower(method)) as nth from (select distinct dataset, method from res)")
def name_order(spark, sf_dir):
    names = results(spark, sf_dir).select("dataset", "method").distinct()
    return names.withColumn("nth", F.row_number().over(Window.orderBy(F.lower("dataset"), F.lower("method"))).cast("long"))


@query("rpt1_comparison_table", f"""with {RES}, b as (select dataset, setting, mean as reference from tab where method = '5-LOW')
select t.dataset, t.setting, t.method, t.mean, t.dev, t.seeds, b.reference, round(case when b.reference <> 0 then (b.reference - t.mean) / abs(b.reference) * 100 end, 4) as gain, abs(t.mean - min(t.mean) over (partition by t.dataset, t.setting)) <= abs(min(t.mean) over (partition by t.dataset, t.setting)) * 1e-12 as best from tab t left join b using (dataset, setting)""")
def comparison(spark, sf_dir):
    t = rep.best_flags(rep.compare(table_of_results(spark, sf_dir), "5-LOW", ["dataset", "setting"]), ["dataset", "setting"])
    return t.select("dataset", "setting", "method", "mean", "dev", "seeds", "reference", no_minus_or_null(F.round("gain", 4)).alias("gain"), "best")


def no_minus_or_null(x):
    return F.when(x == 0, 0.0).otherwise(x)


@query("rpt3_table_with_improvements", f"with {RES}, b as (select dataset, setting, mean as reference from tab where method = '5-LOW') select dataset, setting, method, 0 as kind, mean as value from tab union all select t.dataset, t.setting, t.method, 1, round((b.reference - t.mean) / abs(b.reference) * 100, 4) from tab t join b using (dataset, setting) where t.method <> '5-LOW'")
def with_improvements(spark, sf_dir):
    t = table_of_results(spark, sf_dir)
    gains = rep.compare(t, "5-LOW", ["dataset", "setting"]).filter("method <> '5-LOW' and reference is not null")
    rows = t.select("dataset", "setting", "method", F.lit(0).alias("kind"), F.col("mean").alias("value"))
    return rows.unionByName(gains.select("dataset", "setting", "method", F.lit(1).alias("kind"), no_minus_or_null(F.round("gain", 4)).alias("value")))


@query("rpt7_dashboard_improvement", f"with {RES}, b as (select dataset, setting, mean as reference from tab where method = '5-LOW') select t.dataset, t.setting, t.method, round(case when b.reference <> 0 then (b.reference - t.mean) / b.reference * 100 end, 4) as gain from tab t join b using (dataset, setting) where t.method <> '5-LOW'")
def dashboard(spark, sf_dir):
    both = rep.compare(table_of_results(spark, sf_dir), "5-LOW", ["dataset", "setting"]).filter("method <> '5-LOW' and reference is not null")
    return both.select("dataset", "setting", "method", no_minus_or_null(F.round(F.when(F.col("reference") != 0, (F.col("reference") - F.col("mean")) / F.col("reference") * 100), 4)).alias("gain"))


@query("rpt4_example_forecast", rows_sql(*PREDICTIONS["expected"]) + " select series_id, t, step, round(pred / 100, 6) as pred, y / 100.0::double as y from l where t = (select max(t) from l)")
def example(spark, sf_dir):
    rows = evaluated(spark, sf_dir, "expected")
    last = rows.agg(F.max("t").alias("t"))
    return rows.join(F.broadcast(last), "t", "left_semi").select("series_id", "t", F.col("step").cast("long").alias("step"), F.round(F.col("pred") / 100, 6).alias("pred"), (F.col("y") / 100).alias("y"))


@query("agg28_family_aggregate", f"with {RES} select dataset as family, method, round(avg(value), 4) as mean, round(case when count(*) > 1 then stddev_samp(value) end, 3) as dev from res group by 1, 2")
def family(spark, sf_dir):
    t = rep.over_seeds(results(spark, sf_dir), ["dataset", "method"])
    return t.select(F.col("dataset").alias("family"), "method", F.round("mean", 4).alias("mean"), F.round("dev", 3).alias("dev"))


# Experiment families ---------------------------------------------------------------------


@query("fam1_constant_windows", f"""{BASE}, bad as (select distinct series_id from q where mx = mn), q2 as (select 'keep' as policy, q.* from q where split = 'test1' union all select 'remove_windows', q.* from q where split = 'test1' and mx > mn union all select 'drop_users', q.* from q where split = 'test1' and series_id not in (select series_id from bad)),
l as (select q2.policy, q2.series_id, power((y.c - q2.c) / 100.0, 2) as mse from q2 join p y on y.series_id = q2.series_id and y.t > q2.t and y.t <= q2.t + 6), {summary_sql('mse', 'policy')}""")
def constants(spark, sf_dir):
    panel = src.events_hourly(spark, sf_dir)
    q = blocks.windows(panel, win.split_ranges(win.dates_of(panel), [0.6, 0.2, 0.2]), L, H, H, past=False)
    bad = q.filter("mx = mn").select("series_id").distinct().withColumn("bad", F.lit(True))
    t = q.filter("split = 'test1'").join(bad, "series_id", "left")
    policies = F.filter(F.array(F.lit("keep"), F.when(F.col("mx") > F.col("mn"), "remove_windows"), F.when(F.col("bad").isNull(), "drop_users")), lambda x: x.isNotNull())
    rows = t.select(F.explode(policies).alias("policy"), "series_id", "c", "y").select("policy", "series_id", "c", F.explode("y").alias("y"))
    return ev.summaries(rows.withColumn("mse", F.pow((F.col("y") - F.col("c")) / 100, F.lit(2.0))), "mse", ["policy"])


@query("fam2_sampling_modes", f"""{BASE}, tr as (select * from q where split = 'train' and mx > mn), k as (select 'all' as mode, series_id, t from tr union all select 'dates', series_id, t from (select *, row_number() over (partition by t order by md5('{SEED}:' || series_id || ':' || t), series_id) as r from tr) where r <= 4
 union all select 'individuals', series_id, t from (select *, row_number() over (partition by series_id order by md5('{SEED}:' || series_id || ':' || t), t) as r from tr) where r = 1) select mode, count(*) as windows, count(distinct series_id) as users, count(distinct t) as dates from k group by 1""")
def sampling_modes(spark, sf_dir):
    tr = split_panel(spark, sf_dir).filter("split = 'train' and mx > mn")
    key = smp.draw_key(SEED, "series_id", "t")
    parts = {"all": tr, "dates": smp.first_by(tr, ["t"], key, ["series_id"], 4), "individuals": smp.first_by(tr, ["series_id"], key, ["t"], 1)}
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("mode"), "series_id", "t")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("mode").agg(F.count("*").alias("windows"), F.count_distinct("series_id").alias("users"), F.count_distinct("t").alias("dates"))


@query("fam5_losses", rows_sql(*PREDICTIONS["persistence"]) + " select m as loss, round(avg(case m when 'mse' then mse when 'mae' then mae when 'nmse' then nmse else nmae end), 6) as value from l cross join (values ('mse'), ('mae'), ('nmse'), ('nmae')) t(m) group by 1")
def losses_family(spark, sf_dir):
    means = evaluated(spark, sf_dir).agg(*(F.round(F.avg(m), 6).alias(m) for m in ("mse", "mae", "nmse", "nmae")))
    return means.unpivot([], ["mse", "mae", "nmse", "nmae"], "loss", "value")


@query("fam6_linear_models")
def linear_models(spark, sf_dir):
    panel = blocks.kept(src.events_hourly(spark, sf_dir))
    train, test = linear_windows(spark, sf_dir, "train", panel), linear_windows(spark, sf_dir, "test1", panel)
    fits = {"least_squares": lin.fit_linear(train), "ridge": lin.fit_linear(train, 1e6), "adam": lin.fit_adam(train)}
    out = ev.summaries(evaluated(spark, sf_dir), "mse").withColumn("method", F.lit("persistence"))
    for name, w in fits.items():
        out = out.unionByName(ev.summaries(scored(lin.predict_linear(test, w)), "mse").withColumn("method", F.lit(name)))
    return out


@query("fam7_central_and_per_user", f"""{BASE}, tr as (select q.series_id, y.t - q.t as step, cast(q.c as double) as x, cast(y.c as double) as y from q join p y on y.series_id = q.series_id and y.t > q.t and y.t <= q.t + 6 where q.split = 'train' and mx > mn),
ce as (select step, regr_slope(y, x) as a, regr_intercept(y, x) as b from tr group by 1), pu as (select series_id, step, regr_slope(y, x) as a, regr_intercept(y, x) as b from tr group by 1, 2),
te as (select q.series_id, y.t - q.t as step, q.c as x, y.c as y from q join p y on y.series_id = q.series_id and y.t > q.t and y.t <= q.t + 6 where q.split = 'test1' and mx > mn)
select 'central' as scope, round(avg(power((y - a * x - b) / 100, 2)), 3) as mse from te join ce using (step) union all select 'per_user', round(avg(power((y - a * x - b) / 100, 2)), 3) from te join pu using (series_id, step) where a is not null""")
def scopes(spark, sf_dir):
    train, test = linear_windows(spark, sf_dir, "train"), linear_windows(spark, sf_dir, "test1")
    rows = test.select("series_id", F.col("c").alias("x"), F.posexplode("y").alias("step", "y")).withColumn("step", F.col("step") + 1)
    own = lin.fit_per_series(train)
    all_ = train.select("c", F.posexplode("y").alias("step", "y")).groupBy((F.col("step") + 1).alias("step")).agg(F.regr_slope(F.col("y").cast("double"), F.col("c").cast("double")).alias("slope"), F.regr_intercept(F.col("y").cast("double"), F.col("c").cast("double")).alias("intercept"))
    mse = F.round(F.avg(F.pow((F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")) / 100, F.lit(2.0))), 3).alias("mse")
    central = rows.join(F.broadcast(all_), "step").agg(mse).select(F.lit("central").alias("scope"), "mse")
    return central.unionByName(rows.join(own, ["series_id", "step"]).filter("slope is not null").agg(mse).select(F.lit("per_user").alias("scope"), "mse"))
