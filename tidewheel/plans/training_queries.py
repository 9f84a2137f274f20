"""Queries on fitted models, data of plots, loader order and results that a run wrote."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import blocks, gates, training
from ..operators import evaluate as ev
from ..operators import linear as lin
from ..operators import normalize as nrm
from ..operators import report as rep
from ..operators import sampling as smp
from ..operators import windows as win
from ..sources import panels as src
from ..sources.shared import shared_path
from . import experiments as ex
from .model_queries import PREDICTIONS, evaluated, rows_sql
from .registry import BASE, H, L, query
from .report_queries import SEED, linear_windows, scored

# Data of plots -----------------------------------------------------------------------

WIDTH, BANDWIDTH, REACH, TILES = 0.1, 0.25, 10, 32


@query("rpt4_density", rows_sql(*PREDICTIONS["persistence"]) + f""", s as (select series_id, t, round(avg(mse), 4) as v from l group by 1, 2), b as (select cast(floor(log10(v) / {WIDTH}) as bigint) as bin, count(*) as n from s where v > 0 group by 1),
k as (select b.bin + o as bin, n * exp(-0.5 * power(o * {WIDTH} / {BANDWIDTH}, 2)) as w from b cross join (select unnest(range(-{REACH}, {REACH} + 1)) as o))
select bin, round(sum(w) / (select sum(n) from b) / {BANDWIDTH} / sqrt(2 * pi()), 6) as density from k group by 1""")
def density(spark, sf_dir):
    """The distribution of windows' losses on a logarithmic scale: counts on a fixed grid, smoothed by a Gaussian kernel."""
    samples = evaluated(spark, sf_dir).groupBy("series_id", "t").agg(F.round(F.avg("mse"), 4).alias("v"))
    return rep.binned_density(samples.filter("v > 0").select(F.log10("v").alias("v")), "v", WIDTH, BANDWIDTH, REACH).select("bin", F.round("density", 6).alias("density"))


@query("rpt4_heatmap", rows_sql(*PREDICTIONS["persistence"]) + f""", s as (select series_id, t, avg(mae) as v from l group by 1, 2), d as (select min(series_id) as a, max(series_id) as b, min(t) as c, max(t) as e from s)
select cast((series_id - a) * {TILES} // (b - a + 1) as bigint) as user_tile, cast((t - c) * {TILES} // (e - c + 1) as bigint) as date_tile, count(*) as windows, round(avg(v), 6) as mae from s cross join d group by 1, 2""")
def heatmap(spark, sf_dir):
    """Mean losses of tiles of users and dates: as many tiles whatever the panel's size."""
    samples = evaluated(spark, sf_dir).groupBy("series_id", "t").agg(F.avg("mae").alias("v"))
    tiles = rep.tiles(samples, "series_id", "t", TILES).groupBy("series_id_tile", "t_tile").agg(F.count("*").alias("windows"), F.round(F.avg("v"), 6).alias("mae"))
    return tiles.select(F.col("series_id_tile").alias("user_tile"), F.col("t_tile").alias("date_tile"), "windows", "mae")


# Loader order -------------------------------------------------------------------------


@query("trn10_loader_order", f"""{BASE}, o as (select e as epoch, series_id, t, row_number() over (partition by e order by md5('{SEED}:' || e || ':' || series_id || ':' || t), series_id, t) - 1 as nth from q cross join (values (0), (1)) v(e) where split = 'test1')
select epoch, nth, nth // 256 as batch, o.series_id, o.t as query_t, place as step, y.c from o cross join (select unnest(range(0, 30)) as place) join p y on y.series_id = o.series_id and y.t = o.t - 23 + place""")
def loader_order(spark, sf_dir):
    """Two epochs as a shuffling loader gives them: each window's place in the epoch is a sort key that stays with its unrolled steps."""
    panel = src.events_hourly(spark, sf_dir)
    w = blocks.windows(panel, win.split_ranges(win.dates_of(panel), [0.6, 0.2, 0.2])[-1:], L, H, H)
    return smp.loader_order(w, [0, 1], SEED, 256).select("epoch", "nth", "batch", "series_id", F.col("t").alias("query_t"), F.posexplode(F.concat("x", "y")).alias("step", "c")).withColumn("step", F.col("step").cast("long"))


# Least squares on two lags: all users together, and each for itself ---------------------

_LAGS = """r as (select q.split, q.series_id, q.t, y.t - q.t as step, cast(q.c as double) as x1, cast(z.c as double) as x2, cast(y.c as double) as y from q join p y on y.series_id = q.series_id and y.t > q.t and y.t <= q.t + 6 join p z on z.series_id = q.series_id and z.t = q.t - 1 where q.split in ('train', 'test1') and q.mx > q.mn)"""


def _two(by: str) -> str:
    return f"""m as (select {by}step, covar_pop(x1, x1) as v1, covar_pop(x1, x2) as v12, covar_pop(x2, x2) as v2, covar_pop(x1, y) as c1, covar_pop(x2, y) as c2, avg(x1) as m1, avg(x2) as m2, avg(y) as my from r where split = 'train' group by all),
fit as (select {by}step, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) as w1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) as w2, my - (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) * m1 - (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) * m2 as b from m where v1 > 0 and v2 > 0 and v1 * v2 - v12 * v12 > 0.001 * v1 * v2)"""


def two_lags(spark, sf_dir, split, panel=None):
    """Windows whose lookback is their last two values."""
    return linear_windows(spark, sf_dir, split, panel).withColumn("x", F.slice("x", L - 1, 2))


@query("mdl7_two_lags", f"{BASE}, {_LAGS}, {_two('')} select step, round(avg(power((y - w1 * x1 - w2 * x2 - b) / 100, 2)), 3) as mse, count(*) as rows from r join fit using (step) where split = 'test1' group by 1")
def central_two_lags(spark, sf_dir):
    w = lin.fit_linear(two_lags(spark, sf_dir, "train"))
    return scored(lin.predict_linear(two_lags(spark, sf_dir, "test1"), w)).groupBy(F.col("step").cast("long").alias("step")).agg(F.round(F.avg("mse"), 3).alias("mse"), F.count("*").alias("rows"))


@query("mdl15_two_lags_per_user", f"{BASE}, {_LAGS}, {_two('series_id, ')} select r.series_id, round(avg(power((y - w1 * x1 - w2 * x2 - b) / 100, 2)), 3) as mse, count(*) as rows from r join fit using (series_id, step) where split = 'test1' group by 1")
def users_two_lags(spark, sf_dir):
    """Each user's own least squares, for users whose two lags aren't collinear."""
    panel = blocks.kept(src.events_hourly(spark, sf_dir))
    train = two_lags(spark, sf_dir, "train", panel)
    a, b = F.element_at("x", 2).cast("double"), F.element_at("x", 1).cast("double")
    lags = train.groupBy("series_id").agg(F.covar_pop(a, a).alias("v1"), F.covar_pop(a, b).alias("v12"), F.covar_pop(b, b).alias("v2"))
    well = lags.filter("v1 > 0 and v2 > 0 and v1 * v2 - v12 * v12 > 0.001 * v1 * v2").select("series_id")
    done = lin.predict_users(two_lags(spark, sf_dir, "test1", panel).join(well, "series_id", "left_semi"), lin.fit_users(train))
    return scored(done).groupBy("series_id").agg(F.round(F.avg("mse"), 3).alias("mse"), F.count("*").alias("rows"))


@query("fam7_all_lags")
def scopes_all_lags(spark, sf_dir):
    """One head for all users against one a user, on all lags."""
    panel = blocks.kept(src.events_hourly(spark, sf_dir))
    train, test = linear_windows(spark, sf_dir, "train", panel), linear_windows(spark, sf_dir, "test1", panel)
    central = ev.summaries(scored(lin.predict_linear(test, lin.fit_linear(train))), "mse").withColumn("scope", F.lit("central"))
    own = scored(lin.predict_users(test, lin.fit_users(train, ridge=1e6)).filter("pred is not null"))
    return central.unionByName(ev.summaries(own, "mse").withColumn("scope", F.lit("per_user")))


@query("mdl5_long_windows")
def long_windows(spark, sf_dir):
    """A head of 504 lags and 168 steps, over every twelfth query of the panel: nothing planned or shuffled grows with lags times steps."""
    panel = src.events_hourly(spark, sf_dir)
    w = blocks.windows(panel, [("train", 0, win.dates_of(panel))], 504, 168, 12).filter("mx > mn")
    return ev.summaries(scored(lin.predict_linear(w, lin.fit_linear(w, ridge=1e6))), "mse")


_ZD = f"(sqrt(greatest(cast(n as double) * cast(s2 as double) - cast(s1 as double) * cast(s1 as double), 0.0)) / cast(n as double) / 100 + 1e-8)"


@query("mdl14_composed_model", rows_sql("cast(q.c as double)").replace("and mx > mn)", ")") + f""", z as (select series_id, t, step, mx, mn, c, s1::double / n / 100 as m, {_ZD} as d, ((c / 100.0::double - s1::double / n / 100) / {_ZD}) * 1.5 + 0.25 as z from (select l.*, q.mx, q.mn from l join q on q.series_id = l.series_id and q.t = l.t and q.split = 'test1'))
select series_id, t, step, round(case when mx = mn then c / 100.0::double else (0.5 * z + 0.1 * ((t + step) % 24) / 24.0::double - 0.25) / (1.5 + 1e-8) * d + m end, 4) as pred from z""")
def composed_model(spark, sf_dir):
    """Affine instance normalization, a covariate known for the future (the hour), a base model on both (half the last value and a share of the hour), the inverse, and the last value again for constant windows."""
    forward, inverse = nrm.NORMALIZATIONS["revin"]
    rows = evaluated(spark, sf_dir, keep_constant=True, extra=("mx", "mn"))
    hour = ((F.col("t") + F.col("step")) % 24).cast("double") / 24
    base = 0.5 * forward(F.col("c").cast("double") / 100) + 0.1 * hour
    pred = F.when(F.col("mx") == F.col("mn"), F.col("c") / 100).otherwise(inverse(base))
    return rows.select("series_id", "t", F.col("step").cast("long").alias("step"), F.round(pred, 4).alias("pred"))


# Trained losses and gates ------------------------------------------------------------


@query("fam5_trained_losses")
def trained_losses(spark, sf_dir):
    """A head trained on each of the five losses, scored by all of them: quadratic ones from Gram matrices, absolute ones by passes over the windows until their losses fall no more."""
    panel = blocks.kept(src.events_hourly(spark, sf_dir))
    train, test = linear_windows(spark, sf_dir, "train", panel), linear_windows(spark, sf_dir, "test1", panel)
    heads = training.fit_heads(train, ev.LOSSES, "instance", floor=1e-4)
    every = training.predict(test, np.hstack([heads[loss][0] for loss in ev.LOSSES]), "instance")  # one product: a head's steps after another's
    rows = scored(every.withColumn("y", F.flatten(F.array_repeat("y", len(ev.LOSSES)))))
    trained_on = F.element_at(F.array(*map(F.lit, ev.LOSSES)), F.ceil(F.col("step") / H).cast("int"))
    means = rows.groupBy(trained_on.alias("trained_on")).agg(*(F.avg(m).alias(m) for m in ev.LOSSES))
    names = spark.createDataFrame([(loss,) for loss in ev.LOSSES], "trained_on string")
    return names.join(F.broadcast(means), "trained_on", "left").select(*ev.LOSSES, "trained_on")


@query("nrm11_trained_gates")
def trained_gates(spark, sf_dir):
    """Presets of the gated normalization after training: parameters, losses before and after, and the test loss. `previn` has parameters of each cluster's own (two clusters by the
    user's id) under one head; users without a cluster have the shared ones."""
    own = F.when(F.col("series_id") % 3 > 0, F.col("series_id") % 3)
    panel = blocks.kept(src.events_hourly(spark, sf_dir))
    train, test = (gates.kept_rows(linear_windows(spark, sf_dir, s, panel).withColumn("cluster_id", own), "cluster_id") for s in ("train", "test1"))
    out = []
    for name in ("in", "revin", "cmin", "grevin"):
        w, params, history = gates.fit_gated(train, name, rounds=3)
        errors = gates.mean_errors(test, w, name, params).values()
        n = sum(n for _, n in errors)
        out.append((name, None, *(float(params[k]) for k in gates.NAMES), history[0], history[-1], sum(e * n for e, n in errors) / n if n else None))
    w, shared, params, history = gates.fit_gated_clusters(train, "previn", rounds=3)
    known = {None: shared, **params}
    for key, (error, _) in gates.mean_errors(test, w, "previn", shared, params).items():
        cluster = None if key == gates.SHARED else key
        if cluster in known:
            out.append(("previn", cluster, *(float(known[cluster][k]) for k in gates.NAMES), history[0], history[-1], error))
    return spark.createDataFrame(out, "preset string, cluster_id long, " + ", ".join(f"{k} double" for k in (*gates.NAMES, "first_loss", "last_loss", "test_mse")))


# Results that a run wrote --------------------------------------------------------------


@query("src15_written_results", rows_sql(*PREDICTIONS["persistence"]) + """, u as (unpivot (select series_id, t, step, mse, mae, nmae from l) on mse, mae, nmae into name metric value v), um as (select metric, series_id, avg(v) as m from u group by 1, 2), rk as (select *, row_number() over (partition by metric order by m desc, series_id) as rk, count(*) over (partition by metric) as n from um)
select 'events' as dataset, '24_6' as setting, 'test1' as split, metric, round(avg(v), 6) as value from u group by metric union all select 'events', '24_6', 'test1', 'user_' || metric, round(avg(m), 6) from rk group by metric union all select 'events', '24_6', 'test1', 'w10_' || metric, round(avg(case when rk <= greatest(1, ceil(0.1 * n)) then m end), 6) from rk group by metric""")
def written_results(spark, sf_dir):
    """An experiment under a new registry: its manifest is found, its loss table read, its results summarized."""
    root = shared_path(spark)
    config = {"dataset": "events", "lookback": L, "horizon": H, "stride": H, "remove_constant": True, "model": "persistence", "evaluation": {"splits": ["test1"]}}
    ex.run_experiment(spark, config, src.events_hourly(spark, sf_dir), root)
    found = ex.manifests(spark, root).filter("status = 'completed'").withColumn("label", F.lit("persistence"))
    return ex.results(spark, root, found).filter("metric rlike '(^|_)(mse|mae|nmae)$' and metric not rlike 'relative|nmse'").select("dataset", "setting", "split", "metric", F.round("value", 6).alias("value"))
