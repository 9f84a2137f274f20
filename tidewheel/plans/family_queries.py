"""Experiment families with fitted heads, their losses, and the reduced matrix of all families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import linear as lin
from ..operators import normalize as nrm
from ..operators import sampling as smp
from ..operators import training
from ..operators import blocks
from ..operators import windows as win
from ..sources import panels as src
from .model_queries import _FORWARD, _G, _INVERSE, PREDICTIONS, evaluated, rows_sql, summary_sql
from .panel_queries import synthetic_population
from .registry import BASE, H, L, STD, query
from .report_queries import linear_windows, scored

# Normalizations and losses of the families.
FAMILY_NORMALIZATIONS = ("identity", "standard", "min_max", "in_min_max", "instance", "revin")
SMOKE_FLOOR = 1e-4


# Losses ---------------------------------------------------------------------------

_SD, _MEAN = f"greatest({STD} / 100, 0.0001)", "greatest(abs(cast(s1 as double) / n / 100), 0.0001)"


@query("los5_floored_losses", rows_sql(*PREDICTIONS["persistence"]) + f" select step, round(avg(power((y - pred) / 100 / {_SD}, 2)), 4) as nmse, round(avg(abs(y - pred) / 100 / {_SD}), 6) as nmae, round(avg(power((y - pred) / 100 / {_MEAN}, 2)), 4) as relative_mse from l group by 1")
def floored(spark, sf_dir):
    rows = ev.floored_losses(evaluated(spark, sf_dir), SMOKE_FLOOR)
    return rows.groupBy(F.col("step").cast("long").alias("step")).agg(F.round(F.avg("nmse"), 4).alias("nmse"), F.round(F.avg("nmae"), 6).alias("nmae"), F.round(F.avg("relative_mse"), 4).alias("relative_mse"))


# One head for each step ---------------------------------------------------------------

_PHASE = "x as (select q.split, q.series_id, q.t, y.t - q.t as step, cast(z.c as double) as x, cast(y.c as double) as y from q join p y on y.series_id = q.series_id and y.t > q.t and y.t <= q.t + 6 join p z on z.series_id = y.series_id and z.t = y.t - 24 where q.split in ('train', 'test1') and mx > mn), fit as (select step, regr_slope(y, x) as a, regr_intercept(y, x) as b from x where split = 'train' group by 1)"


@query("mdl6_periodic_linear", f"{BASE}, {_PHASE} select x.step, round(any_value(a), 5) as slope, round(any_value(b), 2) as intercept, round(avg(power((y - a * x - b) / 100, 2)), 3) as mse from x join fit using (step) where split = 'test1' group by 1")
def periodic_linear(spark, sf_dir):
    """A head for each step on the lags of its phase: at a period of the lookback that is the one value a period before the target."""
    rows = {s: linear_windows(spark, sf_dir, s).select("x", F.posexplode("y").alias("step", "y")).select((F.col("step") + 1).cast("long").alias("step"), F.element_at("x", F.col("step") + 1).cast("double").alias("x"), F.col("y").cast("double").alias("y")) for s in ("train", "test1")}
    fit = rows["train"].groupBy("step").agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"))
    error = (F.col("y") - F.col("a") * F.col("x") - F.col("b")) / 100
    out = rows["test1"].join(F.broadcast(fit), "step").groupBy("step").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.avg(error * error).alias("mse"))  # one row a step
    return out.select("step", F.round("a", 5).alias("slope"), F.round("b", 2).alias("intercept"), F.round("mse", 3).alias("mse"))


_TWO = """r as (select q.split, y.t - q.t as step, cast(a.c as double) as x1, cast(b.c as double) as x2, cast(y.c as double) as y from q join p y on y.series_id = q.series_id and y.t > q.t and y.t <= q.t + 6 join p a on a.series_id = y.series_id and a.t = y.t - 24 join p b on b.series_id = y.series_id and b.t = y.t - 12 where q.split in ('train', 'test1') and q.mx > q.mn),
m as (select step, covar_pop(x1, x1) as v1, covar_pop(x1, x2) as v12, covar_pop(x2, x2) as v2, covar_pop(x1, y) as c1, covar_pop(x2, y) as c2, avg(x1) as m1, avg(x2) as m2, avg(y) as my from r where split = 'train' group by 1),
heads as (select step, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) as w1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) as w2, m1, m2, my from m), fit as (select *, my - w1 * m1 - w2 * m2 as b from heads)"""


@query("mdl6_phase_heads", f"{BASE}, {_TWO} select r.step, round(any_value(w1), 5) as far, round(any_value(w2), 5) as near, round(any_value(b), 2) as intercept, round(avg(power((y - w1 * x1 - w2 * x2 - b) / 100, 2)), 3) as mse from r join fit using (step) where split = 'test1' group by 1")
def phase_heads(spark, sf_dir):
    """Heads at a period below the lookback: each step sees two lags of its phase."""
    lags = lin.phase_lags(L, H, 12)
    w = lin.fit_periodic(linear_windows(spark, sf_dir, "train"), lags)
    heads = spark.createDataFrame([(h + 1, float(w[far, h]), float(w[near, h]), float(w[-1, h])) for h, (far, near) in enumerate(lags)], "step long, far double, near double, intercept double")
    mse = scored(lin.predict_linear(linear_windows(spark, sf_dir, "test1"), w)).groupBy(F.col("step").cast("long").alias("step")).agg(F.round(F.avg("mse"), 3).alias("mse"))
    return mse.join(F.broadcast(heads), "step").select("step", F.round("far", 5).alias("far"), F.round("near", 5).alias("near"), F.round("intercept", 2).alias("intercept"), "mse")  # one row a step


_POLICIES = [("keep", False, False, False), ("remove_train_windows", True, False, False), ("remove_eval_windows", False, True, False), ("remove_all_windows", True, True, False), ("drop_all_users", False, False, True)]
_POLICY_SQL = ", ".join(f"('{n}', {a}, {b}, {c})" for n, a, b, c in _POLICIES)


@query("fam1_fitted_policies", f"""{BASE}, bad as (select distinct series_id from q where mx = mn), pol as (select * from (values {_POLICY_SQL}) v(policy, cut_train, cut_eval, drop_users)),
x as (select q.split, q.series_id, y.t - q.t as step, cast(q.c as double) as x, cast(y.c as double) as y, q.mx > q.mn as varies, q.series_id in (select series_id from bad) as bad from q join p y on y.series_id = q.series_id and y.t > q.t and y.t <= q.t + 6 where q.split in ('train', 'test1')),
fit as (select policy, step, regr_slope(y, x) as a, regr_intercept(y, x) as b from x cross join pol where split = 'train' and (varies or not cut_train) and not (bad and drop_users) group by 1, 2)
select policy, count(*) as rows, round(avg(power((y - a * x - b) / 100, 2)), 3) as mse from x cross join pol join fit using (policy, step) where split = 'test1' and (varies or not cut_eval) and not (bad and drop_users) group by 1""")
def fitted_policies(spark, sf_dir):
    """What happens to constant windows in training, in evaluation, in both, or to the users that have any: a head for each step, fitted under the policy."""
    panel = src.events_hourly(spark, sf_dir)
    q = blocks.windows(panel, win.split_ranges(win.dates_of(panel), [0.6, 0.2, 0.2]), L, H, H, past=False)
    bad = q.filter("mx = mn").select("series_id").distinct().withColumn("bad", F.lit(True))
    varies, fine, train = F.col("mx") > F.col("mn"), F.col("bad").isNull(), F.col("split") == "train"
    held = [F.when((varies | ~(train & F.lit(a)) & ~(~train & F.lit(b))) & (fine | ~F.lit(c)), n) for n, a, b, c in _POLICIES]
    rows = q.filter("split <> 'valid1'").join(bad, "series_id", "left").select("split", F.col("c").cast("double").alias("x"), "y", F.explode(F.filter(F.array(*held), lambda v: v.isNotNull())).alias("policy"))
    rows = rows.select("split", "policy", "x", F.posexplode("y").alias("step", "y")).withColumn("y", F.col("y").cast("double"))
    fit = rows.filter("split = 'train'").groupBy("policy", "step").agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"))
    error = (F.col("y") - F.col("a") * F.col("x") - F.col("b")) / 100
    return rows.filter("split = 'test1'").join(F.broadcast(fit), ["policy", "step"]).groupBy("policy").agg(F.count("*").alias("rows"), F.round(F.avg(error * error), 3).alias("mse"))  # a row a policy and step


def _target(expr: str) -> str:
    """The SQL of a normalization of the value, for the target."""
    return expr.replace("(c / 100.0::double)", "(y / 100.0::double)")


def _family_sql(name: str) -> str:
    return f"""select '{name}' as normalization, series_id, split, step, {_FORWARD[name]} as zx, {_target(_FORWARD[name])} as zy, y, c, n, s1, s2, mn, mx, gm, gd, lo, hi from x0 cross join gs"""


_BACK = "case normalization " + " ".join(f"when '{n}' then {_INVERSE[n]}" for n in FAMILY_NORMALIZATIONS) + " end"


@query("fam3_normalizations", f"""{BASE}, {_G}, x0 as (select q.*, y.t - q.t as step, y.c as y from q join p y on y.series_id = q.series_id and y.t > q.t and y.t <= q.t + 6 where q.split in ('train', 'test1') and q.mx > q.mn),
x as ({' union all '.join(_family_sql(n) for n in FAMILY_NORMALIZATIONS)}),
fit as (select normalization, step, coalesce(regr_slope(zy, zx), 0.0) as a, coalesce(regr_intercept(zy, zx), avg(zy)) as b from x where split = 'train' group by 1, 2),
z as (select x.*, a * zx + b as z from x join fit using (normalization, step) where split = 'test1'), l as (select normalization, y, {_BACK} as back from z)
select normalization, round(avg(power(y / 100.0 - back, 2)), 3) as mse, count(*) as rows from l group by 1""")
def normalizations_family(spark, sf_dir):
    """A head for each step, fitted in each normalization's units and brought back: one pass over the windows for all six."""
    both = None
    for s in ("train", "test1"):
        w = linear_windows(spark, sf_dir, s)
        both = w if both is None else both.unionByName(w)
    panel = src.events_hourly(spark, sf_dir)
    q = win.split_queries(win.with_moments(panel, L), win.split_ranges(win.dates_of(panel), [0.6, 0.2, 0.2])[:1], L, H, H)
    n, s1, s2 = F.sum("n").cast("double"), F.sum("s1").cast("double"), F.sum("s2").cast("double")
    whole = q.agg(F.round(s1 / n / 100, 6).alias("gm"), F.round(F.sqrt(F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0))) / 100, 6).alias("gd"), (F.min("mn") / 100).alias("lo"), (F.max("mx") / 100).alias("hi"))
    rows = both.select("split", "c", "n", "s1", "s2", "mn", "mx", F.posexplode("y").alias("step", "y")).join(F.broadcast(whole))  # one row
    x, y = F.col("c").cast("double") / 100, F.col("y").cast("double") / 100
    arms = F.explode(F.array(*(F.struct(F.lit(name).alias("normalization"), nrm.NORMALIZATIONS[name][0](x).alias("zx"), nrm.NORMALIZATIONS[name][0](y).alias("zy")) for name in FAMILY_NORMALIZATIONS)))
    rows = rows.withColumn("arm", arms).select("*", "arm.*").drop("arm")
    fit = rows.filter("split = 'train'").groupBy("normalization", "step").agg(F.coalesce(F.regr_slope("zy", "zx"), F.lit(0.0)).alias("a"), F.coalesce(F.regr_intercept("zy", "zx"), F.avg("zy")).alias("b"))
    z, back = F.col("a") * F.col("zx") + F.col("b"), F.lit(None).cast("double")
    for name in FAMILY_NORMALIZATIONS:
        back = F.when(F.col("normalization") == name, nrm.NORMALIZATIONS[name][1](z)).otherwise(back)
    tested = rows.filter("split = 'test1'").join(F.broadcast(fit), ["normalization", "step"])  # a row a normalization and step
    return tested.groupBy("normalization").agg(F.round(F.avg(F.pow(y - back, F.lit(2.0))), 3).alias("mse"), F.count("*").alias("rows"))


@query("fam4_reference", rows_sql("cast(z.c as double) as first_lags, cast(q.c as double)", "join p z on z.series_id = q.series_id and z.t = y.t - 24") + ", a as (select 'persistence' as method, series_id, mse from l union all select 'first_lags', series_id, power((y - first_lags) / 100, 2) from l), " + summary_sql("mse", "method").replace("from l group", "from a group"))
def reference_family(spark, sf_dir):
    """Element, user and worst-tenth losses of the fixed rules of the reference family, in one pass."""
    rows = evaluated(spark, sf_dir, "lookback")
    squared = lambda pred: F.pow((F.col("y") - F.col(pred)) / 100, F.lit(2.0))
    arms = F.explode(F.array(F.struct(F.lit("persistence").alias("method"), squared("c").alias("mse")), F.struct(F.lit("first_lags").alias("method"), squared("pred").alias("mse"))))
    return ev.summaries(rows.select("series_id", arms.alias("arm")).select("series_id", "arm.*"), "mse", ["method"])


# The reduced matrix -------------------------------------------------------------------


def population_windows(panel: DataFrame) -> dict[str, DataFrame]:
    """Windows at every date of the small population's blocks, each within its block: 216, 72 and 72 of 360 dates."""
    base = ev.base_windows(panel.withColumn("variate", F.lit(0)), L, H).withColumns({"gm": F.lit(0.0), "gd": F.lit(1.0), "lo": F.lit(0.0), "hi": F.lit(1.0)})
    return {name: base.filter(F.col("t").between(lo + L - 1, hi - 1 - H)).withColumn("split", F.lit(name)) for name, lo, hi in (("train", 0, 216), ("valid1", 216, 288), ("test1", 288, 360))}


def reduced_arms(w: dict[str, DataFrame], seeds: tuple[int, ...] = (1, 2)) -> list[tuple]:
    """(family, method, seed, normalization, cut, drop, weights) of every arm; weights are rows for the steps, lags and intercept within. Rules are weights of 1 on one lag."""
    bad = w["train"].filter("mx = mn").select("series_id").distinct()
    drop = w["train"].join(F.broadcast(bad), "series_id", "left_anti")  # 16 users
    cut, arms, known = w["train"].filter("mx > mn"), [], {}
    one = lambda lag: [[1.0 if i == lag(h) else 0.0 for i in range(L + 1)] for h in range(H)]
    last, first = one(lambda h: L - 1), one(lambda h: h)
    for seed in seeds:

        def trained(family, method, train=w["train"], norm="instance", loss="mse", batches=64, no_constant=False, no_users=False, seed=seed):
            fit = (id(train), batches, seed, norm, loss)  # arms that differ in evaluation only share a fit
            if fit not in known:
                grams = training.batch_grams(train, batches, seed, norm, loss, floor=SMOKE_FLOOR)
                known[fit] = training.fit(grams, 6, training.optimizer("adam", 0.01), clip=5.0, seed=seed)[0].T.tolist()
            arms.append((family, method, seed, norm, no_constant, no_users, known[fit]))

        for method, train, a, b in (("keep", w["train"], False, False), ("remove_train_windows", cut, False, False), ("remove_eval_windows", w["train"], True, False), ("remove_all_windows", cut, True, False), ("drop_all_users", drop, False, True)):
            trained("constants", method, train, no_constant=a, no_users=b)
        key = smp.draw_key(seed, "series_id", "t")
        for mode, rows in (("all", w["train"]), ("dates", smp.first_by(w["train"], ["t"], key, ["series_id"], 4)), ("individuals", smp.first_by(w["train"], ["series_id"], key, ["t"], 1))):
            for batches in (16, 64):
                trained("sampling", f"{mode}_in_{batches}", rows, batches=batches)
        for loss in training.LOSSES:
            trained("losses", loss, loss=loss)
        for norm in FAMILY_NORMALIZATIONS:
            trained("normalizations", norm, norm=norm, loss="nmse")
        arms += [(f, m, seed, "identity", False, False, rule) for f, m, rule in (("reference", "persistence", last), ("reference", "first_lags", first), ("linear_models", "persistence", last), ("linear_models", "periodic", first))]
        trained("linear_models", "linear_adam")
        trained("central_per_user", "central")
    return arms


def _through(name: str):
    return F.transform("x", lambda v: nrm.NORMALIZATIONS[name][0](v.cast("double") / 100))


@query("fam9_reduced_matrix")
def reduced_matrix(spark, sf_dir):
    """Seven families of small experiments on the generated population, each arm for seeds 1 and 2, scored in one pass over the test windows. Batches are hash shares; losses are the quadratic ones."""
    base = population_windows(synthetic_population(spark).coalesce(2))
    n, s1, s2 = F.sum("n").cast("double"), F.sum("s1").cast("double"), F.sum("s2").cast("double")
    m = base["train"].agg((s1 / n / 100).alias("gm"), (F.sqrt(s2 / n - (s1 / n) * (s1 / n)) / 100).alias("gd"), (F.min("mn") / 100).alias("lo"), (F.max("mx") / 100).alias("hi")).first().asDict()
    w = {k: d.withColumns({name: F.lit(float(v)) for name, v in m.items()}).persist() for k, d in base.items() if k != "valid1"}
    schema = "arms array<struct<family:string,method:string,seed:int,norm:string,cut:boolean,drop:boolean,weights:array<array<double>>>>"
    arms = spark.createDataFrame([(reduced_arms(w),)], schema)
    bad = w["test1"].filter("mx = mn").select("series_id").distinct().withColumn("bad", F.lit(True))
    rows = w["test1"].join(F.broadcast(bad), "series_id", "left").join(F.broadcast(arms)).withColumn("arm", F.explode("arms")).select("*", "arm.*").drop("arms", "arm")  # one row of arms
    rows = rows.filter((~F.col("cut") | (F.col("mx") > F.col("mn"))) & (~F.col("drop") | F.col("bad").isNull()))
    forward = F.lit(None).cast("array<double>")
    for name in FAMILY_NORMALIZATIONS:
        forward = F.when(F.col("norm") == name, _through(name)).otherwise(forward)

    def back(z):
        out = F.lit(None).cast("double")
        for name in FAMILY_NORMALIZATIONS:
            out = F.when(F.col("norm") == name, nrm.NORMALIZATIONS[name][1](z)).otherwise(out)
        return out * 100

    rows = rows.withColumn("zx", F.concat(forward, F.array(F.lit(1.0))))
    rows = rows.withColumn("z", F.transform("weights", lambda u: F.aggregate(F.zip_with(u, F.col("zx"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))
    rows = rows.select("family", "method", "seed", "norm", "series_id", "t", "c", "n", "s1", "s2", "mn", "mx", "gm", "gd", "lo", "hi", F.posexplode(F.arrays_zip("y", "z")).alias("step", "cell"))
    rows = rows.select("*", F.col("cell.y").alias("y"), back(F.col("cell.z")).alias("pred"))
    out = ev.summaries(ev.losses(rows.drop("cell", "norm")), "mse", ["family", "method", "seed"])
    return out.select("family", "method", "seed", F.round("mse", 4).alias("mse"), F.round("user_mse", 4).alias("user_mse"), F.round("w10_mse", 4).alias("w10_mse"), "users")
