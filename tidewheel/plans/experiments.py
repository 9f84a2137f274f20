"""Experiments: stages of training and evaluation, loss tables under their runs, results of selected runs."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import blocks, linear, models, training
from ..operators import windows as win
from ..operators.tails import tail_means
from ..sources import files
from ..sources.shared import stash
from .runs import Registry

#: Columns of a manifest as Spark reads them.
MANIFEST = "schema int, identity string, run_index int, signature string, config map<string,string>, purposes array<string>, status string, seed_status map<string,string>, finished_at string"
LINEAR = {"linear", "decomposed", "least_squares", "ridge", "per_user"}


def check_alignment(rows: DataFrame, horizon: int) -> DataFrame:
    """`rows` of losses (series_id, t, step, ...) as they are, once one aggregate finds every query with an id and each of its steps exactly once."""
    keys = rows.groupBy("series_id", "t").agg(F.count("*").alias("n"), F.count_distinct("step").alias("steps"), F.max("step").alias("last"))
    bad = keys.filter(F.col("series_id").isNull() | F.col("t").isNull() | (F.col("n") != horizon) | (F.col("steps") != horizon) | (F.col("last") != horizon))
    if (first := bad.head()) is not None:
        raise ValueError(f"losses are not aligned: series {first.series_id}, query {first.t} has {first.n} rows of {horizon} steps")
    return rows


def write_losses(rows: DataFrame, path: str, horizon: int) -> None:
    """The loss table of a run and seed. `split` is a column, sorted in each file, so tables of many runs are read as one and a split's row groups are found by their bounds.

    Written aside once, checked as written, and moved into place: losses are computed once, and no reader sees a table that isn't aligned.
    """
    spark = rows.sparkSession
    columns = ["split", "series_id", "t", "step", *(m for m in ev.LOSSES if m in rows.columns)]
    aside = f"{path}.unchecked"
    rows.select(*columns).sortWithinPartitions("split").write.mode("overwrite").parquet(aside)
    try:
        check_alignment(spark.read.parquet(aside), horizon)
    except ValueError:
        files.remove(spark, aside)
        raise
    files.replace(spark, aside, path)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """All manifests below a folder but archived ones, with the folder of each run."""
    found = spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(root)
    rows = found.withColumn("run_dir", F.regexp_replace(F.col("_metadata.file_path"), "/manifest\\.json$", ""))
    return rows.filter(~F.col("run_dir").contains("/archive/"))


def results(spark: SparkSession, root: str, selected: DataFrame) -> DataFrame:
    """(dataset, setting, label, split, seed, metric, value): means of the loss tables of selected runs (rows of `manifests` with a label), and their summaries.

    Only ready and completed seeds count; one without a loss table fails. A run's tables are read together and told apart by their paths.
    """
    seeds = selected.select("run_dir", "label", "config", F.explode("seed_status").alias("seed", "state")).filter("state in ('ready', 'completed')")
    paths = seeds.select(F.concat_ws("/", "run_dir", F.concat(F.lit("seed_"), "seed"), F.lit("all_losses")).alias("path"), F.col("seed").cast("int").alias("seed"), "label", F.col("config")["dataset"].alias("dataset"), F.concat_ws("_", F.col("config")["lookback"], F.col("config")["horizon"]).alias("setting"))
    known = paths.collect()  # one row a seed of a selected run
    if not known:
        return spark.createDataFrame([], "dataset string, setting string, label string, split string, seed int, metric string, value double")
    for p in {k.path for k in known}:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            raise FileNotFoundError(f"a completed run has no loss table: {p}")
    losses = spark.read.option("mergeSchema", True).parquet(*sorted({k.path for k in known})).withColumn("source", F.regexp_extract("_metadata.file_path", "^(.*/all_losses)/", 1))
    names = [m for m in ev.LOSSES if m in losses.columns]
    by = ["source", "split"]
    users = stash(losses.groupBy(*by, "series_id").agg(*(F.avg(m).alias(m) for m in names), *(F.sum(m).alias(f"sum_{m}") for m in names), *(F.count(m).alias(f"n_{m}") for m in names)))
    out = users.groupBy(*by).agg(*((F.sum(f"sum_{m}") / F.sum(f"n_{m}")).alias(m) for m in names), *(F.avg(m).alias(f"user_{m}") for m in names))
    each = users.unpivot([*by, "series_id"], names, "metric", "v")
    worst = tail_means(each, [*by, "metric"], "v").select(*by, F.concat(F.lit("w10_"), "metric").alias("metric"), F.col("tail_mean").alias("value"))
    long = out.unpivot(by, [c for c in out.columns if c not in by], "metric", "value").unionByName(worst)
    labels = paths.withColumnRenamed("path", "source")
    return long.join(labels, "source").select("dataset", "setting", "label", "split", "seed", "metric", "value")


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, setting, model, split, metric, value, path) of every loss table `<dataset>/<setting>/<model>/all_losses` below a folder, whether or not a run registered it.

    Loose: names come from the path alone. A file that gives no row (broken, or empty) is one row of split `<load_error>` without a value. An empty folder gives no rows.
    """
    where = "([^/]+)/([^/]+)/([^/]+)/all_losses(?:\\.parquet)?(?:/[^/]*)?$"
    named = lambda path: [F.regexp_extract(path, where, i + 1).alias(n) for i, n in enumerate(("dataset", "setting", "model"))]
    file = F.regexp_replace("_metadata.file_path", "^[a-z]+:/*", "/")
    options = {"recursiveFileLookup": True, "pathGlobFilter": "*.parquet"}
    listed = spark.read.format("binaryFile").options(**options).load(root).select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("path")).filter(F.col("path").rlike(where))
    schema = "split string, series_id long, " + ", ".join(f"{m} double" for m in ev.LOSSES)
    rows = spark.read.schema(schema).options(ignoreCorruptFiles=True, **options).parquet(root).withColumn("path", file).filter(F.col("path").rlike(where))
    sums = rows.groupBy("path", "split").agg(*(F.avg(m).alias(m) for m in ev.LOSSES), *(F.count(m).alias(f"n_{m}") for m in ev.LOSSES))
    broken = listed.join(sums.select("path").distinct(), "path", "left_anti").select(*named("path"), F.lit("<load_error>").alias("split"), F.lit("unreadable").alias("metric"), F.lit(None).cast("double").alias("value"), "path")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    of_table = F.when(F.col("path").rlike("/all_losses/[^/]*$"), folder).otherwise(F.col("path"))
    long = sums.select(of_table.alias("path"), "split", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(m) * F.col(f"n_{m}")).alias("s"), F.col(f"n_{m}").alias("n")) for m in ev.LOSSES))).alias("z"))
    means = long.groupBy("path", "split", "z.metric").agg((F.sum("z.s") / F.sum("z.n")).alias("value"), F.sum("z.n").alias("n")).filter("n > 0")
    return means.select(*named("path"), "split", "metric", "value", "path").unionByName(broken)


def statistics(train: DataFrame) -> tuple[float, float, float, float]:
    """Mean, deviation, least and largest of the training lookbacks: what global normalizations take."""
    n, s1, s2 = F.sum("n").cast("double"), F.sum("s1").cast("double"), F.sum("s2").cast("double")
    r = train.agg((s1 / n / 100).alias("m"), (F.sqrt(F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0))) / 100).alias("d"), (F.min("mn") / 100).alias("lo"), (F.max("mx") / 100).alias("hi")).first()
    return tuple(0.0 if v is None else float(v) for v in r)


def loader_statistics(windows: DataFrame) -> dict[str, float | int | None]:
    """All measures of a split's loader in one pass: counts of windows (finite ones, constant ones), means over windows of their own moments, values pooled over lookbacks, future values, and gamma statistics.

    A value that k windows share counts k times. Without windows the counts are 0 and the measures are None.
    """
    n, s1, s2 = (F.col(c).cast("double") for c in ("n", "s1", "s2"))
    y = F.transform("y", lambda v: v.cast("double"))
    total = lambda f: F.aggregate(F.transform(y, f), F.lit(0.0), lambda a, v: a + v)
    h, y1, y2 = F.size("y").cast("double"), total(lambda v: v), total(lambda v: v * v)
    rows = windows.select(
        "series_id", "t", "n", "s1", "s2", "mn", "mx", (s1 / n / 100).alias("m"), (F.sqrt(F.greatest(n * s2 - s1 * s1, F.lit(0.0))) / n / 100).alias("d"), (y1 / h / 100).alias("fm"), (F.sqrt(F.greatest(h * y2 - y1 * y1, F.lit(0.0))) / h / 100).alias("fd"),
    )
    varies, pooled = F.col("mx") > F.col("mn"), F.sum("s1").cast("double") / F.sum("n") / 100
    square = F.sum(F.col("s2").cast("double")) / F.sum("n") / 10000
    eps = F.lit(win.EPS)
    got = rows.agg(
        F.count("*").alias("variate_windows"), F.count_distinct("series_id", "t").alias("item_windows"), F.count("m").alias("finite_variate_windows"), (F.count("*") - F.count("m")).alias("invalid_variate_windows"),
        F.coalesce(F.count_if(~varies), F.lit(0)).alias("constant_variate_windows"), F.avg("m").alias("lookback_mean"), F.avg("d").alias("lookback_std"), F.avg("fm").alias("future_mean"), F.avg("fd").alias("future_std"),
        pooled.alias("lookback_value_mean"), F.sqrt(F.greatest(square - pooled * pooled, F.lit(0.0))).alias("lookback_value_std"), (F.min("mn") / 100).alias("lookback_value_min"), (F.max("mx") / 100).alias("lookback_value_max"),
        F.avg("fm").alias("future_value_mean"), F.avg("fd").alias("future_value_std"), F.avg(F.col("fd") / (F.col("d") + eps)).alias("alpha"), F.avg((F.col("fm") - F.col("m")) / (F.col("d") + eps)).alias("beta"),
    ).first()
    out = got.asDict()
    return {"accessible_windows": out["item_windows"], "sampled_windows": out["item_windows"]} | out


def splits_of(panel: DataFrame, config: dict) -> dict[str, DataFrame]:
    """Windows of each split, with arrays, moments and the training split's statistics. A cluster's own options stand over the shared ones (`clusters`: {id: options}).

    Windows are made once and kept in the shared folder: statistics, batches, validation and evaluation all read them.
    """
    lookback, horizon = config["lookback"], config["horizon"]
    spans = win.split_ranges(win.dates_of(panel), config.get("ratios", [0.6, 0.2, 0.2]))
    own, parts = config.get("clusters") or {}, []
    for cluster, options in [(None, {}), *own.items()]:
        rows = panel if not own else panel.filter(~F.col("cluster_id").isin(*own) | F.col("cluster_id").isNull()) if cluster is None else panel.filter(F.col("cluster_id") == cluster)
        opts = config | options
        q = blocks.windows(rows, spans, lookback, horizon, opts.get("stride", 1))
        parts.append(q.filter("mx > mn") if opts.get("remove_constant") else q)
    q = parts[0]
    for p in parts[1:]:
        q = q.unionByName(p)
    q = stash(q)
    m, d, lo, hi = statistics(q.filter(F.col("split") == spans[0][0]))
    q = q.withColumns({"gm": F.lit(m), "gd": F.lit(d), "lo": F.lit(lo), "hi": F.lit(hi)})
    return {name: q.filter(F.col("split") == name) for name, *_ in spans}


def batches_for(windows: DataFrame, config: dict, batches: int) -> list:
    """Batches of a configuration's loss: Gram matrices for quadratic ones, windows on executors for absolute ones. `batch_size` asks for batches of so many windows, else `batches` hash shares are made."""
    opts, norm, seed = config.get("training", {}), config.get("normalization", "identity"), config.get("seed", 0)
    loss, size = opts.get("loss", "mse"), opts.get("batch_size") if batches != 1 else None
    rows = training.sized_batches(windows, size, seed) if size else windows
    if loss not in training.ABSOLUTE:
        return training.batch_grams(rows, None if size else batches, seed, norm, loss)
    if not size and batches != 1:
        rows = rows.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), "series_id", "t"), F.lit(batches)).cast("int"))
    return training.scattered_batches(rows, norm, loss)


def train_stage(spark: SparkSession, config: dict, splits: dict[str, DataFrame], folder: str) -> dict[str, Any]:
    """Fits the model of a configuration and saves its weights. Fixed rules have nothing to train, `epochs` of 0 or less leave the start: then the history is empty and says why."""
    name, opts = config.get("model", "linear"), config.get("training", {})
    empty: dict[str, Any] = {"train": [], "train_batch": [], "valid": {}, "elapsed_seconds": 0.0}
    if name not in LINEAR:
        return {"weights": None, "state_path": None, "history": empty | {"skipped": "no trainable parameters"}}
    state = f"{folder}/model_state"
    if name == "per_user":
        linear.fit_users(splits["train"], ridge=opts.get("ridge", 0.0)).write.mode("overwrite").parquet(state)
        return {"weights": spark.read.parquet(state), "state_path": state, "history": empty | {"skipped": "closed form"}}
    if name in ("linear", "decomposed"):
        step = training.optimizer(opts.get("optimizer", "adam"), opts.get("rate", 1e-5), **opts.get("optimizer_options", {}))
        valid = {s: batches_for(splits[s], config, 1) for s in splits if "valid" in s} if opts.get("epochs", 200) > 0 else {}
        if name == "decomposed" and opts.get("loss", "mse") in training.ABSOLUTE:
            raise ValueError("decomposed heads are trained on quadratic losses")
        fit = training.fit if name == "linear" else training.fit_two_heads
        weights, history = fit(batches_for(splits["train"], config, opts.get("batches", 16)), opts.get("epochs", 200), step, valid, valid_every=opts.get("valid_every"), log_every=opts.get("log_every"), clip=opts.get("clip"), seed=config.get("seed", 0))
    else:
        both = batches_for(splits["train"], config, 1)
        if not both:
            raise ValueError("no windows to fit on")
        penalty = opts.get("ridge", 1.0 if name == "ridge" else 0.0)
        weights, history = linear.solve(both[0].xx, both[0].xy, penalty), empty | {"skipped": "closed form"}
    training.save_state(spark, weights, state)
    return {"weights": weights, "state_path": state, "history": history}


def predictions(config: dict, windows: DataFrame, weights) -> DataFrame:
    name = config.get("model", "linear")
    if name == "per_user":  # users that training never saw have no forecast
        return linear.predict_users(windows, weights).filter("pred is not null")
    if name in LINEAR:
        return training.predict(windows, weights, config.get("normalization", "identity"))
    return models.model(name)(windows, windows, config["lookback"], config["horizon"])


def eval_stage(config: dict, splits: dict[str, DataFrame], weights, folder: str) -> str:
    """Losses of every step of the selected splits' windows (all but training by default) as one table; a split that isn't there is left out."""
    wanted = [s for s in config.get("evaluation", {}).get("splits", [s for s in splits if s != "train"]) if s in splits]
    rows = None
    for s in wanted:
        w = predictions(config, splits[s], weights).select("split", "series_id", "t", "n", "s1", "s2", F.posexplode(F.arrays_zip("y", "pred")).alias("step", "z"))
        part = ev.losses(w.select("split", "series_id", "t", "n", "s1", "s2", (F.col("step") + 1).alias("step"), F.col("z.y").alias("y"), F.col("z.pred").alias("pred")))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no split to evaluate")
    path = f"{folder}/all_losses"
    write_losses(rows, path, config["horizon"])
    return path


def run_experiment(spark: SparkSession, config: dict, panel: DataFrame, root: str, launch: str = "default") -> dict[str, Any]:
    """One configuration with each of its seeds, under the run registry: windows, training, evaluation, manifest.

    Training is skipped by `skip_training`, and by `pretrained` (a saved state) unless `bypass_training_with_pretrained` is false; `evaluate` false ends after training. What fails
    leaves the run interrupted; what is completed isn't run again.
    """
    registry, seeds = Registry(str(root), spark=spark), config.get("seeds", [config.get("seed", 0)])
    plain = {k: v for k, v in config.items() if k not in ("seeds", "seed")}
    identity = f"{config['dataset']}/{config['lookback']}_{config['horizon']}"
    run, action = registry.allocate(identity, plain, seeds, launch, config.get("policy", "overwrite_exact"))
    folder, out = registry.folder(identity, run["run_index"]), {"identity": identity, "run_index": run["run_index"], "action": action, "seeds": {}}
    for seed in registry.pending(identity, run["run_index"]):
        registry.start(identity, run["run_index"], seed)
        try:
            out["seeds"][seed] = _seed(spark, config | {"seed": seed}, panel, f"{folder}/seed_{seed}")
        except Exception:
            registry.interrupt(identity, run["run_index"])
            raise
        registry.complete(identity, run["run_index"], seed)
    return out


def _seed(spark: SparkSession, config: dict, panel: DataFrame, folder: str) -> dict[str, Any]:
    splits, pretrained = splits_of(panel, config), config.get("pretrained")
    skip = config.get("skip_training", False) or (pretrained and config.get("bypass_training_with_pretrained", True))
    out: dict[str, Any] = {}
    weights = None
    if not skip:
        trained = train_stage(spark, config, splits, folder)
        weights = trained.pop("weights")
        out |= trained
        files.write_json(spark, f"{folder}/train_history.json", trained["history"])
    elif config.get("model", "linear") in LINEAR:
        out["state_path"] = pretrained or f"{folder}/model_state"
        weights = spark.read.parquet(out["state_path"]) if config.get("model") == "per_user" else training.load_state(spark, out["state_path"])
    counts = {s: w.count() for s, w in splits.items()} if config.get("loader_artifacts") else {}
    if counts:
        files.write_json(spark, f"{folder}/metadata.json", {"windows": counts, "lookback": config["lookback"], "horizon": config["horizon"]})
        files.write_json(spark, f"{folder}/stats.json", {s: loader_statistics(w) for s, w in splits.items()})
    if config.get("evaluate", True):
        out["losses_path"] = eval_stage(config, splits, weights, folder)
    return out


def write_report(path: str, selected: list[dict], config_policy: str, repeat_policy: str, filters: dict) -> None:
    """What a report was asked for and which runs it took: each with its folder, label, signature, configuration and purposes."""
    keys = ("identity", "run_index", "run_dir", "label", "signature", "config", "purposes")
    files.write_json(SparkSession.active(), str(path), {"schema": 1, "requested": {"config_policy": config_policy, "repeat_policy": repeat_policy, "filters": filters}, "obtained": {"count": len(selected), "inputs": [{k: r.get(k) for k in keys} for r in selected]}})


def with_upstream(config: dict, upstream: dict[str, dict]) -> dict:
    """A configuration that names the completed runs it rests on, so that its signature changes with theirs."""
    for role, run in upstream.items():
        if run["status"] != "completed":
            raise ValueError(f"{role} is not completed")
    return config | {"upstream": {role: {k: run[k] for k in ("identity", "signature", "config")} for role, run in upstream.items()}}


def read_json_results(spark: SparkSession, root: str, pattern: str = "*{results,summary}.json") -> DataFrame:
    """Rows of all result and summary files below a folder, with their paths; files that can't be parsed give a row with `error`."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    parsed: Column = F.from_json("value", "map<string,string>")
    return rows.select("path", F.when(parsed.isNotNull() & (F.size(parsed) > 0), parsed).alias("values"), F.when(parsed.isNull() | (F.size(parsed) < 1), "not a JSON object").alias("error"))


def load_history(folder: str, spark: SparkSession | None = None) -> dict:
    return files.read_json(spark or SparkSession.active(), f"{folder}/train_history.json")
