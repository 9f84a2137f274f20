"""Selection of runs and comparison tables of results."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_runs(runs: DataFrame, by: list[str]) -> DataFrame:
    """The run that finished last (then of the highest index) for each identity."""
    w = Window.partitionBy(*by).orderBy(F.col("finished_at").desc(), F.col("run_index").desc())
    return runs.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def select_runs(runs: DataFrame, config: str, repeat: str, identity: list[str], signature: str = "signature") -> DataFrame:
    """Runs of each identity by two policies. config: distinct, latest or average over signatures; repeat: distinct, latest, selected or average over runs of one signature."""
    if config not in ("distinct", "latest", "average") or repeat not in ("distinct", "latest", "selected", "average"):
        raise ValueError("no such policy")
    out = runs
    if repeat in ("latest", "selected"):
        out = latest_runs(out, [*identity, signature])
    if config == "latest":
        newest = latest_runs(out, identity).select(*identity, signature)
        out = out.join(newest, [*identity, signature], "left_semi")
    label = F.lit("average") if config == "average" else F.col(signature)
    return out.withColumn("label", F.concat_ws("__", *identity, label, *([F.concat(F.lit("run_"), "run_index")] if repeat == "distinct" else [])))


def selectable(status: Column, ready: Column, same_launch: Column) -> Column:
    """Completed runs, and running ones that are ready within the same launch."""
    return (status == "completed") | ((status == "running") & ready & same_launch)


def differing_keys(runs: DataFrame, by: list[str], config: str = "config") -> DataFrame:
    """(by..., key) of configuration keys with more than one value in a group."""
    rows = runs.select(*by, F.explode(config).alias("key", "value"))
    return rows.groupBy(*by, "key").agg(F.count_distinct("value").alias("values")).filter("values > 1")


def over_seeds(results: DataFrame, by: list[str]) -> DataFrame:
    """Mean over finite values, sample deviation (none for one seed), and count."""
    v = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return results.groupBy(*by).agg(F.avg(v).alias("mean"), F.when(F.count(v) > 1, F.stddev_samp(v)).alias("dev"), F.count(v).alias("seeds"))


def improvement(current: Column, reference: Column, lower_is_better: bool = True) -> Column:
    """Percent by which the current value is better, relative to the size of the reference; none for a reference of 0."""
    sign = 1 if lower_is_better else -1
    return F.when(reference != 0, sign * (reference - current) / F.abs(reference) * 100)


def scale_exponent(value: Column) -> Column:
    """Exponent of the median size of values other than 0 (an aggregate)."""
    size = F.when(value != 0, F.abs(value))
    return F.floor(F.log10(F.percentile(size, 0.5))).cast("long")


def best_flags(table: DataFrame, row: list[str], value: str = "mean") -> DataFrame:
    least = F.min(value).over(Window.partitionBy(*row))
    return table.withColumn("best", F.abs(F.col(value) - least) <= F.abs(least) * 1e-12)


def compare(table: DataFrame, reference: str, row: list[str]) -> DataFrame:
    """Rows with the reference method's mean beside each method's, and the improvement on it. The reference is one row for each table row."""
    base = table.filter(F.col("method") == reference).select(*row, F.col("mean").alias("reference"))
    return table.join(base, row, "left").withColumn("gain", improvement(F.col("mean"), F.col("reference")))


def render_latex(cells: list[dict], row: list[str], methods: list[str], decimals: int = 2) -> str:
    """A LaTeX table of a small, collected comparison: one line for each row, the best in bold, deviations after ±."""
    by: dict[tuple, dict[str, dict]] = {}
    for c in cells:
        by.setdefault(tuple(c[k] for k in row), {})[c["method"]] = c
    lines = [" & ".join([*row, *methods]) + r" \\"]
    for key, got in by.items():
        shown = []
        for m in methods:
            c = got.get(m)
            if c is None or c["mean"] is None:
                shown.append("--")
                continue
            text = f"{c['mean']:.{decimals}f}"
            text = rf"\textbf{{{text}}}" if c.get("best") else text
            shown.append(text + (rf" $\pm$ {c['dev']:.{decimals}f}" if c.get("dev") is not None else ""))
        lines.append(" & ".join([*map(str, key), *shown]) + r" \\")
    return "\n".join(lines)


def render_html(cells: list[dict], row: list[str], methods: list[str], decimals: int = 2, caption: str = "") -> str:
    """An HTML table of a small, collected comparison: a line for each row, missing cells as --, the best in bold, deviations after ±, all names escaped."""
    by: dict[tuple, dict[str, dict]] = {}
    for c in cells:
        by.setdefault(tuple(c[k] for k in row), {})[c["method"]] = c

    def shown(c: dict | None) -> str:
        if c is None or c["mean"] is None or c["mean"] != c["mean"]:
            return "--"
        text = f"{c['mean']:.{decimals}f}" + (f" ± {c['dev']:.{decimals}f}" if c.get("dev") is not None else "")
        return f"<b>{text}</b>" if c.get("best") else text

    head = "".join(f"<th>{html.escape(str(n))}</th>" for n in (*row, *methods))
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(k))}</td>" for k in key) + "".join(f"<td>{shown(got.get(m))}</td>" for m in methods) + "</tr>" for key, got in by.items())
    title = f"<caption>{html.escape(caption)}</caption>" if caption else ""
    return f"<table>{title}<thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def family_tables(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(family, method, seeds, metric, mean, dev, best) of results (family, method, seed, metrics...): what tables and bar charts of a family show. The deviation is that of a sample, null for one seed; the best of a family and metric is the least finite mean."""
    long = rows.unpivot(["family", "method", "seed"], metrics, "metric", "value")
    known = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    table = long.groupBy("family", "method", "metric").agg(F.count_distinct("seed").alias("seeds"), F.avg(known).alias("mean"), F.when(F.count(known) > 1, F.stddev_samp(known)).alias("dev"))
    return best_flags(table, ["family", "metric"]).withColumn("best", F.coalesce("best", F.lit(False)))


def binned_density(rows: DataFrame, column: str, width: float, bandwidth: float, reach: int) -> DataFrame:
    """(bin, density): counts on a grid of `width`, each spread over `reach` bins to both sides by a Gaussian of `bandwidth`. Bins are counted where rows are; only they are smoothed."""
    bins = rows.groupBy(F.floor(F.col(column) / width).cast("long").alias("b")).agg(F.count("*").alias("n"))
    total = bins.agg(F.sum("n").alias("total"))
    wide = bins.withColumn("o", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    spread = wide.select((F.col("b") + F.col("o")).alias("bin"), (F.col("n") * F.exp(-0.5 * F.pow(F.col("o") * width / bandwidth, F.lit(2.0)))).alias("w"))
    summed = spread.groupBy("bin").agg(F.sum("w").alias("w")).join(F.broadcast(total))  # one row
    return summed.select("bin", (F.col("w") / F.col("total") / bandwidth / F.sqrt(2 * F.pi())).alias("density"))


def tiles(rows: DataFrame, a: str, b: str, count: int) -> DataFrame:
    """`rows` with `<a>_tile` and `<b>_tile`: `count` even parts of each whole-numbered column's range, from 0."""
    ranges = rows.agg(F.min(a).alias("_a0"), F.max(a).alias("_a1"), F.min(b).alias("_b0"), F.max(b).alias("_b1"))
    part = lambda c, lo, hi: F.floor((F.col(c) - F.col(lo)) * count / (F.col(hi) - F.col(lo) + 1)).cast("long")
    return rows.join(F.broadcast(ranges)).withColumn(f"{a}_tile", part(a, "_a0", "_a1")).withColumn(f"{b}_tile", part(b, "_b0", "_b1")).drop("_a0", "_a1", "_b0", "_b1")  # one row
