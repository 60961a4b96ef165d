"""GARCH(1,1) by maximum likelihood on series of any length: the variance recursion as a parallel scan.

For one beta the variance before a return is an affine function of the one at the start of its block: the omegas add up
to a geometric sum, the squared returns to a sum that decays by beta, and the start's own share decays too. So a round of
the grid search maps blocks twice: first each gives what it adds to the decayed sum for the nine betas of the grid, which
is composed over the blocks of the series; then each adds up the likelihood of the whole grid from its own start. Only
sums leave a block, and no group is larger than one: a series has as many rows to compose as it has blocks.

Every symbol has its own grid, which shrinks around its best point; symbols stay rows of a table throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.kernels import GRID, GRID_CENTRE, GRID_ROUNDS, GRID_SPAN, decayed
from brindle.sources.tables import discard, written

_AXES = ("w", "a", "b")


def _axis(centre: float, span: float) -> np.ndarray:
    return np.linspace(centre - span, centre + span, GRID)


def _parts(returns: DataFrame, block: int) -> DataFrame:
    """symbol, block, begin (returns before it), r2: the squared returns of each block in order."""
    rows = returns.withColumn("_i", (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).cast("long"))
    rows = rows.groupBy("symbol", F.expr(f"_i div {block}").alias("block")).agg(F.min("_i").alias("begin"), F.sort_array(F.collect_list(F.struct("_i", F.col("r2").alias("v")))).alias("_r"))
    return rows.select("symbol", "block", "begin", F.transform("_r", lambda s: s["v"]).alias("r2"))


_FIT = "symbol string, target double, n long, " + ", ".join(f"c{x} double, s{x} double" for x in _AXES)


def _starts(parts: DataFrame, fits: DataFrame) -> DataFrame:
    """The fit's columns of every block, with what the squared returns before it have decayed to under each beta; and a last row, of no block, for the end."""
    keys = parts.select("symbol", "block").join(fits, "symbol")

    def added(batches):
        for pdf in batches:
            ends = [decayed(np.asarray(r2), _axis(c, s))[:, -1].tolist() for r2, c, s in zip(pdf["r2"], pdf["cb"], pdf["sb"])]
            yield pdf.assign(size=pdf["r2"].map(len), add=ends).drop(columns="r2")

    schema = "symbol string, block long, begin long, " + _FIT.removeprefix("symbol string, ") + ", size long, add array<double>"
    sums = parts.join(keys, ["symbol", "block"]).select("symbol", "block", "begin", "r2", *[c.split()[0] for c in _FIT.split(", ")[1:]]).mapInPandas(added, schema)

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        betas, sums, out = _axis(pdf["cb"].iloc[0], pdf["sb"].iloc[0]), np.zeros(GRID), []
        for size, add in zip(pdf["size"], pdf["add"]):
            out.append(sums.tolist())
            sums = sums * betas ** float(size) + np.asarray(add)
        end = pdf.iloc[[-1]].assign(block=-1, begin=pdf["n"].iloc[0])
        return pd.concat([pdf, end], ignore_index=True).assign(start=[*out, sums.tolist()]).drop(columns=["size", "add"])

    return sums.groupBy("symbol").applyInPandas(composed, schema.replace(", size long, add array<double>", ", start array<double>"))


def _losses(parts: DataFrame, starts: DataFrame) -> DataFrame:
    """symbol, i, loss: the negative log-likelihood (times two, less a constant) of every allowed point of the grid."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                x = np.asarray(row.r2)
                omegas, alphas, betas = row.target * np.exp(_axis(row.cw, row.sw)), _axis(row.ca, row.sa), _axis(row.cb, row.sb)
                sums, t = decayed(x, betas)[:, :-1], row.begin + np.arange(len(x), dtype=float)
                for k, beta in enumerate(betas):
                    good = np.flatnonzero((alphas >= 0) & (beta >= 0) & (alphas + beta < 1))
                    if not len(good):
                        continue
                    gone = beta**t
                    s = sums[k] + row.start[k] * beta ** np.arange(len(x), dtype=float)
                    for j in good:
                        h = omegas[:, None] * ((1 - gone) / (1 - beta)) + (alphas[j] * s + gone * row.target)
                        out.append((row.symbol, (j * GRID + np.arange(GRID)) * GRID + k, (np.log(h) + x / h).sum(1)))
            if out:
                yield pd.DataFrame({"symbol": np.repeat([o[0] for o in out], GRID), "i": np.concatenate([o[1] for o in out]), "loss": np.concatenate([o[2] for o in out])})

    rows = parts.join(starts.drop("begin"), ["symbol", "block"])
    return rows.mapInPandas(run, "symbol string, i long, loss double").groupBy("symbol", "i").agg(F.sum("loss").alias("loss"))


def _nearer(fits: DataFrame, losses: DataFrame) -> DataFrame:
    """The grids around their best points; an axis halves unless its best point lay in its outer part."""
    best = losses.join(fits.select("symbol", "n"), "symbol").withColumn("loss", F.round(F.col("loss") / F.col("n"), 10))
    best = best.groupBy("symbol").agg(F.min(F.struct("loss", "i"))["i"].alias("_i"))
    steps = {"a": F.expr(f"_i div {GRID * GRID}"), "w": F.expr(f"_i div {GRID}") % GRID, "b": F.col("_i") % GRID}
    out = fits.join(best, "symbol")
    new = {}
    for x in _AXES:
        shift = (steps[x] * (2.0 / (GRID - 1)) - 1) * F.col(f"s{x}")
        new |= {f"c{x}": F.col(f"c{x}") + shift, f"s{x}": F.when(F.abs(shift) > 0.6 * F.col(f"s{x}"), F.col(f"s{x}")).otherwise(F.col(f"s{x}") / 2)}
    return out.withColumns(new).drop("_i")


def next_variances(returns: DataFrame, block: int = 4096) -> DataFrame:
    """symbol, variance: of the next return, from series (symbol, ts, r2 not null, not all 0) that are fitted in blocks."""
    spark = returns.sparkSession
    parts, path = written(_parts(returns, block), "garch-parts")
    sizes = parts.groupBy("symbol").agg(F.expr("sum(aggregate(r2, 0D, (s, v) -> s + v))").alias("_sum"), F.sum(F.size("r2")).alias("n"))
    start = {f"{p}{x}": F.lit(float(v)) for p, vs in (("c", GRID_CENTRE), ("s", GRID_SPAN)) for x, v in zip(_AXES, vs)}
    fits, old = written(sizes.select("symbol", (F.col("_sum") / F.col("n")).alias("target"), "n", *[v.alias(k) for k, v in sorted(start.items(), key=lambda kv: (_AXES.index(kv[0][1]), kv[0]))]), "garch-fits")
    for _ in range(GRID_ROUNDS):
        fits, new = written(_nearer(fits, _losses(parts, _starts(parts, fits))), "garch-fits")
        discard(spark, old)
        old = new
    end = _starts(parts, fits.withColumns({f"s{x}": F.lit(0.0) for x in _AXES})).filter("block = -1")
    gone = F.pow("cb", F.col("n").cast("double"))
    h = F.col("target") * F.exp("cw") * (1 - gone) / (1 - F.col("cb")) + F.col("ca") * F.element_at("start", 1) + gone * F.col("target")
    out, _ = written(end.select("symbol", h.alias("variance")), "garch-variances")
    discard(spark, path, old)
    return out
