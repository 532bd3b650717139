"""Site-level state smoothing.

With no shared factors and a diagonal error covariance the states of different sites are
independent, so each site is a first-order autoregression seen by several instruments. This
replaces the joint maximum-likelihood fit, which is one sequential optimiser over one matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import small_side, staged


def error_variances(spread: DataFrame, reference: str, floor: float = 1e-6) -> DataFrame:
    """Observation variance per instrument from its match-up spread against the reference."""
    rows = spread.where((F.col("reference") == reference) & F.col("pooled"))
    return rows.select(F.col("target").alias("variable"), F.greatest(F.col("rsd") * F.col("rsd"), F.lit(floor)).alias("r"))


def collapse(resid: DataFrame, variances: DataFrame) -> DataFrame:
    """Instruments of one site and date as one precision-weighted observation: (site, date, ybar, rbar).

    ``resid`` has (site, date, variable, resid), already free of intercept and season.
    """
    rows = resid.where(F.col("resid").isNotNull()).join(small_side(variances.select("variable", "r")), "variable")
    w = F.sum(F.lit(1.0) / F.col("r"))
    return rows.groupBy("site", "date").agg((F.sum(F.col("resid") / F.col("r")) / w).alias("ybar"), (F.lit(1.0) / w).alias("rbar"))


# ---- parallel in time -----------------------------------------------------------------------
#
# A bin of the filter is an element (a, b, c, e, j): given the state before it, the state after is normal with mean a x + b and
# variance c, and e, j weigh what the bin's observation says about the state before. Elements combine associatively, so a series is cut into
# blocks of bins: blocks are scanned on their own, their totals are scanned in the order of time, and what comes in is applied
# to all bins of a block at once. The smoother does the same backwards with elements (g, m, l): mean g x + m and variance l given the state after.

#: Bins of one block.
BLOCK = 4096
FORWARD, BACKWARD = ("a", "b", "c", "e", "j"), ("g", "m", "l")


def _forward(first: tuple, second: tuple) -> tuple:
    """Two elements of the filter, ``first`` earlier, as one."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = first, second
    d = 1.0 / (1.0 + c1 * j2)
    return a2 * a1 * d, a2 * d * (b1 + c1 * e2) + b2, a2 * a2 * c1 * d + c2, a1 * d * (e2 - j2 * b1) + e1, a1 * a1 * j2 * d + j1


def _backward(later: tuple, earlier: tuple) -> tuple:
    """Two elements of the smoother as one; the first argument is what was scanned before, which is later in time."""
    (g2, m2, l2), (g1, m1, l1) = later, earlier
    return g1 * g2, g1 * m2 + m1, g1 * g1 * l2 + l1


def _scan(elements: tuple, combine) -> tuple:
    """All prefixes along the last axis, in as many vectorised steps as the length has bits."""
    import numpy as np

    step, n = 1, elements[0].shape[-1]
    while step < n:
        joined = combine(tuple(x[..., :-step] for x in elements), tuple(x[..., step:] for x in elements))
        elements = tuple(np.concatenate([x[..., :step], y], axis=-1) for x, y in zip(elements, joined))
        step *= 2
    return elements


def _elements(y, r, rho, tau) -> tuple:
    """Elements of a block of bins for every candidate: arrays (candidates x bins). NaN is no observation."""
    import numpy as np

    seen = ~np.isnan(y)
    y, r = np.where(seen, y, 0.0), np.where(seen, r, 1.0)
    rho, tau = rho[:, None], tau[:, None]
    spread = tau + r
    gain = np.where(seen, tau / spread, 0.0)
    return (1.0 - gain) * rho, gain * y, (1.0 - gain) * tau, np.where(seen, rho * y / spread, 0.0), np.where(seen, rho * rho / spread, 0.0)


@dataclass(frozen=True)
class Axis:
    """The time axis and how it is cut."""

    start: object
    time_step: int
    last_bin: int
    size: int

    @property
    def last_block(self) -> int:
        return self.last_bin // self.size


class _Block:
    """A block's observations, its filter, and what comes out of them."""

    def __init__(self, row, candidates, axis: Axis):
        import numpy as np

        low = row.block * axis.size
        n = min(axis.size, axis.last_bin + 1 - low)
        self.bins = np.arange(low, low + n)
        self.y, self.r = np.full(n, np.nan), np.full(n, np.nan)
        if row.bins is not None:
            at = np.asarray(row.bins, int) - low
            self.y[at], self.r[at] = row.ybar, row.rbar
        self.rho, self.tau = (np.array([c[k] for c in candidates], float) for k in (0, 1))
        self.forward = _scan(_elements(self.y, self.r, self.rho, self.tau), _forward)

    def filtered(self, mean, var):
        """Mean and variance after every bin, given those before the first."""
        a, b, c, e, j = self.forward
        d = 1.0 / (1.0 + var[:, None] * j)
        return a * d * (mean[:, None] + var[:, None] * e) + b, a * a * var[:, None] * d + c

    def backward(self, mean, var):
        """The smoother's elements; scanning them from the end gives what a block says given the state after it."""
        m, v = self.filtered(mean, var)
        rho, tau = self.rho[:, None], self.tau[:, None]
        ahead = rho * rho * v + tau
        back = v * rho / ahead
        return tuple(x[:, ::-1] for x in (back, m * (1.0 - back * rho), v - back * back * ahead))


def _blocks(observed: DataFrame, axis: Axis, sites: DataFrame | None = None) -> DataFrame:
    """Every (site, block) with its observations as arrays of at most a block's bins, written once."""
    bin_no = F.floor(F.datediff("date", F.lit(axis.start)) / F.lit(axis.time_step)).cast("int")
    rows = observed.select("site", bin_no.alias("bin"), "ybar", "rbar").where(F.col("bin").between(0, axis.last_bin))
    own = rows.groupBy("site", F.floor(F.col("bin") / axis.size).cast("int").alias("block")).agg(F.sort_array(F.collect_list(F.struct("bin", "ybar", "rbar"))).alias("o"))
    named = observed.select("site") if sites is None else observed.select("site").unionByName(sites.select("site"))
    every = named.distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(axis.last_block))))
    table = every.join(own, ["site", "block"], "left")
    return staged(table.select("site", "block", F.col("o.bin").alias("bins"), F.col("o.ybar").alias("ybar"), F.col("o.rbar").alias("rbar")), "blocks")


def _per_block(blocks: DataFrame, candidates, axis: Axis, made, schema: str) -> DataFrame:
    """``made(block, row)`` gives a frame for each block."""

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                out = made(_Block(row, candidates, axis), row)
                if out is not None:
                    yield out

    return blocks.mapInPandas(run, schema)


def _list_columns(names: tuple[str, ...]) -> str:
    return ", ".join(f"{c} array<double>" for c in names)


def _incoming(totals: DataFrame, names: tuple[str, ...], combine, before, reverse: bool) -> DataFrame:
    """What each block of a site gets from those before it (after it, when reversed): one row a block, one group a site, so a group has a row for each block of a series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("block", ascending=not reverse)
        elements = tuple(np.array(pdf[c].tolist()).T for c in names)  # candidates x blocks
        first = tuple(np.full((elements[0].shape[0], 1), float(x)) for x in before)
        through = _scan(tuple(np.concatenate([f, x], axis=1) for f, x in zip(first, elements)), combine)
        out = pdf[["site", "block"]].copy()
        for c, x in zip(names, through):
            out[c] = list(x[:, :-1].T)
        return out

    kind = totals.schema["site"].dataType.simpleString()
    return totals.groupBy("site").applyInPandas(run, f"site {kind}, block int, {_list_columns(names)}")


def _one_row(row, names: tuple[str, ...], elements: tuple) -> pd.DataFrame:
    return pd.DataFrame({"site": [row.site], "block": [row.block], **{c: [list(x[:, -1])] for c, x in zip(names, elements)}})


def _filter_inputs(blocks: DataFrame, candidates, axis: Axis, init_var: float) -> DataFrame:
    """The blocks with the mean and variance of the state before each (lists, a value for each candidate)."""
    kind = blocks.schema["site"].dataType.simpleString()
    totals = _per_block(blocks, candidates, axis, lambda block, row: _one_row(row, FORWARD, block.forward), f"site {kind}, block int, {_list_columns(FORWARD)}")
    came = _incoming(totals, FORWARD, _forward, (0.0, 0.0, init_var, 0.0, 0.0), False)
    return staged(blocks.join(came.select("site", "block", F.col("b").alias("mean"), F.col("c").alias("var")), ["site", "block"]), "filtered")


def _arrays(*lists):
    import numpy as np

    return tuple(np.asarray(x, float) for x in lists)


def smooth(observed: DataFrame, start, last_bin: int, rho: float, tau: float, init_var: float = 1.0, time_step: int = 1, block_bins: int = BLOCK, sites: DataFrame | None = None) -> DataFrame:
    """Filter and smoother per site over every bin of the axis: (site, date, x, se).

    One series spans as many tasks as it has blocks. The state starts at mean 0 and variance ``init_var`` one step before the first
    bin; bins without data are prediction only. Observations outside the axis are ignored.
    ``sites`` names sites that get states even without any observation.
    """
    import numpy as np

    axis = Axis(start, time_step, int(last_bin), block_bins)
    model = [(float(rho), float(tau))]
    kind = observed.schema["site"].dataType.simpleString()
    came = _filter_inputs(_blocks(observed, axis, sites), model, axis, init_var)

    def backward(block, row):
        elements = block.backward(*_arrays(row.mean, row.var))
        return _scan(_closed(block, row, elements) if row.block == axis.last_block else elements, _backward)

    def total(block, row):
        return _one_row(row, BACKWARD, backward(block, row))

    totals = _per_block(came, model, axis, total, f"site {kind}, block int, {_list_columns(BACKWARD)}")
    after = _incoming(totals, BACKWARD, _backward, (0.0, 0.0, 0.0), True)

    def states(block, row):
        g, m, l = backward(block, row)
        next_mean, next_var = (x[:, None] for x in _arrays(row.next_mean, row.next_var))
        x, var = (g * next_mean + m)[0, ::-1], (g * g * next_var + l)[0, ::-1]
        return pd.DataFrame({"site": row.site, "bin": block.bins, "x": x, "se": np.sqrt(var)})

    both = came.join(after.select("site", "block", F.col("m").alias("next_mean"), F.col("l").alias("next_var")), ["site", "block"])
    out = _per_block(both, model, axis, states, f"site {kind}, bin int, x double, se double")
    return out.select("site", F.date_add(F.lit(start), F.col("bin") * F.lit(time_step)).alias("date"), "x", "se")


def _closed(block: _Block, row, elements: tuple) -> tuple:
    """The last block's elements (from the end): its last bin's state is the filter's and waits for nothing."""
    m, v = block.filtered(*_arrays(row.mean, row.var))
    out = tuple(x.copy() for x in elements)
    for x, end in zip(out, (0.0, m[:, -1], v[:, -1])):
        x[:, 0] = end
    return out


def log_likelihoods(observed: DataFrame, start, candidates: list[tuple[float, float]], init_var: float = 1.0, time_step: int = 1, last_bin: int | None = None, block_bins: int = BLOCK) -> DataFrame:
    """(rho, tau, log_likelihood) of every candidate, summed over sites.

    A grid search, not a maximum-likelihood optimiser. All candidates go through the blocks of :func:`smooth`'s filter together.
    Without ``last_bin`` the axis ends with the last observation, which is the same: later bins add nothing.
    """
    import numpy as np

    if last_bin is None:
        span = observed.agg(F.max(F.datediff("date", F.lit(start))).alias("d")).first()["d"]
        last_bin = max(int(span or 0), 0) // time_step
    axis = Axis(start, time_step, int(last_bin), block_bins)
    model = [(float(a), float(t)) for a, t in candidates]
    came = _filter_inputs(_blocks(observed, axis), model, axis, init_var)

    def score(block, row):
        mean, var = _arrays(row.mean, row.var)
        m, v = block.filtered(mean, var)
        m, v = (np.concatenate([first[:, None], x[:, :-1]], axis=1) for first, x in ((mean, m), (var, v)))
        rho, tau = block.rho[:, None], block.tau[:, None]
        at = ~np.isnan(block.y)
        spread = (rho * rho * v + tau + block.r)[:, at]
        err = block.y[at] - (rho * m)[:, at]
        return pd.DataFrame({"k": range(len(model)), "ll": -0.5 * (np.log(2 * np.pi * spread) + err * err / spread).sum(axis=1)})

    scored = _per_block(came, model, axis, score, "k int, ll double").groupBy("k").agg(F.sum("ll").alias("log_likelihood"))
    names = F.array(*[F.struct(F.lit(a).alias("rho"), F.lit(t).alias("tau")) for a, t in model])
    return scored.select(F.element_at(names, F.col("k") + 1).alias("c"), "log_likelihood").select("c.rho", "c.tau", "log_likelihood")


def best_candidate(scores: DataFrame) -> tuple[float, float]:
    """(rho, tau) with the highest log-likelihood."""
    row = scores.agg(F.max_by(F.struct("rho", "tau"), "log_likelihood").alias("b")).first()["b"]
    return row["rho"], row["tau"]
