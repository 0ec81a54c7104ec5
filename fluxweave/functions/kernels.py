"""Aggregate kernels: the statistics that the feature groups are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .recipe import Recipe

QUARTILES = (0.25, 0.5, 0.75)
NINE = ("mean", "std", "min", "max", "median", "q1", "q3", "skew", "kurt")


def whole(value: Column, integer: bool) -> Column:
    return F.floor(value).cast("double") if integer else value


def flag(condition: Column) -> Column:
    return condition.cast("int")


class Stats:
    """The nine statistics of a value over a flow's packets (or cells) where it is not null.

    Quantiles of longer flows are read from counts by value; only short flows are gathered in an array.
    """

    def __init__(self, r: Recipe, prefix: str, x: Column, integer: bool, cells: str | None = None):
        """cells: of cells, by which of their measures x grows."""
        x, a, add = x.cast("double"), f"_{prefix}", r.cell_agg if cells else r.agg
        self.prefix, self.integer = prefix, integer
        self.n, self.mean, self.lo, self.hi = add(a + "_n", F.count(x)), add(a + "_avg", F.avg(x)), add(a + "_lo", F.min(x)), add(a + "_hi", F.max(x))
        self.deviation = add(a + "_sd", F.stddev_samp(x))
        self.ranks = r.cell_quantiles(prefix, x, list(QUARTILES), cells) if cells else r.quantiles(prefix, x, list(QUARTILES))
        self.add, self.a, self.x = add, a, x

    def sd(self) -> Column:
        return F.coalesce(self.deviation, F.lit(0.0))

    def moments(self) -> tuple[Column, Column]:
        n, sd = self.n, self.sd()
        skewness, kurtosis = self.add(self.a + "_sk", F.skewness(self.x)), self.add(self.a + "_ku", F.kurtosis(self.x))
        share = (n - 1) / n
        return F.when((n < 3) | (sd == 0), 0.0).otherwise(skewness * F.pow(share, F.lit(1.5))), F.when((n < 4) | (sd == 0), 0.0).otherwise((kurtosis + 3) * F.pow(share, F.lit(2.0)) - 3)

    def columns(self) -> dict[str, Column]:
        some = lambda value: F.when(F.coalesce(self.n, F.lit(0)) > 0, value)
        q1, median, q3 = (whole(q, self.integer) for q in self.ranks)
        skew, kurt = self.moments()
        return {f"{self.prefix}_{s}": v for s, v in zip(NINE, (self.mean, some(self.sd()), self.lo, self.hi, median, q1, q3, some(skew), some(kurt)))}

    def cv(self) -> Column:
        return F.when(self.n > 0, F.when(self.mean == 0, 0.0).otherwise(self.sd() / self.mean))


class RunningStats(Stats):
    """The same with third and fourth moments by a recurrence that depends on the order of the packets."""

    def __init__(self, r: Recipe, prefix: str, x: Column, integer: bool):
        super().__init__(r, prefix, x, integer)
        x = x.cast("double")
        k, s = r.so_far(f"_k_{prefix}", x.isNotNull().cast("long")), r.so_far(f"_s_{prefix}", x)
        before, k = F.when(k > 1, (s - x) / (k - 1)).otherwise(0.0), F.nullif(k, F.lit(0))
        d, d2 = r.column(f"_d_{prefix}", x - before, 1), r.column(f"_e_{prefix}", x - s / k, 1)
        self.t3 = r.agg(self.a + "_t3", F.sum(d * d2 * d2 * (1 - 3 / k)))
        self.t4 = r.agg(self.a + "_t4", F.sum(d * d2 * d2 * d2 - 4 * d * d * d2 * d2 / k + 6 * d2 * d2 * d2 / (k * k)))

    def moments(self) -> tuple[Column, Column]:
        n, v = self.n, self.sd() * self.sd()
        return F.when((n < 3) | (v == 0), 0.0).otherwise(self.t3 / n / F.pow(v, F.lit(1.5))), F.when((n < 4) | (v == 0), 0.0).otherwise(self.t4 / n / F.pow(v, F.lit(2.0)) - 3)


def entropy(r: Recipe, grain: str, name: str) -> Column:
    """Shannon entropy (bits) of the counts n of a grain's cells."""
    n = F.when(F.col("grain") == grain, F.col("n"))
    total, terms = r.cell_agg(f"_n_{name}", F.sum(n)), r.cell_agg(f"_t_{name}", F.sum(n * F.log2(n)))
    return F.log2(total) - terms / total


class Lagged:
    """Sums of products of a value with that of so many packets before, less a constant near it; means come off afterwards."""

    def __init__(self, r: Recipe, prefix: str, x: Column, before: dict[int, Column]):
        """before: the value so many packets before, null where there is none."""
        r.lagged[prefix] = (x, *before.values())
        total = lambda name, v: r.agg(f"_{prefix}_{name}", F.coalesce(F.sum(v.cast("double")), F.lit(0.0)))
        self.n, self.s, self.s2 = r.agg(f"_{prefix}_n", F.count(x)), total("s", x), total("s2", x.cast("double") * x)
        self.mean = F.when(self.n > 0, self.s / self.n)
        self.parts = {}
        for k, y in before.items():  # from 1 on
            x_, y_ = F.when(y.isNotNull(), x).cast("double"), F.when(x.isNotNull(), y).cast("double")
            self.parts[k] = (r.agg(f"_{prefix}_c{k}", F.count(y_ * x_)), total(f"x{k}", x_), total(f"y{k}", y_), total(f"xy{k}", x_ * y_), total(f"yy{k}", y_ * y_))

    def products(self, k: int) -> Column:
        c, x, y, xy, _ = self.parts[k]
        return xy - self.mean * (x + y) + c * self.mean * self.mean

    def squares(self, k: int | None = None) -> Column:
        """Of all values, or of those that have one k packets later."""
        c, y, yy = (self.n, self.s, self.s2) if k is None else (self.parts[k][0], self.parts[k][2], self.parts[k][4])
        return yy - 2 * self.mean * y + c * self.mean * self.mean

    def correlations(self, name: str, least: int | None = None) -> dict[str, Column]:
        """name_1.. of the lags; 0 for up to least values (as many as the lag by default)."""
        return {f"{name}_{k}": F.when((self.n > (k if least is None else least)) & (self.squares(k) > 0), self.products(k) / self.squares(k)).otherwise(0.0) for k in self.parts}
