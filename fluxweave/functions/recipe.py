"""What feature groups ask of the packets of flows, gathered first and then computed together in one plan.

A flow of at most one segment of packets is dealt out whole: all of its values come from windows and groups by flow, which need no further exchange. A longer flow
is dealt out in segments, so that it is no single task. Values of neighbouring packets then come from a halo: copies of the last packets of the
segment before. Running values are scanned in two levels: within a segment, and over one summary row for each segment, whose prefix is carried
into the next. All readers of the dealt-out packets ask for the same columns, so Spark deals them out once and reuses that.
Statistics of the values of short flows are computed by numpy, over many flows at once, from an array a flow; those of longer ones by aggregates and counts by value.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FlowConfig
from .udfs import MOMENTS, PRODUCTS, statistics

#: Packets of a flow up to which its values are gathered in an array.
SHORT = 1 << 12
#: Packets of the segment before that a segment gets a copy of: as many as the farthest lag reaches, and one more for what is made of a lag.
HALO = 8
_MERGED = {"sum": F.sum, "min": F.min, "max": F.max}


class Layer:
    """Columns of packets that need no other column of their layer but in the order of depth."""

    def __init__(self):
        self.lags: dict[str, tuple[str, int]] = {}
        self.lasts: dict[str, Column] = {}
        self.sums: dict[str, Column] = {}
        self.totals: dict[str, tuple[str, Column]] = {}
        self.columns: list[dict[str, Column]] = [{}, {}, {}]

    @property
    def ordered(self) -> bool:
        return bool(self.lags or self.carried)

    @property
    def carried(self) -> bool:
        return bool(self.lasts or self.sums or self.totals)


class Recipe:
    """Columns of packets in two layers, aggregates of packets, cells (packets of a flow that share a key of a grain), aggregates of cells, and output columns."""

    def __init__(self, cfg: FlowConfig, columns: list[str]):
        self.cfg, self.has = cfg, set(columns)
        self.made: dict[str, Column] = {}
        self.layers = (Layer(), Layer())
        self.aggregates: dict[str, Column] = {}
        self.cells: dict[tuple[str, ...], tuple[Column, dict[str, Column]]] = {}
        self.cell_aggregates: dict[str, Column] = {}
        self.gathers: dict[str, Column] = {}
        self.cell_gathers: dict[str, Column] = {}
        self.ranked: dict[str, tuple[Column, list[float]]] = {}
        self.cell_ranked: dict[str, tuple[Column, list[float]]] = {}
        self.lagged: dict[str, tuple[Column, ...]] = {}
        self.cell_orders: set[tuple[str, float]] = set()
        self.afters: dict[str, Column] = {}
        self.outputs: dict[str, Column] = {}

    def value(self, name: str, column: Column) -> Column:
        """A column of packets by itself, before they are dealt out."""
        self.made[name] = column
        return F.col(name)

    def lag(self, name: str, k: int = 1, layer: int = 0) -> Column:
        """A column's value k packets before; k is at most HALO - 2."""
        self.layers[layer].lags[f"_{k}_before_{name}"] = (name, k)
        return F.col(f"_{k}_before_{name}")

    def last(self, name: str, value: Column) -> Column:
        """The last value that is not null among the packets before."""
        self.layers[0].lasts[name] = value
        return F.col(name)

    def total(self, name: str, how: str, value: Column, layer: int = 0) -> Column:
        """The sum, min or max over the whole flow, at each of its packets."""
        self.layers[layer].totals[name] = (how, value)
        return F.col(name)

    def so_far(self, name: str, value: Column) -> Column:
        """The sum over the packet and those before it; of columns of the first layer."""
        self.layers[1].sums[name] = value
        return F.col(name)

    def column(self, name: str, value: Column, layer: int = 0, depth: int = 0) -> Column:
        self.layers[layer].columns[depth][name] = value
        return F.col(name)

    def agg(self, name: str, aggregate: Column) -> Column:
        """An aggregate of packets with a buffer of fixed size; gathered() is for others."""
        self.aggregates[name] = aggregate
        return F.col(name)

    def gathered(self, name: str, aggregate: Column) -> Column:
        """A bounded array or a text of a flow's packets: kept apart, so that the other aggregates stay in rows of fixed size."""
        self.gathers[name] = aggregate
        return F.col(name)

    def quantiles(self, name: str, x: Column, shares: list[float]) -> list[Column]:
        """Quantiles of a value of packets, between neighbouring ranks by proportion; read from running counts of the values in order."""
        self.ranked[name] = (x, shares)
        return [F.col(q) for q in _ranks(name, shares)]

    def moments(self, name: str, x: Column) -> tuple[Column, Column]:
        """Mean and sample deviation of a value of packets."""
        self.ranked[name] = (x, [])
        return self.agg(f"_{name}_avg", F.avg(x)), self.agg(f"_{name}_sd", F.stddev_samp(x))

    def cell_quantiles(self, name: str, x: Column, shares: list[float], by: str) -> list[Column]:
        """The same of a value of cells that grows with their measure by (n or size) within a grain."""
        self.cell_orders |= {(by, share) for share in shares}
        self.cell_ranked[name] = (x, shares)
        return [self.cell_agg(q, F.sum(x.cast("double") * F.col(_by(by, share)))) for q, share in zip(_ranks(name, shares), shares)]

    def cell(self, grain: str, key: Column, **sums: Column) -> None:
        """Packets with a key that is not null add to the cell of that key; measures are summed, null is none."""
        self.cells[grain, *sums] = (key, sums)

    def cell_gathered(self, name: str, aggregate: Column) -> Column:
        self.cell_gathers[name] = aggregate
        return F.col(name)

    def cell_agg(self, name: str, aggregate: Column) -> Column:
        self.cell_aggregates[name] = aggregate
        return F.col(name)

    def after(self, name: str, column: Column) -> Column:
        """A column of aggregates that outputs use more than once."""
        self.afters[name] = column
        return F.col(name)

    def out(self, **columns: Column) -> None:
        self.outputs.update(columns)

    def keep(self, names: Iterable[str]) -> None:
        """Leaves out the other outputs, and what only they need."""
        self.outputs = {name: self.outputs[name] for name in names}
        need = set()

        def of(columns: dict[str, Column]) -> dict[str, Column]:
            kept = {}
            for name, column in reversed(columns.items()):  # what a column needs of its kind was asked for before it
                if name in need:
                    kept[name] = column
                    need.update(_words(column))
            return dict(reversed(kept.items()))

        need.update(*map(_words, self.outputs.values()))
        self.afters = of(self.afters)
        self.aggregates, self.gathers, self.cell_aggregates, self.cell_gathers = map(of, (self.aggregates, self.gathers, self.cell_aggregates, self.cell_gathers))
        self.ranked, self.cell_ranked = ({name: of for name, of in asked.items() if need & set(_told({name: of}, {}))} for asked in (self.ranked, self.cell_ranked))
        self.lagged = {name: of for name, of in self.lagged.items() if need & set(_told({}, {name: of}))}
        self.cell_orders = {(by, share) for by, share in self.cell_orders if _by(by, share) in need}
        self.cells = {name: (key, sums) for name, (key, sums) in self.cells.items() if name[0] in need}  # aggregates of cells name their grains
        need.update(*(_words(x) for x, _ in self.ranked.values()), *(_words(c) for of in self.lagged.values() for c in of), *(_words(c) for key, sums in self.cells.values() for c in (key, *sums.values())))
        for layer in reversed(self.layers):
            layer.columns = list(reversed([of(columns) for columns in reversed(layer.columns)]))
            layer.lasts, layer.sums = of(layer.lasts), of(layer.sums)
            layer.totals = {name: (how, value) for name, (how, value) in layer.totals.items() if name in need}
            layer.lags = {name: (column, k) for name, (column, k) in layer.lags.items() if name in need}
            need.update(*(_words(value) for _, value in layer.totals.values()), (column for column, _ in layer.lags.values()))
        self.made = of(self.made)

    def needed(self, columns: list[str]) -> list[str]:
        """Those of the columns that anything of packets names."""
        every = [*self.made.values(), *self.aggregates.values(), *self.gathers.values(), *(x for x, _ in self.ranked.values()), *(c for of in self.lagged.values() for c in of), *(c for key, sums in self.cells.values() for c in (key, *sums.values()))]
        for layer in self.layers:
            every += [*layer.lasts.values(), *layer.sums.values(), *(v for _, v in layer.totals.values()), *(c for columns in layer.columns for c in columns.values()), *(F.col(c) for c, _ in layer.lags.values())]
        named = {"pkt_no"}.union(*map(_words, every))
        return [c for c in columns if c in named]

    # What several groups use.

    def iat(self) -> Column:
        """µs since the packet before; null for a flow's first."""
        return self.column("iat", F.col("ts_us") - self.lag("ts_us"))

    def begin(self) -> Column:
        """The flow's least time."""
        return self.total("_begin", "min", F.col("ts_us"))

    def tail(self) -> tuple[Column, Column]:
        """Whether a packet is among the last max_sequence, which bounded sequences keep, and whether the one before it is, too."""
        first = F.greatest(self.total("_packets", "max", F.col("pkt_no")) - self.cfg.max_sequence + 1, F.lit(1))
        return F.col("pkt_no") >= first, F.col("pkt_no") > first

    def tail_first(self) -> Column:
        self.tail()
        return F.greatest(F.col("_packets") - self.cfg.max_sequence + 1, F.lit(1))


def _scanned(rows: DataFrame, layer: Layer) -> DataFrame:
    """rows with the lags, running values, totals and columns of a layer."""
    own = ~F.col("_halo")
    order = Window.partitionBy("flow_id", "_segment").orderBy("pkt_no")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    within = {name: F.lag(column, k).over(order) for name, (column, k) in layer.lags.items()}
    within |= {name: F.last(F.when(own, value), True).over(before) for name, value in layer.lasts.items()}
    within |= {name: F.sum(F.when(own, value)).over(upto) for name, value in layer.sums.items()}
    parts = [F.max_by(value, F.when(value.isNotNull(), F.col("pkt_no"))).alias(f"_of_{name}") for name, value in layer.lasts.items()]
    parts += [F.sum(value).alias(f"_of_{name}") for name, value in layer.sums.items()]
    parts += [_MERGED[how](value).alias(f"_of_{name}") for name, (how, value) in layer.totals.items()]
    if layer.carried:
        segments = Window.partitionBy("flow_id").orderBy("_segment")
        earlier, every = segments.rowsBetween(Window.unboundedPreceding, -1), segments.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        carry = [F.last(f"_of_{name}", True).over(earlier).alias(f"_to_{name}") for name in layer.lasts] + [F.sum(f"_of_{name}").over(earlier).alias(f"_to_{name}") for name in layer.sums]
        carry += [_MERGED[how](f"_of_{name}").over(every).alias(name) for name, (how, _) in layer.totals.items()]
        summary = rows.where(own).groupBy("flow_id", "_segment").agg(*parts).select("flow_id", "_segment", *carry)
        rows = rows.withColumns(within) if within else rows
        rows = rows.join(summary.hint("shuffle_hash"), ["flow_id", "_segment"])
        joined = {name: F.coalesce(name, f"_to_{name}") for name in layer.lasts} | {name: F.coalesce(name, F.lit(0)) + F.coalesce(f"_to_{name}", F.lit(0)) for name in layer.sums}
        rows = rows.withColumns(joined).drop(*[f"_to_{name}" for name in joined]) if joined else rows
    elif within:
        rows = rows.withColumns(within)
    for columns in layer.columns:
        rows = rows.withColumns(columns) if columns else rows
    return rows


def _scanned_whole(rows: DataFrame, layer: Layer) -> DataFrame:
    """The same of flows that are dealt out whole: windows over flows alone."""
    order = Window.partitionBy("flow_id").orderBy("pkt_no")
    upto, before, every = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    within = {name: F.lag(column, k).over(order) for name, (column, k) in layer.lags.items()}
    within |= {name: F.last(value, True).over(before) for name, value in layer.lasts.items()}
    within |= {name: F.coalesce(F.sum(value).over(upto), F.lit(0)) for name, value in layer.sums.items()}
    within |= {name: _MERGED[how](value).over(every) for name, (how, value) in layer.totals.items()}
    for columns in (within, *layer.columns):
        rows = rows.withColumns(columns) if columns else rows
    return rows


def _packed(pk: DataFrame, *keys: str) -> DataFrame:
    """keys and the other columns as an array of one: what is in it is neither pruned nor filtered below, so that an exchange there is the same for all readers, and made once."""
    return pk.select(*keys, F.array(F.struct(*[c for c in pk.columns if c not in keys])).alias("_p"))


def _dealt_whole(pk: DataFrame, together: bool) -> DataFrame:
    """pk by flow."""
    packed = _packed(pk, "flow_id")
    return (packed if together else packed.repartition("flow_id")).select("flow_id", F.inline("_p"))


def _dealt(pk: DataFrame, segment: int) -> DataFrame:
    """pk by flow and segment of so many packets, with a segment's halo."""
    place = F.col("pkt_no") - 1
    own = F.floor(place / segment).cast("int")
    to = F.when(place % segment >= segment - HALO, F.array(own, own + 1)).otherwise(F.array(own))
    each = pk.select("*", own.alias("_own"), F.explode(to).alias("_segment")).withColumn("_halo", F.col("_own") < F.col("_segment")).drop("_own")
    return _packed(each, "flow_id", "_segment").repartition("flow_id", "_segment").select("flow_id", "_segment", F.inline("_p"))


def _by(measure: str, share: float) -> str:
    return f"_{measure}_{round(1000 * share)}"


def _words(column: Column) -> set[str]:
    """The words of a column's text, names of columns among them."""
    return set(re.findall(r"\w+", str(column)))


def _ranks(name: str, shares: list[float]) -> list[str]:
    return [f"_{name}_q{k}" for k in range(len(shares))]


def _weight(before: Column, upto: Column, n: Column, share: float) -> Column:
    """What part of a quantile of n values a value is that has the ranks from before (the first is 0) to upto; it lies between two ranks by proportion."""
    place = F.lit(float(share)) * (n - 1)
    low = F.floor(place)
    over, inside = place - low, lambda rank: ((before <= rank) & (rank < upto)).cast("double")
    return inside(low) * (1 - over) + inside(F.least(low + 1, n - 1)) * over


def _ranked(rows: DataFrame, asked: dict[str, tuple[Column, list[float]]]) -> DataFrame:
    """A flow's quantiles of several values: equal values are counted before the shuffle, their counts summed up in order, ranks read from the sums."""
    each = rows.select("flow_id", F.explode(F.array(*[F.struct(F.lit(k).alias("which"), x.cast("double").alias("v")) for k, (x, _) in enumerate(asked.values())])).alias("x")).where("x.v IS NOT NULL")
    counts = each.groupBy("flow_id", F.col("x.which").alias("which"), F.col("x.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("flow_id", "which").orderBy("v")
    counts = counts.withColumns({"_upto": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    shares = sorted({share for _, s in asked.values() for share in s})
    counts = counts.select("flow_id", "which", *[(F.col("v") * _weight(F.col("_upto") - F.col("n"), F.col("_upto"), F.col("_all"), share)).alias(f"_{j}") for j, share in enumerate(shares)])
    return counts.groupBy("flow_id").agg(*[F.sum(F.when(F.col("which") == k, F.col(f"_{shares.index(share)}"))).alias(f"_{name}_q{j}") for k, (name, (_, s)) in enumerate(asked.items()) for j, share in enumerate(s)])


def _told(asked: dict[str, tuple[Column, list[float]]], lagged: dict[str, tuple[Column, ...]]) -> dict[str, str]:
    """By the names of the aggregates and quantiles of some values: the field of their statistics that tells the same."""
    found = {f"_{name}_{s}": f"{s}_{k}" for k, (name, (_, shares)) in enumerate(asked.items()) for s in (*MOMENTS, *(f"q{j}" for j in range(len(shares))))}
    return found | {f"_{name}_{s}": f"{s}_{len(asked) + k}" for k, (name, of) in enumerate(lagged.items()) for s in ("n", "s", "s2", *(f"{part}{j}" for j in range(1, len(of)) for part in PRODUCTS))}


def _array(asked: dict[str, tuple[Column, list[float]]], lagged: dict[str, tuple[Column, ...]]) -> Column:
    """A flow's values in an array."""
    every = [[x] for x, _ in asked.values()] + list(lagged.values())
    return F.collect_list(F.struct(*[x.cast("double").alias(f"v{k}_{j}") for k, of in enumerate(every) for j, x in enumerate(of)]))


@dataclass
class Gathered:
    """An array of values that a part has, and those of the names to take from its statistics."""

    part: int
    array: str
    asked: dict[str, tuple[Column, list[float]]]
    lagged: dict[str, tuple[Column, ...]]
    names: set[str]

    def told(self) -> dict[str, str]:
        return {name: field for name, field in _told(self.asked, self.lagged).items() if name in self.names}

    def statistics(self) -> Column:
        return statistics([shares for _, shares in self.asked.values()], [len(of) - 1 for of in self.lagged.values()])(self.array)


def _with_statistics(df: DataFrame, arrays: list[Gathered]) -> DataFrame:
    """df with what the statistics of its arrays tell, in place of them."""
    df = df.withColumns({f"_told{g.array}": g.statistics() for g in arrays}).drop(*[g.array for g in arrays])
    return df.select("*", *[F.col(f"_told{g.array}.{field}").alias(name) for g in arrays for name, field in g.told().items()]).drop(*[f"_told{g.array}" for g in arrays])


def table(pk: DataFrame, r: Recipe, together: bool = False) -> DataFrame:
    """A row for each flow of pk: flow_id and the recipe's output columns. Packets without a flow_id are left out.

    together: a window over flows has numbered pk, so that its exchange has dealt it out already; without it (or if that is wrong) there is one more.
    """
    rows = pk.where("flow_id IS NOT NULL")
    if not any(layer.ordered for layer in r.layers):
        rows = rows.withColumns(r.made) if r.made else rows
        for columns in (c for layer in r.layers for c in layer.columns if c):
            rows = rows.withColumns(columns)
        return _of_packets(rows, r)
    short, counts = min(SHORT, r.cfg.segment), rows.groupBy("flow_id").agg(F.count(F.lit(1)).alias("_n"))
    most = counts.agg(F.max("_n")).head()[0] or 0
    if most <= short:
        return _whole(rows, r, together, True)
    of_size = lambda low, high: rows.join(counts.where((F.col("_n") > low) & (F.col("_n") <= high)).select("flow_id"), "flow_id", "left_semi")
    parts = [_whole(rows.join(counts.where(F.col("_n") > short).select("flow_id"), "flow_id", "left_anti"), r, together, True)]
    if short < r.cfg.segment:
        parts.append(_whole(of_size(short, r.cfg.segment), r, together, False))
    if most > r.cfg.segment:
        parts.append(_segmented(of_size(r.cfg.segment, most), r))
    return reduce(DataFrame.unionByName, parts)


def _asked(rows: DataFrame, r: Recipe) -> DataFrame:
    rows = rows.withColumns(r.made) if r.made else rows
    return rows.select("flow_id", *r.needed(rows.columns))


def _whole(rows: DataFrame, r: Recipe, together: bool, short: bool) -> DataFrame:
    rows = _dealt_whole(_asked(rows, r), together)
    for layer in r.layers:
        rows = _scanned_whole(rows, layer)
    return _of_packets(rows, r, short)


def _segmented(rows: DataFrame, r: Recipe) -> DataFrame:
    rows = _dealt(_asked(rows, r), r.cfg.segment)
    for layer in r.layers:
        rows = _scanned(rows, layer)
    return _of_packets(rows.where(~F.col("_halo")), r)


def _of_packets(rows: DataFrame, r: Recipe, short: bool = False) -> DataFrame:
    """The recipe's outputs of packets with all of their columns. short: a flow's values fit into an array."""
    grouped = lambda of, aggregates: of.groupBy("flow_id").agg(*[a.alias(name) for name, a in aggregates.items()])
    arrays = []
    if short and (r.ranked or r.lagged):
        told, names = _told(r.ranked, r.lagged), {q for name, (_, shares) in r.ranked.items() for q in _ranks(name, shares)} | set(r.aggregates)
        parts = [grouped(rows, {name: a for name, a in r.aggregates.items() if name not in told} or {"_any": F.first(F.lit(1))})]
        parts.append(grouped(rows, r.gathers | {"_values": _array(r.ranked, r.lagged)}))
        arrays.append(Gathered(1, "_values", r.ranked, r.lagged, names))
    else:
        parts = [grouped(rows, r.aggregates or {"_any": F.first(F.lit(1))})]
        if r.gathers:
            parts.append(grouped(rows, r.gathers))
        if ranked := {name: of for name, of in r.ranked.items() if of[1]}:
            parts.append(_ranked(rows, ranked))
    if r.cells:
        measures = list(dict.fromkeys(m for _, sums in r.cells.values() for m in sums))
        part = lambda grain, key, sums: F.struct(F.lit(grain).alias("grain"), key.cast("long").alias("key"), *[sums.get(m, F.lit(None)).cast("long").alias(m) for m in measures])
        each = rows.select("flow_id", F.explode(F.array(*[part(name[0], key, sums) for name, (key, sums) in r.cells.items()])).alias("c")).where("c.key IS NOT NULL")
        cells = each.groupBy("flow_id", F.col("c.grain").alias("grain"), F.col("c.key").alias("key")).agg(*[F.sum(f"c.{m}").alias(m) for m in measures])
        if short and r.cell_ranked:
            arrays.append(Gathered(len(parts), "_cell_values", r.cell_ranked, {}, set(r.cell_aggregates)))
        parts += _of_short_cells(cells, r) if short else _of_cells(cells, r)
    return _finished(parts, r, arrays)


def _of_cells(cells: DataFrame, r: Recipe) -> list[DataFrame]:
    grouped = lambda of, aggregates: of.groupBy("flow_id").agg(*[a.alias(name) for name, a in aggregates.items()])
    parts = []
    if r.cell_aggregates:
        of_grain, weighed = Window.partitionBy("flow_id", "grain"), cells
        for by in sorted({by for by, _ in r.cell_orders}):
            weighed = weighed.withColumns({f"_at_{by}": F.row_number().over(of_grain.orderBy(by)), "_cells": F.count(F.lit(1)).over(of_grain)})
        weighed = weighed.withColumns({_by(by, share): _weight(F.col(f"_at_{by}") - 1, F.col(f"_at_{by}"), F.col("_cells"), share) for by, share in sorted(r.cell_orders)}) if r.cell_orders else cells
        parts.append(grouped(weighed, r.cell_aggregates))
    if r.cell_gathers:
        parts.append(grouped(cells, r.cell_gathers))
    return parts


def _of_short_cells(cells: DataFrame, r: Recipe) -> list[DataFrame]:
    """The same of short flows, whose cells are few: all in one group by flow, with an array for what statistics tell."""
    told = _told(r.cell_ranked, {})
    aggregates = {name: a for name, a in r.cell_aggregates.items() if name not in told} | r.cell_gathers | ({"_cell_values": _array(r.cell_ranked, {})} if r.cell_ranked else {})
    return [cells.groupBy("flow_id").agg(*[a.alias(name) for name, a in aggregates.items()])] if aggregates else []


def _finished(parts: list[DataFrame], r: Recipe, arrays: list[Gathered] = []) -> DataFrame:
    """The parts side by side. What needs the columns of one part is computed there, so that joins and vectorised functions see narrow rows; but what
    needs a part with an array is computed last, since rows that have been through a vectorised function would have to be dealt out again.
    """
    known = {name for part in parts for name in part.columns}.union(*(g.told() for g in arrays)) - {"flow_id"}
    words_of = lambda column: _words(column) & known
    late, waiting = {}, [{} for _ in parts]
    late_parts = {g.part for g in arrays}
    columns = [set() if k in late_parts else set(part.columns) for k, part in enumerate(parts)]

    def settle(k: int) -> None:
        parts[k] = parts[k].withColumns(waiting[k]) if waiting[k] else parts[k]
        waiting[k] = {}

    for name, column in r.afters.items():
        need = words_of(column)
        k = next((k for k, have in enumerate(columns) if need <= have), None)
        known.add(name)
        if k is None:
            late[name] = column
            continue
        if need & set(waiting[k]):
            settle(k)
        waiting[k][name] = column
        columns[k].add(name)
    for k in range(len(parts)):
        settle(k)
    needs = {name: words_of(column) for name, column in r.outputs.items()}
    homes = {name: None if need & set(late) else next((k for k, have in enumerate(columns) if need <= have), None) for name, need in needs.items()}
    shared = set().union(*(need for name, need in needs.items() if homes[name] is None), *map(words_of, late.values())) | {g.array for g in arrays}
    out = None
    for k, part in enumerate(parts):
        done = [r.outputs[name].alias(name) for name, at in homes.items() if at == k]
        done = [F.array(F.struct(*done)).alias(f"_done{k}")] if done and late_parts else done  # in one column, so that what is still to come handles few
        mine = part.select("flow_id", *[c for c in part.columns if c in shared], *done)
        out = mine if out is None else out.join(mine, "flow_id", "left")
    out = _with_statistics(out, arrays) if arrays else out
    while late:
        ready = {name: column for name, column in late.items() if not words_of(column) & set(late)}
        out = out.withColumns(ready)
        late = {name: column for name, column in late.items() if name not in ready}
    place = lambda name, k: F.get(f"_done{k}", F.lit(0))[name] if late_parts else F.col(name)
    return out.select("flow_id", *[(c if homes[name] is None else place(name, homes[name])).alias(name) for name, c in r.outputs.items()])


def feature_group(ask: Callable[[Recipe], None]) -> Callable[[DataFrame, FlowConfig], DataFrame]:
    """A group by itself: a table of packets to a table of flows. Its ask puts it into a recipe with others."""

    @wraps(ask)
    def alone(pk: DataFrame, cfg: FlowConfig) -> DataFrame:
        r = Recipe(cfg, pk.columns)
        ask(r)
        return table(pk, r)

    alone.ask = ask
    return alone
