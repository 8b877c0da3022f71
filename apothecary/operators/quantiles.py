"""Exact quantiles without a sort of all values in one task."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which one round cuts an interval, and the accuracy of the cuts.
GRID, ACCURACY = 256, 4096


@dataclass
class _Search:
    """The value of one rank: the open interval that holds it, its rank there and the number of values inside."""

    name: str
    rank: int
    inside: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def narrow(self, low: float, high: float, counts: tuple[int, int, int, int]) -> None:
        """Go on in the part that holds the rank, given the numbers of values below ``low``, equal to it, between, and equal to ``high``."""
        below, at_low, between, at_high = counts
        for number, value, ends in ((below, None, (self.low, low)), (at_low, low, None), (between, None, (low, high)), (at_high, high, None), (self.inside - below - at_low - between - at_high, None, (high, self.high))):
            if self.rank < number:
                if ends is None:
                    self.value = value
                else:
                    (self.low, self.high), self.inside = ends, number
                return
            self.rank -= number
        raise AssertionError("the rank lies beyond the values")


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str | Column, float]], by: tuple[str, ...] = (), bound: int = 65_536, most_groups: int = 10_000) -> DataFrame:
    """One row a group (one in all without ``by``): its key and each quantile asked for, as double.

    ``wanted`` gives, by name of the result, a numeric column and a share from
    0 to 1; between two values a quantile is interpolated linearly. Nulls take
    no part; a group without values has null; NaN is greatest. A null key is a
    group. Without ``by`` an empty table gives one row of nulls, with it none.

    An interval around each rank is narrowed in rounds. A round asks for
    approximate cuts of the interval and then counts exactly on either side of
    two of them, both with partial sums in every task, so a group that holds
    most rows is no heavier than others. Wrong cuts cost a round, never the
    result. At most ``bound`` values of an interval are sorted in one task in
    the end. Intervals are held on the driver, a few numbers a group: more
    than ``most_groups`` groups are refused.
    """
    columns = {name: (F.col(column) if isinstance(column, str) else column).cast("double") for name, (column, _) in wanted.items()}
    keys = {f"_k{i}": F.col(c) for i, c in enumerate(by)} or {"_k0": F.lit(0)}
    values = df.select(*[c.alias(k) for k, c in keys.items()], *[c.alias(f"_v{i}") for i, c in enumerate(columns.values())])
    value_of = {name: f"_v{i}" for i, name in enumerate(columns)}
    found = values.groupBy(*keys).agg(*[F.count(v).alias(n) for n, v in value_of.items()]).limit(most_groups + 1).collect()
    if len(found) > most_groups:
        raise ValueError(f"over {most_groups} groups")
    groups = {tuple(row[k] for k in keys): row for row in found}
    searches: dict[tuple, dict[tuple[str, int], _Search]] = {}
    for key, row in groups.items():
        slots = searches[key] = {}
        for name, (_, share) in wanted.items():
            if row[name]:
                place = share * (row[name] - 1)
                for rank in {math.floor(place), math.ceil(place)}:
                    slots[name, rank - math.floor(place)] = _Search(name, rank, row[name])
    slots = [(name, side) for name in wanted for side in (0, 1)]
    schema = ", ".join([f"{k} {values.schema[k].dataType.simpleString()}" for k in keys] + [f"_{p}{i} double" for i in range(len(slots)) for p in ("low", "high")] + [f"_open{i} boolean" for i in range(len(slots))])

    def beside(more: dict[tuple, list], names: list[str]) -> DataFrame:
        """The values beside the intervals and ``more`` of their group; groups are few, see ``most_groups``."""
        rows = []
        for key, found in searches.items():
            states = [found.get(s) for s in slots]
            ends = [e for s in states for e in ((s.low, s.high) if s else (None, None))]
            rows.append((*key, *ends, *[bool(s and s.value is None) for s in states], *more.get(key, [None] * len(names))))
        table = values.sparkSession.createDataFrame(rows, schema + "".join(f", {n} double" for n in names))
        here = F.broadcast(table.withColumnsRenamed({k: f"_of{k}" for k in keys}))
        on = [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys]
        return values.join(here, on)

    def inside(i: int) -> Column:
        v, low, high = F.col(value_of[slots[i][0]]), F.col(f"_low{i}"), F.col(f"_high{i}")
        return F.when(F.col(f"_open{i}") & (low.isNull() | (v > low)) & (high.isNull() | (v < high)), v)

    def open_searches(least: int) -> list[tuple[tuple, int, _Search]]:
        return [(key, i, found[s]) for key, found in searches.items() for i, s in enumerate(slots) if s in found and found[s].value is None and found[s].inside > least]

    def by_key(rows: DataFrame, aggregates: list[Column]) -> dict[tuple, tuple]:
        return {tuple(r[k] for k in keys): tuple(r)[len(keys) :] for r in rows.groupBy(*keys).agg(*aggregates).collect()}

    while wide := open_searches(bound):
        used = sorted({i for _, i, _ in wide})
        shares = [k / GRID for k in range(GRID + 1)]
        grids = by_key(beside({}, []), [F.percentile_approx(inside(i), shares, ACCURACY) for i in used])
        cuts: dict[tuple, list] = {key: [None] * (2 * len(used)) for key in searches}
        for key, i, search in wide:
            grid, at = grids[key][used.index(i)], search.rank * GRID // search.inside
            cuts[key][2 * used.index(i) : 2 * used.index(i) + 2] = grid[max(0, at - 1)], grid[min(GRID, at + 2)]
        counted = beside(cuts, [f"_{p}{i}" for i in used for p in ("from", "to")])
        sums = []
        for i in used:
            x, low, high = inside(i), F.col(f"_from{i}"), F.col(f"_to{i}")
            sums += [F.count_if(x < low), F.count_if(x == low), F.count_if((x > low) & (x < high)), F.count_if((x == high) & (low != high))]
        totals = by_key(counted, sums)
        for key, i, search in wide:
            at = used.index(i)
            search.narrow(*cuts[key][2 * at : 2 * at + 2], totals[key][4 * at : 4 * at + 4])
    if left := open_searches(0):
        used = sorted({i for _, i, _ in left})
        sorted_values = by_key(
            beside({k: [float(s[x].rank) if (x := slots[i]) in s and s[x].value is None else None for i in used] for k, s in searches.items()}, [f"_rank{i}" for i in used]),
            [F.get(F.sort_array(F.collect_list(inside(i))), F.first(f"_rank{i}").cast("int")) for i in used],
        )
        for key, i, search in left:
            search.value = sorted_values[key][used.index(i)]
    out = []
    for key, found in searches.items():
        row = []
        for name, (_, share) in wanted.items():
            if (name, 0) not in found:
                row.append(None)
                continue
            low = found[name, 0].value
            high = found[name, 1].value if (name, 1) in found else low
            place = share * (groups[key][name] - 1)
            row.append(low if low == high else low + (high - low) * (place - math.floor(place)))
        out.append((*(key if by else ()), *row))
    types = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]
    if not by and not out:
        out = [(None,) * len(wanted)]
    return df.sparkSession.createDataFrame(out, ", ".join(types + [f"`{n}` double" for n in wanted])).coalesce(1)
