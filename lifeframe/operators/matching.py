"""Case-control matching: 1:N, without replacement, greedy in case order, controls drawn at random.

How it stays parallel and never lists person pairs
--------------------------------------------------
Eligibility depends on few attributes only, so persons are grouped into cells of equal attributes and
the range join runs between cells. The number of cells is bounded by the attributes' domains, not by
the number of persons.

Persons lie on a circle, at a point that a digest of the seed and their id gives. A case draws the first eligible controls clockwise from
its own point, so over seeds every control is as likely, and a second engine that knows the digest draws the same.

Greedy selection in case order with fixed rankings equals deferred acceptance in which every control prefers the earlier case, whatever the
order of the proposals. Case cells are cut into blocks by equal attributes and days of birth; a block works on all controls that are eligible for
its cells. One task goes through the cases of a block in case order: the controls of a cell are a circle sorted by point, those that
an earlier case holds are skipped by pointers that shorten as they are used, so a case costs about a look per eligible cell and draw, however many
controls are taken. Who loses a control to an earlier case of the block has its turn later in the same pass. Controls at the edge of blocks may be
claimed by several; the earliest case keeps such a control, the others go on in the next round, from which only blocks with such cases remain.
A control that refused a case is held by an earlier one for good, so nothing is looked at again.

A block of very many rows is cut into sectors of the circle as well. A case goes through them clockwise, one a round, beginning and ending in that of
its point, until it has enough. So what a task holds is bounded, whatever the data; one cell of very many persons takes more rounds.

A case that wants as many controls as are eligible for it leaves none of them to later cases, so these don't look into cells that such
cases have emptied.

Joins are sorted, not broadcast: the files between rounds are compressed, and a cell stands for many pairs, so estimates say little.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left
from dataclasses import dataclass
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifeframe.operators.asof import as_of
from lifeframe.session import materialize

_ANY = "*"
_CIRCLE_BITS = 32
_UNIT = 200_000  # cases and controls that one task holds, about; twice as many at most
_EDGES = 1_600_000  # pairs of cells that one task holds, about
_HALO = 4  # windows in the days of birth of a block, at least
_FEW = 1000  # units that may be broadcast
_UNITS = 4096  # tasks of a round, at most
_BLOCK_BITS, _SECTOR_BITS = 40, 20  # of a unit's number; blocks of like hash are one
_NEVER = (1 << 63) - 1


@dataclass(frozen=True)
class MatchingCriteria:
    """Who may be matched. A null case value accepts every control; a null control value fits only that."""

    birth_window_days: int = 30
    same_gender: bool = True
    match_family_size: bool = True
    family_size_tolerance: int = 1
    match_parent_age: bool = False
    parent_birth_window_days: int = 365
    require_both_parents: bool = False
    match_education: bool = False
    match_geography: bool = False
    match_parental_status: bool = False
    match_immigrant_background: bool = False

    @property
    def equal_columns(self) -> tuple[str, ...]:
        """Columns whose values must agree."""
        switched = (
            (self.same_gender, "gender"),
            (self.match_education, "education_level"),
            (self.match_geography, "municipality_code"),
            (self.match_parental_status, "parental_status"),
            (self.match_immigrant_background, "immigration_type"),
        )
        return tuple(name for on, name in switched if on)

    @property
    def near_columns(self) -> tuple[tuple[str, int], ...]:
        """Columns with the largest allowed difference."""
        near = [("children_count", self.family_size_tolerance)] if self.match_family_size else []
        if self.match_parent_age:
            near += [(c, self.parent_birth_window_days) for c in ("mother_birth_date", "father_birth_date")]
        return tuple(near)

    @property
    def columns(self) -> tuple[str, ...]:
        return ("birth_date", *self.equal_columns, *(name for name, _ in self.near_columns))


@dataclass(frozen=True)
class MatchingConfig:
    criteria: MatchingCriteria = MatchingCriteria()
    ratio: int = 1
    seed: int = 0
    matching_date: dt.date | None = None
    case_order: tuple[str, ...] = ("pnr",)


@dataclass(frozen=True)
class MatchingResult:
    """``pairs`` holds case, control, both birth dates and the matching date; the others one row per matched person."""

    pairs: DataFrame
    matched_cases: DataFrame
    matched_controls: DataFrame
    rounds: int


def canonical(df: DataFrame) -> DataFrame:
    """Register names to canonical matching names, where they are used."""
    return df.withColumnsRenamed(
        {"PNR": "pnr", "FOED_DAG": "birth_date", "KOEN": "gender", "ANTAL_BOERN": "children_count"}
    )


def prepare(df: DataFrame, criteria: MatchingCriteria, side: str) -> DataFrame:
    """Check the required columns; drop rows without id or birth date (or without both parents when required).

    Family size is optional input: where absent it is unknown.
    """
    df = canonical(df)
    required = {"pnr", *criteria.columns} - {"children_count"}
    if criteria.require_both_parents:
        required |= {"mother_pnr", "father_pnr"}
    absent = sorted(required - set(df.columns))
    if absent:
        raise ValueError(f"{side}: required columns missing: {absent}")
    if criteria.match_family_size and "children_count" not in df.columns:
        df = df.withColumn("children_count", F.lit(None).cast("int"))
    df = df.filter(F.col("pnr").isNotNull() & F.col("birth_date").isNotNull())
    if criteria.require_both_parents:
        df = df.filter(F.col("mother_pnr").isNotNull() & F.col("father_pnr").isNotNull())
    return df


def _one_row_each(persons: DataFrame) -> DataFrame:
    """One row per person; of several the smallest, whatever order they were read in."""
    others = [c for c in persons.columns if c != "pnr"]
    return persons.groupBy("pnr").agg(F.min(F.struct(*others)).alias("_row")).select("pnr", "_row.*")


def cell_key(criteria: MatchingCriteria) -> Column:
    """Identity of a cell: all attributes eligibility depends on."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in criteria.columns]
    return F.md5(F.concat_ws("\x01", *parts))


def cells(persons: DataFrame, criteria: MatchingCriteria) -> DataFrame:
    """Distinct cells with their attributes and number of persons."""
    return persons.groupBy(*criteria.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("cell", cell_key(criteria))


def _sorted(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that Spark must not broadcast."""
    return df.hint("merge")


def _bucket(column: str, width: int) -> Column:
    return F.floor(F.unix_date(column) / max(1, width)).cast("long")


def _open_columns(case_cells: DataFrame, names: list[str]) -> dict[str, bool]:
    """Whether some case lacks the value, and therefore accepts any."""
    found = case_cells.agg(*(F.max(F.col(c).isNull()).alias(c) for c in names)).first() if names else None
    return {c: bool(found[c]) for c in names} if found else {}


def _windows(criteria: MatchingCriteria) -> dict[str, int]:
    windows = {"birth_date": criteria.birth_window_days}
    return windows | {name: tolerance for name, tolerance in criteria.near_columns if name.endswith("_date")}


def _equal_keys(df: DataFrame, criteria: MatchingCriteria, open_: dict[str, bool] | None) -> DataFrame:
    """``_key_<column>`` for the columns that must agree. A case (``open_`` not given) without a value looks under a wildcard, under which
    controls are listed as well for those columns in which some case has none."""
    for c in criteria.equal_columns:
        value = F.col(c).cast("string")
        if open_ is None:
            df = df.withColumn(f"_key_{c}", F.coalesce(value, F.lit(_ANY)))
        else:
            df = df.withColumn(f"_key_{c}", F.explode(F.array_compact(F.array(F.lit(_ANY), value) if open_[c] else F.array(value))))
    return df


def leading_window(case_cells: DataFrame, control_cells: DataFrame, criteria: MatchingCriteria) -> str:
    """The date window whose buckets leave the fewest pairs to look at, by the cells counted per bucket.

    One row per bucket of a window is joined with the three that it meets; a case without the date meets all controls.
    """
    windows = _windows(criteria)
    if len(windows) == 1:
        return "birth_date"
    total = control_cells.count()
    costs = None
    for c, width in windows.items():
        case = case_cells.groupBy(_bucket(c, width).alias("b")).agg(F.count(F.lit(1)).alias("cases"))
        control = control_cells.groupBy(_bucket(c, width).alias("b")).agg(F.count(F.lit(1)).alias("controls"))
        met = case.filter("b is not null").withColumn("b", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1))).join(control, "b")
        cost = met.selectExpr("cases * controls as pairs").unionByName(case.filter("b is null").selectExpr(f"cases * {total}L as pairs"))
        one = cost.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).withColumn("window", F.lit(c))
        costs = one if costs is None else costs.unionByName(one)
    return min(costs.collect(), key=lambda r: (r.pairs, r.window))["window"]


def eligible_cells(case_cells: DataFrame, control_cells: DataFrame, criteria: MatchingCriteria) -> DataFrame:
    """Pairs of case cell and eligible control cell, ``case_*`` and ``control_*`` columns.

    Of the date windows (birth, and the parents' births where wanted) the most selective one becomes an equi-join on window-wide buckets: each
    case cell looks into its own bucket and the two beside it. The others are compared in the join, so a cell has at most three keys. Equal values and
    parents' dates may be unknown for a case, which then accepts any.
    """
    leading = leading_window(case_cells, control_cells, criteria)
    width = _windows(criteria)[leading]
    open_ = _open_columns(case_cells, [*criteria.equal_columns, leading])
    left, right = _equal_keys(case_cells, criteria, None), _equal_keys(control_cells, criteria, open_)
    own = _bucket(leading, width)
    near_by = F.transform(F.sequence(own - 1, own + 1), lambda b: b.cast("string"))
    left = left.withColumn("_key_window", F.explode(F.coalesce(near_by, F.array(F.lit(_ANY)))))
    listed = F.array(F.lit(_ANY), own.cast("string")) if open_[leading] else F.array(own.cast("string"))
    right = right.withColumn("_key_window", F.explode(F.array_compact(listed)))
    keys = ["_key_window", *(f"_key_{c}" for c in criteria.equal_columns)]
    left = left.select(*keys, *(F.col(c).alias(f"case_{c}") for c in case_cells.columns))
    right = right.select(*keys, *(F.col(c).alias(f"control_{c}") for c in control_cells.columns))
    near = F.abs(F.datediff("case_birth_date", "control_birth_date")) <= criteria.birth_window_days
    for name, tolerance in criteria.near_columns:
        mine, theirs = F.col(f"case_{name}"), F.col(f"control_{name}")
        distance = F.datediff(mine, theirs) if name.endswith("_date") else mine - theirs
        near = near & F.coalesce(mine.isNull() | (F.abs(distance) <= tolerance), F.lit(False))
    return left.join(_sorted(right), keys).filter(near).drop(*keys)


def cell_totals(case_cells: DataFrame, control_cells: DataFrame, criteria: MatchingCriteria) -> DataFrame:
    """(cell, _total): the number of controls eligible for each case cell, without pairs of cells.

    Controls of equal attributes and family size are summed up along their days of birth. A case's count within its window is the sum up to the window's
    end less the sum up to the day before it begins, for each family size within the tolerance: two as-of lookups each.
    """
    sized = criteria.match_family_size
    open_ = _open_columns(case_cells, [*criteria.equal_columns, *(["children_count"] if sized else [])])
    left, right = _equal_keys(case_cells, criteria, None), _equal_keys(control_cells, criteria, open_)
    if sized:
        size, t = F.col("children_count"), criteria.family_size_tolerance
        sizes = F.transform(F.sequence(size - t, size + t), lambda n: n.cast("string"))
        left = left.withColumn("_key_size", F.explode(F.coalesce(sizes, F.array(F.lit(_ANY)))))
        listed = F.array(F.lit(_ANY), size.cast("string")) if open_["children_count"] else F.array(size.cast("string"))
        right = right.withColumn("_key_size", F.explode(F.array_compact(listed)))
    keys = [*(f"_key_{c}" for c in criteria.equal_columns), *(["_key_size"] if sized else [])]
    group = F.md5(F.concat_ws("\x01", F.lit(""), *keys)).alias("group")
    per_day = right.groupBy(group, F.col("birth_date").alias("day")).agg(F.sum("n").alias("n"))
    # One row per group and day of birth.
    upto = per_day.withColumn("upto", F.sum("n").over(Window.partitionBy("group").orderBy("day"))).select("group", "day", "upto")
    window = criteria.birth_window_days
    asked = left.select("cell", group, F.date_add("birth_date", window).alias("last"), F.date_sub("birth_date", window + 1).alias("before"))
    both = as_of(as_of(asked, upto, "group", "last", "day", ["upto"], "_high"), upto, "group", "before", "day", ["upto"], "_low")
    within = F.coalesce("_high.upto", F.lit(0)) - F.coalesce("_low.upto", F.lit(0))
    return both.groupBy("cell").agg(F.sum(within).alias("_total"))


def eligible_counts(cases: DataFrame, controls: DataFrame, criteria: MatchingCriteria | None = None) -> DataFrame:
    """Per case the number of eligible controls, itself excluded: ``pnr, eligible``.

    Windows on the parents' births are counted over pairs of cells, all other criteria by running sums.
    """
    criteria = criteria or MatchingCriteria()
    cases, controls = prepare(cases, criteria, "cases"), prepare(controls, criteria, "controls")
    case_cells, control_cells = cells(cases, criteria), cells(controls, criteria)
    if criteria.match_parent_age:
        pairs = eligible_cells(case_cells, control_cells, criteria)
        totals = pairs.groupBy(F.col("case_cell").alias("cell")).agg(F.sum("control_n").alias("_total"))
    else:
        totals = cell_totals(case_cells, control_cells, criteria)
    own = _own_control(cases, controls, criteria)
    counted = (
        cases.select("pnr", cell_key(criteria).alias("cell")).join(totals, "cell", "left").join(own, "pnr", "left")
    )
    return counted.select("pnr", (F.coalesce("_total", F.lit(0)) - F.coalesce("_own", F.lit(0))).alias("eligible"))


def _own_control(cases: DataFrame, controls: DataFrame, criteria: MatchingCriteria) -> DataFrame:
    """Cases that are also among the controls: ``pnr, _own``. A person always fits its own attributes."""
    shared = ["pnr", *criteria.columns]
    both = cases.select(*shared).join(controls.select("pnr", *(F.col(c).alias(f"_c_{c}") for c in criteria.columns)), "pnr")
    fits = F.abs(F.datediff("birth_date", "_c_birth_date")) <= criteria.birth_window_days
    for c in criteria.equal_columns:
        fits = fits & F.coalesce(F.col(c).isNull() | (F.col(c) == F.col(f"_c_{c}")), F.lit(False))
    for c, tolerance in criteria.near_columns:
        gap = F.datediff(F.col(c), F.col(f"_c_{c}")) if c.endswith("_date") else F.col(c) - F.col(f"_c_{c}")
        fits = fits & F.coalesce(F.col(c).isNull() | (F.abs(gap) <= tolerance), F.lit(False))
    return both.filter(fits).groupBy("pnr").agg(F.count(F.lit(1)).alias("_own"))


def _ordered_cases(cases: DataFrame, config: MatchingConfig) -> DataFrame:
    """Cases with ``ord``, a number that grows in case order: ids of a globally sorted frame."""
    keyed = cases.select("pnr", cell_key(config.criteria).alias("case_cell"), *(
        F.col(c).alias(f"_order_{i}") for i, c in enumerate(config.case_order)
    ))
    order = [f"_order_{i}" for i in range(len(config.case_order))]
    ranked = keyed.orderBy(*order, "pnr").withColumn("ord", F.monotonically_increasing_id())
    return materialize(ranked.select("ord", F.col("pnr").alias("case_pnr"), "case_cell"), "match-order")


def point_of(seed: int, pnr: Column) -> Column:
    """A person's point on the circle: 32 bits of a digest of seed and id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), pnr)), 1, 8), 16, 10).cast("long")


def _edges(cases: DataFrame, controls: DataFrame, ordered: DataFrame, config: MatchingConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges ``case_cell, cell, n``; ``cell, id, n, birth_date`` and equal columns of the case cells; ``cell, id`` of the control cells), all written once.

    Edges are the eligible control cells of each case cell by their numbers, with their controls.

    A case whose eligible controls are no more than the ratio leaves only itself behind, if it is among them, and a second such case nothing at all.
    So cases after ``last``, the ``ord`` of some second such case of a control cell, find nothing there, and cells that only they would look at are left
    out. Cases are halved by a hash, and the later one of the first of both halves is taken. Pairs of cells are combined where they are joined.
    """
    criteria = config.criteria
    number = F.monotonically_increasing_id()
    case_cells, control_cells = (materialize(cells(side, criteria).withColumn("id", number), "match-cells") for side in (cases, controls))
    pools = eligible_cells(case_cells, control_cells, criteria).groupBy(F.col("case_cell").alias("cell")).agg(F.sum("control_n").alias("pool"))
    half = F.xxhash64("ord") % 2 == 0
    firsts = ordered.groupBy(F.col("case_cell").alias("cell")).agg(
        F.min("ord").alias("first"), F.min(F.when(half, F.col("ord"))).alias("first_0"), F.min(F.when(~half, F.col("ord"))).alias("first_1")
    )
    case_cells = materialize(case_cells.join(_sorted(pools), "cell").join(_sorted(firsts), "cell"), "match-cells")
    taking_all = eligible_cells(case_cells.filter(F.col("pool") <= config.ratio), control_cells, criteria)
    emptied = taking_all.groupBy(F.col("control_cell").alias("cell")).agg(F.min("case_first_0").alias("_0"), F.min("case_first_1").alias("_1"))
    last = F.when(F.col("_0").isNotNull() & F.col("_1").isNotNull(), F.greatest("_0", "_1")).otherwise(F.lit(_NEVER))
    control_cells = materialize(control_cells.join(_sorted(emptied), "cell", "left").withColumn("last", last).drop("_0", "_1"), "match-cells")
    pairs = eligible_cells(case_cells, control_cells, criteria).filter("case_first <= control_last")
    edges = pairs.selectExpr("case_id as case_cell", "control_id as cell", "control_n as n")
    kept = dict.fromkeys(("cell", "id", "n", "birth_date", *criteria.equal_columns))
    return materialize(edges, "match-edges"), case_cells.select(*kept), control_cells.select("cell", "id")


def _blocks(case_cells: DataFrame, criteria: MatchingCriteria, wanted: int) -> DataFrame:
    """``case_cells`` with ``block``: about ``wanted`` blocks by equal attributes and by stretches of days of birth, which are long beside the window, as
    controls within a window of a block belong to it as well."""
    if wanted <= 1:
        return case_cells.withColumn("block", F.lit(0).cast("long"))
    group, day = F.xxhash64(F.lit(0), *(F.col(c).cast("string") for c in criteria.equal_columns)), F.unix_date("birth_date")
    told = case_cells.agg(F.count_distinct(group).alias("groups"), F.min(day).alias("first"), F.max(day).alias("last")).first()
    first, last, groups = told["first"] or 0, told["last"] or 0, max(1, min(told["groups"], wanted))
    days = max((last - first) // -(-wanted // groups) + 1, _HALO * (2 * criteria.birth_window_days + 1))
    group = F.pmod(group, F.lit(wanted)) if told["groups"] > wanted else group
    return case_cells.withColumn("block", _block_number(group, F.floor((day - first) / days).cast("long")))


def _block_number(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1))


def _thinned(case_cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks of very many pairs of cells are dealt over several that share controls."""
    counted = edges.withColumnRenamed("case_cell", "id").join(_sorted(case_cells.select("id", "block")), "id").groupBy("block").agg(F.count(F.lit(1)).alias("pairs"))
    parts = counted.select("block", F.ceil(F.col("pairs") / _EDGES).alias("parts"))
    part = F.when(F.col("parts") > 1, _block_number(F.col("block"), F.pmod(F.xxhash64("id"), F.col("parts")))).otherwise(F.col("block"))
    return case_cells.join(_sorted(parts), "block").withColumn("block", part).drop("parts")


_WHOLE, _FROM, _ALL, _BEFORE = range(4)  # what a case looks at in a sector: its circle round, from its point on, everything, up to its point
_DRAWN = "control long, ord long, passed boolean"


def _pass():
    """One pass over a unit, in case order. Rows of kind 0 are cases (``id`` their ord, ``n`` what they need, ``own`` the control they are themselves), of
    kind 1 controls (``n`` the ord of who holds them), of kind 2 the eligible ``cells`` of a case cell. Gives the claims, and cases that found too few."""
    mask, free = (1 << _CIRCLE_BITS) - 1, _NEVER
    whole, from_, before = _WHOLE, _FROM, _BEFORE

    def run(unit: pa.Table) -> pa.Table:
        columns = {c: unit[c].combine_chunks() for c in ("kind", "cell", "id", "point", "n", "own", "look", "cells")}
        kind = columns["kind"].to_numpy(zero_copy_only=False)

        def of(which: int, column: str, missing: int = -1) -> np.ndarray:
            return columns[column].take(pa.array(np.flatnonzero(kind == which))).fill_null(missing).to_numpy(zero_copy_only=False)

        cell, point, ids, held = (of(1, c, m) for c, m in (("cell", -1), ("point", -1), ("id", -1), ("n", free)))
        order = np.lexsort((ids, point, cell))
        cell, point, ids, held = cell[order], point[order], ids[order], held[order]
        # Slots: the controls of each cell clockwise, then one that ends the cell.
        names, starts, counts = np.unique(cell, return_index=True, return_counts=True)
        slot = np.arange(len(cell)) + np.repeat(np.arange(len(names)), counts)
        base = starts + np.arange(len(names))
        spans = dict(zip(names.tolist(), zip(base.tolist(), (base + counts).tolist())))

        def slots(values: np.ndarray, end: int) -> list[int]:
            out = np.full(len(values) + len(names), end, np.int64)
            out[slot] = values
            return out.tolist()

        points, control, holder = slots(point, 0), slots(ids, -1), slots(held, free)
        after = list(range(len(points)))  # itself where a control may be willing, else a slot behind it

        def willing(s: int) -> int:
            while after[s] != s:
                after[s] = after[after[s]]
                s = after[s]
            return s

        taken = np.flatnonzero(held != free)
        taken = taken[np.argsort(held[taken], kind="stable")]
        closing, by = slot[taken].tolist(), held[taken].tolist()
        lists = dict(zip(of(2, "cell").tolist(), np.flatnonzero(kind == 2).tolist()))
        cases = {o: x for o, *x in zip(*(of(0, c).tolist() for c in ("id", "cell", "point", "n", "own", "look")))}
        near: dict[int, list[tuple[int, int]]] = {}
        waiting = [o for o, x in cases.items() if x[2] > 0]
        heapify(waiting)
        claims, claimants, passed, closed = [], [], [], 0
        while waiting:
            turn = heappop(waiting)
            at, p, need, own, look = cases[turn]
            # Later turns are later cases, so who holds a control now keeps it from all of them.
            while closed < len(by) and by[closed] <= turn:
                if after[closing[closed]] == closing[closed]:
                    after[closing[closed]] += 1
                closed += 1
            if at not in near:
                near[at] = [spans[c] for c in columns["cells"][lists[at]].as_py() if c in spans] if at in lists else []

            def following(s: int, first: int, end: int) -> int:
                s = willing(s)
                if control[s] == own and s != end:
                    s = willing(s + 1)
                if look == whole:
                    if s != end:
                        return s
                    s = willing(first)
                    return s if s != end and points[s] < p else -1
                return -1 if s == end or look == before and points[s] >= p else s

            found = []
            for first, end in near[at]:
                s = following(bisect_left(points, p, first, end) if look in (whole, from_) else first, first, end)
                if s >= 0:
                    found.append(((points[s] - p) & mask, control[s], s, first, end))
            heapify(found)
            while need and found:
                _, name, s, first, end = found[0]
                loser, holder[s], after[s] = holder[s], turn, s + 1
                need -= 1
                claims.append(name)
                claimants.append(turn)
                if loser in cases:
                    if cases[loser][2] == 0:
                        heappush(waiting, loser)
                    cases[loser][2] += 1
                s = following(s, first, end)
                if s >= 0:
                    heapreplace(found, ((points[s] - p) & mask, control[s], s, first, end))
                else:
                    heappop(found)
            if need:
                passed.append(turn)
        schema = pa.schema([("control", pa.int64()), ("ord", pa.int64()), ("passed", pa.bool_())])
        rows = [claims + [None] * len(passed), claimants + passed, [False] * len(claims) + [True] * len(passed)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)

    return run


def _draws(status: DataFrame, units: DataFrame, count: int, places: DataFrame, lists: DataFrame, held: DataFrame) -> DataFrame:
    """This round's ``control, ord, passed``, written once: the claims of all units that have cases in need, and the cases that passed a sector."""
    units = units.hint("broadcast" if count <= _FEW else "merge")
    rows = status.join(units.drop("block"), "unit").filter("ord >= first").selectExpr(
        "unit", "0 as kind", "cell", "ord as id", "point", "need as n", "own", "look", "cast(null as array<long>) as cells"
    )
    # What a case before all those in need holds is open to none of them.
    holding = places.join(units.drop("block"), "unit").join(_sorted(held), "control", "left").filter("ord is null or ord > first")
    rows = rows.unionByName(holding.selectExpr("unit", "1 as kind", "cell", "control as id", "point", "ord as n", "null as own", "null as look", "null as cells"))
    rows = rows.unionByName(lists.join(units, "block").selectExpr("unit", "2 as kind", "case_cell as cell", "null as id", "null as point", "null as n", "null as own", "null as look", "cells"))
    dealt = rows.repartition(min(4 * count, _UNITS), "unit")
    return materialize(dealt.groupBy("unit").applyInArrow(_pass(), _DRAWN), "match-draws")


def match(cases: DataFrame, controls: DataFrame, config: MatchingConfig | None = None) -> MatchingResult:
    """Match every case to up to ``ratio`` controls; raises when nothing matches.

    Case order is ``case_order``, then the person id. The result depends on the data, the order and the
    seed only, not on partitioning. Each round writes its state to the shared scratch folder.
    """
    config = config or MatchingConfig()
    criteria = config.criteria
    original_cases, original_controls = prepare(cases, criteria, "cases"), prepare(controls, criteria, "controls")
    needed = dict.fromkeys(("pnr", *criteria.columns))
    # Only ids and matching attributes take part in the rounds; they are computed once.
    cases = materialize(_one_row_each(original_cases.select(*dict.fromkeys((*needed, *config.case_order)))), "match-cases")
    controls = materialize(_one_row_each(original_controls.select(*needed)), "match-controls")
    ordered = _ordered_cases(cases, config)
    edges, case_ids, control_ids = _edges(cases, controls, ordered, config)
    case_ids = materialize(_blocks(case_ids, criteria, -(-(cases.count() + controls.count()) // _UNIT)), "match-cells")
    if edges.count() > _EDGES:
        case_ids = materialize(_thinned(case_ids, edges), "match-cells")
    # Controls by number, which grows with the id, as ids decide between equal points.
    numbered = controls.select(F.col("pnr").alias("control_pnr"), cell_key(criteria).alias("cell"), point_of(config.seed, F.col("pnr")).alias("point"))
    numbered = materialize(numbered.orderBy("control_pnr").withColumn("control", F.monotonically_increasing_id()), "match-controls")
    in_block = edges.withColumnRenamed("case_cell", "id").join(_sorted(case_ids.select("id", "block")), "id")
    cells_of = materialize(in_block.groupBy("block", "cell").agg(F.first("n").alias("n")), "match-cells")
    weights = cells_of.select("block", "n").unionByName(case_ids.select("block", "n")).groupBy("block").agg(F.sum("n").alias("n"))
    sectors = materialize(weights.select("block", F.ceil(F.col("n") / (2 * _UNIT)).cast("long").alias("sectors")), "match-blocks")
    lists = materialize(in_block.groupBy("block", F.col("id").alias("case_cell")).agg(F.collect_list("cell").alias("cells")), "match-lists")
    unit, sector = f"shiftleft(block, {_SECTOR_BITS})", f"shiftright(point * sectors, {_CIRCLE_BITS})"
    placed = numbered.join(_sorted(control_ids), "cell").select("control", F.col("id").alias("cell"), "point")
    placed = placed.join(_sorted(cells_of.select("block", "cell")), "cell").join(_sorted(sectors), "block")
    placed = materialize(placed.selectExpr(f"{unit} | {sector} as unit", "cell", "control", "point"), "match-controls")
    ordered = ordered.withColumnRenamed("case_cell", "cell").join(_sorted(case_ids), "cell").join(_sorted(sectors), "block")
    ordered = ordered.join(_sorted(numbered.select(F.col("control_pnr").alias("case_pnr"), F.col("control").alias("own"))), "case_pnr", "left")
    ordered = ordered.select("ord", "case_pnr", F.col("id").alias("cell"), "block", "sectors", point_of(config.seed, F.col("case_pnr")).alias("point"), "own")
    ordered = materialize(ordered, "match-cases")
    turning = ordered.select("ord", "cell", "block", "sectors", "point", "own")
    held = cases.sparkSession.createDataFrame([], "control long, ord long")
    status = turning.selectExpr("*", f"cast({config.ratio} as long) as need", "0 as step")
    rounds = 0
    while True:
        # The last sector is that of the point again, up to which it is looked at then.
        status = status.filter("step <= if(sectors = 1, 0, sectors)").withColumns({
            "unit": F.expr(f"{unit} | ({sector} + step) % sectors"),
            "look": F.expr(f"case when sectors = 1 then {_WHOLE} when step = 0 then {_FROM} when step = sectors then {_BEFORE} else {_ALL} end"),
        })
        units = status.filter("need > 0").groupBy("unit", "block").agg(F.min("ord").alias("first"))
        units = materialize(units, "match-units")
        count = units.count()
        if not count:
            break
        rounds += 1
        draws = _draws(status, units, count, placed, lists, held)
        won = draws.filter("not passed").groupBy("control").agg(F.min("ord").alias("ord"))
        # A control keeps the earliest of its holder and its proposers.
        held = materialize(held.unionByName(won).groupBy("control").agg(F.min("ord").alias("ord")), "match-held")
        having = held.groupBy("ord").agg(F.count(F.lit(1)).alias("have"))
        status = (
            status.select(*turning.columns, "step").join(_sorted(having), "ord", "left").join(_sorted(draws.filter("passed").select("ord", "passed")), "ord", "left")
            .selectExpr(*turning.columns, f"{config.ratio} - coalesce(have, 0L) as need", "step + if(passed, 1, 0) as step")
        )
        status = materialize(status, "match-status")
    if held.isEmpty():
        raise ValueError("no case could be matched")
    pairs = (
        held.join(_sorted(ordered.select("ord", "case_pnr")), "ord").join(_sorted(numbered.select("control", "control_pnr")), "control")
        .select("case_pnr", "control_pnr")
        .join(_sorted(cases.select(F.col("pnr").alias("case_pnr"), F.col("birth_date").alias("case_birth_date"))), "case_pnr")
        .join(_sorted(controls.select(F.col("pnr").alias("control_pnr"), F.col("birth_date").alias("control_birth_date"))), "control_pnr")
        .select("case_pnr", "case_birth_date", "control_pnr", "control_birth_date",
                F.lit(config.matching_date).cast("date").alias("matching_date"))
    )
    return MatchingResult(
        pairs,
        _one_row_each(original_cases.join(_sorted(pairs.select(F.col("case_pnr").alias("pnr"))), "pnr", "left_semi")),
        _one_row_each(original_controls.join(_sorted(pairs.select(F.col("control_pnr").alias("pnr"))), "pnr", "left_semi")),
        rounds,
    )
