"""Ordered per-trace computation that survives traces of any length.

A running frame over ``partitionBy(trace)`` puts a whole trace into one task.
That is right for ordinary traces, so they take it: one shuffle, one sort. A
trace above ``segment_rows`` is cut into ordered segments instead; each segment
runs on its own, one summary row per segment is folded along the trace, and the
fold is joined back. Both ways give the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwatch.plans.formula import (
    Formula, before_first, boolean_column, settled, shared_levels)
from turnwatch.session import cut_lineage

SEGMENT_ROWS = 1_000_000
MAX_BROADCAST_KEYS = 2_000_000
_SEG = "__segment"


class TraceLayout:
    """How the rows of a table are spread: which traces are whole, which are cut."""

    def __init__(self, key: list[str], order: list[str], segment_rows: int = SEGMENT_ROWS,
                 long_keys: DataFrame | None = None, long_rows: int = 0):
        self.key, self.order = key, order
        self.segment_rows = segment_rows
        self.long_keys, self.long_rows = long_keys, long_rows
        self._carried: dict[str, Column] = {}

    @classmethod
    def of(cls, df: DataFrame, key: str | list[str], order: str | list[str],
           segment_rows: int = SEGMENT_ROWS) -> "TraceLayout":
        """Count rows per trace (key columns only, combined before the shuffle) and keep
        the keys of long traces. Their number is checked before they are broadcast:
        there are at most rows / segment_rows, and the limit grows until they fit."""
        key = [key] if isinstance(key, str) else list(key)
        order = [order] if isinstance(order, str) else list(order)
        sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
        limit = segment_rows
        found = sizes.filter(F.col("__n") > limit).agg(
            F.count(F.lit(1)).alias("keys"), F.sum("__n").alias("rows")).first()
        if not found["keys"]:
            return cls(key, order, segment_rows)
        long_keys = cut_lineage(sizes.filter(F.col("__n") > limit))
        while long_keys.count() > MAX_BROADCAST_KEYS:
            limit *= 4
            long_keys = long_keys.filter(F.col("__n") > limit)
        rows = long_keys.agg(F.sum("__n")).first()[0] or 0
        return cls(key, order, segment_rows, F.broadcast(long_keys.drop("__n")), rows)

    # -- the two sides -------------------------------------------------------------

    def _whole(self, df: DataFrame) -> DataFrame:
        if self.long_keys is None:
            return df
        return df.join(self.long_keys, self.key, "left_anti")

    def _cut(self, df: DataFrame) -> DataFrame:
        """Rows of long traces with a segment number that grows along each trace. The
        range bounds are sampled, so the assignment is fixed by a checkpoint."""
        rows = df.join(self.long_keys, self.key, "left_semi")
        parts = max(2, -(-self.long_rows // self.segment_rows) * 2)
        ranged = rows.repartitionByRange(parts, *[F.col(c) for c in self.key + self.order])
        return cut_lineage(ranged.withColumn(_SEG, F.spark_partition_id()))

    def _along(self) -> Window:
        return Window.partitionBy(*self.key).orderBy(*self.order)

    def _within(self) -> Window:
        return Window.partitionBy(*self.key, _SEG).orderBy(*self.order)

    def _fold(self, rows: DataFrame, summaries: dict[str, Column],
              carries: dict[str, Callable]) -> DataFrame:
        """One summary row per segment, folded along the trace, joined back."""
        segs = rows.groupBy(*self.key, _SEG).agg(
            *[c.alias(n) for n, c in summaries.items()])
        chain = Window.partitionBy(*self.key).orderBy(_SEG)
        folded = segs.select(*self.key, _SEG, *[c(chain).alias(n) for n, c in carries.items()])
        return rows.join(folded, [*self.key, _SEG])

    # -- running sums and positions ------------------------------------------------

    def running_sum(self, df: DataFrame, sums: dict[str, Column]) -> DataFrame:
        """Add inclusive running sums in trace order."""
        frame = self._along().rowsBetween(Window.unboundedPreceding, 0)
        out = self._whole(df).select("*", *[F.sum(c).over(frame).alias(n) for n, c in sums.items()])
        if self.long_keys is None:
            return out
        rows = self._cut(df)
        local = self._within().rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.select("*", *[F.sum(c).over(local).alias(n) for n, c in sums.items()])
        rows = self._fold(
            rows, {f"__s_{n}": F.sum(c) for n, c in sums.items()},
            {f"__c_{n}": lambda w, n=n: F.coalesce(F.sum(f"__s_{n}").over(
                w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for n in sums})
        for n in sums:
            rows = rows.withColumn(n, F.coalesce(F.col(n), F.lit(0)) + F.col(f"__c_{n}"))
        return out.unionByName(rows.select(*out.columns))

    def with_index(self, df: DataFrame, name: str = "trace_index") -> DataFrame:
        """Add the 0-based position of each row in its trace."""
        if self.long_keys is None:
            return df.withColumn(name, (F.row_number().over(self._along()) - 1).cast("long"))
        return self.running_sum(df, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)

    # -- temporal formulas -----------------------------------------------------------

    def evaluate(self, df: DataFrame, formulas: dict[str, Formula], props: dict[str, Column],
                 snapshot: bool = False, carried: dict[str, Column] | None = None) -> DataFrame:
        """Add one boolean column per formula. ``snapshot`` adds one per sub-formula,
        named ``sub_<i>`` in the order of ``snapshot_labels``. ``carried`` gives, by label, what a temporal
        sub-formula brings along from steps before the first row of a trace (null: nothing); its columns
        are the same in all rows of a trace."""
        self._carried = carried or {}
        levels = shared_levels(list(formulas.values()))
        slots: dict[str, str] = {}
        named = []
        for level in levels:
            step = []
            for node in level:
                inputs = [boolean_column(p, slots, props) for p in node.parts]
                step.append((f"__t{len(slots) + len(step)}", node, inputs))
            named.append(step)
            slots |= {node.label: name for name, node, _ in step}
        out = self._run_whole(self._whole(df), named)
        if self.long_keys is not None:
            cut = reduce(self._run_level_cut, named, self._cut(df))
            out = out.unionByName(cut.select(*out.columns))
        result = {n: boolean_column(f, slots, props) for n, f in formulas.items()}
        if snapshot:
            for i, node in enumerate(snapshot_nodes(formulas)):
                result[f"sub_{i}"] = boolean_column(node, slots, props)
        return out.select(*df.columns, *[c.alias(n) for n, c in result.items()])

    def _or_before(self, value: Column, node: Formula, start: bool) -> Column:
        """What a node has before anything in the trace settles it: the carried value, or its start."""
        before = [self._carried[node.label]] if node.label in self._carried else []
        return F.coalesce(value, *before, F.lit(start))

    def _run_whole(self, df: DataFrame, named) -> DataFrame:
        along = self._along()
        frame = along.rowsBetween(Window.unboundedPreceding, 0)
        for step in named:
            cols = []
            for name, node, inputs in step:
                if node.op in ("Y", "Z"):
                    value, start = F.lag(inputs[0], 1).over(along), before_first(node)
                else:
                    change, start = settled(node, inputs)
                    value = F.last(change, ignorenulls=True).over(frame)
                value = self._or_before(value, node, start)
                cols.append(value.alias(name))
            df = df.select("*", *cols)
        return df

    def _run_level_cut(self, df: DataFrame, step) -> DataFrame:
        local = self._within()
        frame = local.rowsBetween(Window.unboundedPreceding, 0)
        position = F.struct(*self.order)
        summaries, carries, starts, local_cols = {}, {}, {}, []
        for name, node, inputs in step:
            if node.op in ("Y", "Z"):
                local_cols.append(F.lag(inputs[0], 1).over(local).alias(name))
                summaries[f"__s{name}"] = F.max_by(inputs[0], position)
                starts[name] = node, before_first(node)
                carries[f"__c{name}"] = lambda w, n=name: F.lag(f"__s{n}", 1).over(w)
            else:
                change, start = settled(node, inputs)
                local_cols.append(F.last(change, ignorenulls=True).over(frame).alias(name))
                summaries[f"__s{name}"] = F.max_by(change, F.when(change.isNotNull(), position))
                starts[name] = node, start
                carries[f"__c{name}"] = lambda w, n=name: F.last(f"__s{n}", ignorenulls=True).over(
                    w.rowsBetween(Window.unboundedPreceding, -1))
        rows = self._fold(df.select("*", *local_cols), summaries, carries)
        for name, _, _ in step:
            rows = rows.withColumn(name, self._or_before(F.coalesce(F.col(name), F.col(f"__c{name}")), *starts[name]))
        return cut_lineage(rows.drop(*carries))


def snapshot_nodes(formulas: dict[str, Formula]) -> list[Formula]:
    """Distinct sub-formulas of all formulas, children first."""
    seen: dict[str, Formula] = {}
    for f in formulas.values():
        for node in f.walk():
            seen.setdefault(node.label, node)
    return list(seen.values())


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "position",
           segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """0-based row position per group, whatever the group sizes."""
    return TraceLayout.of(df, group, order, segment_rows).with_index(df, name)
