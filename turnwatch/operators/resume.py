"""Verdicts from a saved state: one bit per temporal sub-formula and conversation.

A state is a table ``(<key>, <order>, carry)``: the last step that was judged and, by label, what each temporal
sub-formula brings along. Batches and streams start from the same table and give the rows that one run over
everything gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwatch.operators.monitor import Policy, _proposition_columns, check_policies
from turnwatch.plans.formula import Formula, shared_levels, weak_yesterday
from turnwatch.plans.layout import TraceLayout


def _formulas(policies: list[Policy]) -> dict[str, Formula]:
    """Verdicts, and whether a policy was false one step earlier."""
    check_policies(policies)
    return ({f"ok_{p.policy_id}": p.formula for p in policies}
            | {f"was_{p.policy_id}": Formula("!", (weak_yesterday(p.formula),)) for p in policies})


def carried_nodes(policies: list[Policy]) -> list[Formula]:
    """The temporal sub-formulas whose values a state holds."""
    return [node for level in shared_levels(list(_formulas(policies).values())) for node in level]


def judge_from(labelled: DataFrame, policies: list[Policy], key: str | list[str], order: str | list[str],
               state: DataFrame | None = None, segment_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(verdicts, state)``: the rows of ``labelled`` after the last step of the state, with ``ok_`` and ``was_`` columns and
    ``passed``, and the state after them. Rows up to that step were judged before and are left out. Conversations
    without new rows keep their state, new ones start afresh. The state is joined on the key, as both sides hold one
    row or one run of rows per conversation."""
    key, order = [key] if isinstance(key, str) else list(key), [order] if isinstance(order, str) else list(order)
    formulas, nodes = _formulas(policies), carried_nodes(policies)
    rows = labelled
    if state is not None:
        last = state.select(*key, F.struct(*order).alias("__last"), F.col("carry").alias("__carry"))
        rows = labelled.join(last, key, "left").filter(F.col("__last").isNull() | (F.struct(*order) > F.col("__last")))
    else:
        rows = rows.withColumn("__carry", F.lit(None).cast("map<string,boolean>"))
    layout = TraceLayout.of(rows, key, order, *([segment_rows] if segment_rows else []))
    after = {f"__after_{i}": node.parts[0] if node.op in ("Y", "Z") else node for i, node in enumerate(nodes)}
    carried = {node.label: F.col("__carry")[node.label] for node in nodes}
    out = layout.evaluate(rows, formulas | after, _proposition_columns(policies, labelled), carried=carried)
    passed = F.lit(True)
    for p in policies:
        passed = passed & F.col(f"ok_{p.policy_id}")
    verdicts = out.select(*labelled.columns, *formulas, passed.alias("passed"))
    entries = [x for i, node in enumerate(nodes) for x in (F.lit(node.label), F.col(f"__after_{i}"))]
    carry = F.create_map(*entries) if nodes else F.lit(None).cast("map<string,boolean>")
    newest = (out.groupBy(*key).agg(F.max_by(F.struct(*order, carry.alias("carry")), F.struct(*order)).alias("s"))
              .select(*key, "s.*"))
    if state is not None:
        newest = newest.unionByName(state.select(newest.columns).join(newest.select(*key), key, "left_anti"))
    return verdicts, newest
