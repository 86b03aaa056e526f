"""Policies over conversations: grounding matrix, verdicts, violations, replay."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwatch.functions.text import strip
from turnwatch.plans.formula import (
    RESERVED, Formula, FormulaError, read_formula, weak_yesterday)
from turnwatch.plans.layout import TraceLayout, ranked, snapshot_nodes
from turnwatch.session import broadcast_if_small

# Fixed limits and roles of the message model.
ROLES = ("user", "assistant", "system")
MAX_MESSAGE_BYTES = 51_200
MAX_FORMULA_CHARS = 1_000
MAX_POLICIES = 50


@dataclass(frozen=True)
class Policy:
    policy_id: str
    name: str
    text: str

    @property
    def formula(self) -> Formula:
        return read_formula(self.text)


def check_policies(policies: list[Policy]) -> None:
    if len(policies) > MAX_POLICIES:
        raise ValueError(f"at most {MAX_POLICIES} policies")
    if len({p.policy_id for p in policies}) < len(policies):
        raise ValueError("policy ids must differ")
    for p in policies:
        if len(p.text) > MAX_FORMULA_CHARS:
            raise FormulaError(f"formula of {p.policy_id} is longer than {MAX_FORMULA_CHARS}")
        p.formula  # raises on malformed text


# -- message filters ------------------------------------------------------------------

def valid_messages(messages: DataFrame) -> DataFrame:
    """Messages with visible text of at most 51,200 UTF-8 bytes."""
    return messages.filter(
        (strip(F.col("text")) != "") & (F.octet_length("text") <= MAX_MESSAGE_BYTES))


def route_roles(messages: DataFrame) -> DataFrame:
    """Flag rows whose role is known; the rest belong in a quarantine output."""
    return messages.withColumn("accepted", F.coalesce(F.col("role").isin(*ROLES), F.lit(False)))


def user_turn() -> Column:
    return F.coalesce(F.col("role") == "user", F.lit(False))


def role_filter(messages: DataFrame, propositions: DataFrame) -> DataFrame:
    """Message x proposition pairs whose roles agree: the grounding work list."""
    return messages.join(broadcast_if_small(propositions), "role")


def needed_propositions(propositions: DataFrame, policies: DataFrame) -> DataFrame:
    """Propositions named by an enabled policy."""
    refs = policy_refs(policies.filter("enabled")).select("prop_id").distinct()
    return propositions.join(refs, "prop_id", "left_semi")


# -- policy tables ----------------------------------------------------------------------

def policy_refs(policies: DataFrame) -> DataFrame:
    """(policy_id, prop_id) links read from each formula, sorted, built-ins left out."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(
        "formula_str", F.lit(r"(?U)([\p{L}_]\w*)"), F.lit(1))))
    known = F.array_except(words, F.array(*[F.lit(w) for w in (*RESERVED, "user_turn")]))
    return policies.select("policy_id", F.explode(known).alias("prop_id"))


def resolve_refs(policies: DataFrame, propositions: DataFrame) -> DataFrame:
    """Links with a flag telling whether the proposition exists."""
    known = propositions.select("prop_id", F.lit(True).alias("known"))
    return (policy_refs(policies).join(known, "prop_id", "left")
            .withColumn("known", F.coalesce("known", F.lit(False))))


def policies_using(policies: DataFrame, prop_id: str) -> DataFrame:
    links = policy_refs(policies).filter(F.col("prop_id") == prop_id)
    return policies.join(links, "policy_id")


# -- labelings -----------------------------------------------------------------------------

def label_matrix(messages: DataFrame, judgments: DataFrame, prop_ids: list[str]) -> DataFrame:
    """One boolean column per proposition; anything unknown is false. Judgments are
    folded per message before they meet the messages, so no message repeats."""
    keys = ["conv_id", "turn"]
    flags = judgments.groupBy(*keys).agg(
        *[F.bool_or(F.when(F.col("prop_id") == p, F.col("match"))).alias(p) for p in prop_ids])
    return messages.join(flags, keys, "left").select(
        *messages.columns, *[F.coalesce(F.col(p), F.lit(False)).alias(p) for p in prop_ids])


# Fixed names of the entries of grounding details, and of the entry that tells of an earlier violation.
DETAIL = ["prop_id", "match", "confidence", "reasoning", "method"]
HISTORY_PROP, HISTORY_METHOD = "_violation_history", "monitor_note"


def grounding_details(judgments: DataFrame, layout: TraceLayout, prop_ids: list[str]) -> DataFrame:
    """One row per judged message: how each proposition was decided, in the order of ``prop_ids``.

    ``judgments(*key, *order, prop_id, match, confidence, reasoning, method)``. A proposition judged twice
    shows the judgment that counts in ``label_matrix``: a match before none, then the higher confidence; a judgment
    without an answer counts as no match. Judgments of other propositions are left out, their messages stay
    with an empty list."""
    best = [F.max(F.when(F.col("prop_id") == p, F.struct(
        F.coalesce("match", F.lit(False)).alias("match"), F.col("confidence").cast("double").alias("confidence"),
        "reasoning", "method"))).alias(f"d{i}") for i, p in enumerate(prop_ids)]
    entries = [F.when(F.col(f"d{i}").isNotNull(), F.struct(F.lit(p).alias("prop_id"), *[
        F.col(f"d{i}.{c}").alias(c) for c in DETAIL[1:]])) for i, p in enumerate(prop_ids)]
    at = [*layout.key, *layout.order]
    return judgments.groupBy(*at).agg(*best).select(*at, F.array_compact(F.array(*entries)).alias("grounding_details"))


def lexical_judgments(messages: DataFrame, tests: dict[str, tuple[str, Column]], layout: TraceLayout) -> DataFrame:
    """The judgments behind ``lexical_labels``: propositions of the message's role, with full confidence."""
    rows = F.array(*[F.when(F.col("role") == role, F.struct(F.lit(p).alias("prop_id"), F.coalesce(cond, F.lit(False)).alias("match")))
                     for p, (role, cond) in tests.items()])
    size = F.concat(F.coalesce(F.length("text"), F.lit(0)).cast("string"), F.lit(" characters"))
    return messages.select(*layout.key, *layout.order, F.explode(F.array_compact(rows)).alias("j"), size.alias("reasoning")).select(
        *layout.key, *layout.order, "j.*", F.lit(1.0).alias("confidence"), "reasoning", F.lit("lexical").alias("method"))


def lexical_labels(messages: DataFrame, tests: dict[str, tuple[str, Column]]) -> DataFrame:
    """Ground propositions by column tests: ``prop -> (role, condition)``. A proposition
    of another role is false at that step, never carried over."""
    cols = [(F.coalesce((F.col("role") == role) & cond, F.lit(False))).alias(p)
            for p, (role, cond) in tests.items()]
    return messages.select("*", *cols)


# -- verdicts --------------------------------------------------------------------------------

def _proposition_columns(policies: list[Policy], df: DataFrame) -> dict[str, Column]:
    names = {n for p in policies for n in p.formula.propositions}
    props = {n: F.col(n) for n in names if n in df.columns}
    if "role" in df.columns:
        props["user_turn"] = user_turn()  # built-in, replaces any column of that name
    return props


def monitor(labelled: DataFrame, policies: list[Policy], layout: TraceLayout,
            history: bool = False) -> DataFrame:
    """Verdict of every policy at every step: ``ok_<policy_id>`` columns, ``per_policy``
    map and ``passed``. With ``history``, ``was_<policy_id>`` tells whether the policy was
    already violated one step earlier."""
    check_policies(policies)
    formulas = {f"ok_{p.policy_id}": p.formula for p in policies}
    if history:
        formulas |= {f"was_{p.policy_id}": Formula("!", (weak_yesterday(p.formula),))
                     for p in policies}
    out = layout.evaluate(labelled, formulas, _proposition_columns(policies, labelled))
    if not policies:
        return out.withColumn("passed", F.lit(True))
    oks = [F.col(f"ok_{p.policy_id}") for p in policies]
    pairs = [x for p in policies for x in (F.lit(p.policy_id), F.col(f"ok_{p.policy_id}"))]
    return (out.withColumn("passed", reduce(lambda a, b: a & b, oks))
            .withColumn("per_policy", F.create_map(*pairs)))


def snapshot(labelled: DataFrame, policy: Policy, layout: TraceLayout) -> DataFrame:
    """After the last step of each trace: value of every sub-formula, steps, verdict."""
    formulas = {"verdict": policy.formula}
    labels = [n.label for n in snapshot_nodes(formulas)]
    rows = layout.evaluate(labelled, formulas, _proposition_columns([policy], labelled),
                           snapshot=True)
    subs = [F.col(f"sub_{i}").alias(f"s{i}") for i in range(len(labels))]
    last = rows.groupBy(*layout.key).agg(
        F.count(F.lit(1)).alias("step_count"),
        F.max_by(F.struct("verdict", *subs), F.struct(*layout.order)).alias("last"))
    states = F.create_map(*[x for i, label in enumerate(labels)
                            for x in (F.lit(label), F.col(f"last.s{i}"))])
    return last.select(*layout.key, "step_count", F.col("last.verdict").alias("verdict"),
                       states.alias("sub_formulas"))


HISTORY_NOTE = "already violated at an earlier step; the verdict is carried, not new"


def violations(monitored: DataFrame, policies: list[Policy], layout: TraceLayout,
               labels: list[str], judgments: DataFrame | None = None) -> DataFrame:
    """One row per false policy per step; needs ``monitor(..., history=True)``.

    With ``judgments`` (see ``grounding_details``) each row also says how its step was grounded; a carried
    violation says so first. Judgments meet the violated steps only, after the verdicts."""
    labeling = F.create_map(*[x for p in labels for x in (F.lit(p), F.col(p))])
    entries = F.array(*[F.struct(
        F.lit(p.policy_id).alias("policy_id"), F.lit(p.name).alias("policy_name"),
        F.lit(p.text).alias("formula_str"), F.col(f"ok_{p.policy_id}").alias("ok"),
        F.col(f"was_{p.policy_id}").alias("was_already_violated")) for p in policies])
    note = F.when(F.col("v.was_already_violated"), F.lit(HISTORY_NOTE))
    rows = (monitored.withColumn("labeling", labeling)
            .withColumn("v", F.explode(F.filter(entries, lambda e: ~e["ok"])))
            .select(*layout.key, *layout.order, "v.policy_id", "v.policy_name",
                    "v.formula_str", "v.was_already_violated", "labeling",
                    note.alias("history_note")))
    if judgments is None:
        return rows
    details = grounding_details(judgments, layout, labels)
    kind = details.schema["grounding_details"].dataType
    carried = F.array(F.struct(F.lit(HISTORY_PROP).alias("prop_id"), F.lit(False).alias("match"), F.lit(1.0).alias("confidence"),
                               F.lit(HISTORY_NOTE).alias("reasoning"), F.lit(HISTORY_METHOD).alias("method")))
    none = F.array().cast(kind)
    found = F.coalesce("grounding_details", none)
    return rows.join(details, [*layout.key, *layout.order], "left").withColumn(
        "grounding_details", F.concat(F.when(F.col("was_already_violated"), carried).otherwise(none), found))


def message_records(monitored: DataFrame, policies: list[Policy], layout: TraceLayout, labels: list[str],
                    judgments: DataFrame) -> DataFrame:
    """What is stored of a message: its verdicts, the violated policies with their formulas (null if none) and
    how its propositions were grounded (null if nothing was judged)."""
    entries = F.array(*[F.when(~F.col(f"ok_{p.policy_id}"), F.struct(
        F.lit(p.policy_id).alias("policy_id"), F.lit(p.name).alias("policy_name"),
        F.lit(p.text).alias("formula_str"))) for p in policies])
    info = F.array_compact(entries)
    rows = monitored.withColumn("__info", F.when(F.size(info) > 0, info))
    details = grounding_details(judgments, layout, labels)
    return rows.join(details, [*layout.key, *layout.order], "left").select(
        *layout.key, *layout.order, "role", "text", (~F.col("passed")).alias("blocked"), "per_policy",
        first_violated_policy(policies).alias("policy_id"), F.col("__info").alias("violation_info"),
        F.when(F.size("grounding_details") > 0, F.col("grounding_details")).alias("grounding_details"))


def first_violations(monitored: DataFrame, policies: list[Policy],
                     layout: TraceLayout) -> DataFrame:
    """First violated step per (trace, policy); traces that never fail give no row."""
    at = F.struct(*layout.order)
    firsts = monitored.groupBy(*layout.key).agg(
        *[F.min(F.when(~F.col(f"ok_{p.policy_id}"), at)).alias(p.policy_id) for p in policies])
    rows = F.array(*[F.struct(F.lit(p.policy_id).alias("policy_id"),
                              F.col(p.policy_id).alias("at")) for p in policies])
    return (firsts.withColumn("r", F.explode(rows)).filter("r.at is not null")
            .select(*layout.key, "r.policy_id", "r.at.*"))


def first_violated_policy(policies: list[Policy]) -> Column:
    """First violated policy of a message, in policy order."""
    return F.coalesce(*[F.when(~F.col(f"ok_{p.policy_id}"), F.lit(p.policy_id))
                        for p in policies])


def blocked_flags(monitored: DataFrame) -> DataFrame:
    return (monitored.withColumn("blocked", ~F.col("passed"))
            .withColumn("blocked_user", ~F.col("passed") & user_turn())
            .withColumn("blocked_response", ~F.col("passed") & (F.col("role") == "assistant")))


def visible_history(blocked: DataFrame) -> DataFrame:
    return blocked.filter(~F.col("blocked"))


def latest_state(monitored: DataFrame, policies: list[Policy], layout: TraceLayout) -> DataFrame:
    """Latest verdict per (trace, policy): what an upsert per step leaves behind."""
    last = monitored.groupBy(*layout.key).agg(F.max_by(
        F.struct(*layout.order, *[f"ok_{p.policy_id}" for p in policies]),
        F.struct(*layout.order)).alias("l"))
    rows = F.array(*[F.struct(F.lit(p.policy_id).alias("policy_id"),
                              F.col(f"l.ok_{p.policy_id}").alias("verdict")) for p in policies])
    return last.select(*layout.key, *[F.col(f"l.{c}").alias(c) for c in layout.order],
                       F.explode(rows).alias("r")).select(*layout.key, *layout.order, "r.*")


# -- replay --------------------------------------------------------------------------------------

def conversation_validity(messages: DataFrame, layout: TraceLayout) -> DataFrame:
    """Whether a conversation can be replayed, and why not. Only user and assistant turns
    with text count. Positions come from a running count, so length does not matter."""
    role = F.lower(F.trim("role"))
    kept = role.isin("user", "assistant") & (strip(F.col("text")) != "")
    rows = layout.running_sum(messages.withColumn("kept", F.coalesce(kept, F.lit(False)).cast("int")),
                              {"nth": F.col("kept")})
    expected = F.when(F.col("nth") % 2 == 1, "user").otherwise("assistant")
    stats = rows.groupBy(*layout.key).agg(
        F.sum("kept").alias("turns"),
        F.coalesce(F.bool_and(F.when(F.col("kept") == 1, role == expected)), F.lit(True)).alias("alternates"),
        F.coalesce(F.bool_or(F.when((F.col("kept") == 1) & (F.col("nth") == 1), role == "user")),
                   F.lit(False)).alias("starts_user"))
    reason = (F.when(F.col("turns") < 4, "short")
              .when(~F.col("starts_user"), "opening")
              .when(F.col("turns") % 2 != 0, "unanswered")
              .when(~F.col("alternates"), "order")
              .otherwise("ok"))
    return stats.select(*layout.key, "turns", reason.alias("reason"))


def replay_outcomes(monitored: DataFrame, policy: Policy, expected: DataFrame,
                    layout: TraceLayout) -> DataFrame:
    """Expected against actual violation per conversation."""
    actual = monitored.groupBy(*layout.key).agg(
        F.bool_or(~F.col(f"ok_{policy.policy_id}")).alias("actual_violation"),
        F.count(F.lit(1)).alias("steps"))
    out = expected.join(actual, layout.key, "left")
    want = F.col("target") == "violate"
    got = F.coalesce("actual_violation", F.lit(False))
    return out.select(*layout.key, "target", want.alias("expected_violation"),
                      got.alias("actual_violation"), (want == got).alias("success"),
                      F.coalesce("steps", F.lit(0)).alias("steps"))


def replay_summary(outcomes: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return outcomes.agg(
        n.alias("total"), F.count_if("success").alias("success_count"),
        F.round(F.when(n > 0, F.count_if("success") / n).otherwise(0.0), 6).alias("success_rate"),
        F.count_if("expected_violation").alias("expected_violate"),
        F.count_if(~F.col("expected_violation")).alias("expected_satisfy"),
        F.count_if("actual_violation").alias("actual_violate"))


def session_summary(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions with their message counts; sessions without messages count zero. Sessions that carry
    ``updated_at`` also get their place in the list, ``rank`` 0 for the latest (ties by id, unknown times last)."""
    counts = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("message_count"))
    out = sessions.join(counts, "conv_id", "left").withColumn(
        "message_count", F.coalesce("message_count", F.lit(0)))
    if "updated_at" not in sessions.columns:
        return out
    late = out.withColumn("__one", F.lit(1)).withColumn(
        "__late", F.coalesce(-F.unix_micros("updated_at"), F.lit(2**62)))
    return ranked(late, ["__one"], ["__late", "conv_id"], "rank").drop("__one", "__late")
