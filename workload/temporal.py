"""Traces, propositions, policies and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwatch.operators import monitor as M
from turnwatch.plans.formula import read_formula
from turnwatch.plans.layout import TraceLayout
from turnwatch.session import new_folder
from turnwatch.sources import readers, sinks
from workload.registry import documents, query, table

# -- inputs --------------------------------------------------------------------------------

def lexical_tests():
    """Propositions over conversations, decided by simple text tests."""
    text = F.col("text")
    return {
        "p_long": ("user", F.length(text) > 200),
        "p_short": ("user", F.length(text) < 100),
        "p_multi": ("user", F.contains(text, F.lit("\n"))),
        "q_brief": ("assistant", F.length(text) < 500),
        "q_long": ("assistant", F.length(text) > 1200),
        "q_multi": ("assistant", F.contains(text, F.lit("\n"))),
    }


POLICIES = [
    M.Policy("a", "no brief answer after a long question", "H(P(p_long) -> !q_brief)"),
    M.Policy("b", "answer in kind", "H(Y(p_multi) -> q_multi) & H(P(p_short) -> !q_long)"),
    M.Policy("c", "short questions need context", "p_short -> (!q_long S p_multi)"),
]


def conversations(spark, sf):
    df = table(spark, sf, "conversations")
    return df, TraceLayout.of(df, "conv_id", "turn")


def monitored(spark, sf, history=False, policies=POLICIES):
    df, layout = conversations(spark, sf)
    labelled = M.lexical_labels(df, lexical_tests())
    return M.monitor(labelled, policies, layout, history), layout


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def event_traces(spark, sf):
    """Events as traces: one proposition per event type, ordered in time per user."""
    df = table(spark, sf, "events").select(
        "event_id", "ts", "user_id", *[(F.col("event_type") == t).alias(t) for t in EVENT_TYPES])
    return df, TraceLayout.of(df, "user_id", ["ts", "event_id"])


def event_formula(spark, sf, **formulas):
    df, layout = event_traces(spark, sf)
    out = layout.evaluate(df, {k: read_formula(v) for k, v in formulas.items()},
                          {t: F.col(t) for t in EVENT_TYPES})
    return out.select("event_id", *formulas)


M_SQL = """m AS (SELECT conv_id, turn, role, text,
 role='user' AND length(text)>200 AS p_long, role='user' AND length(text)<100 AS p_short,
 role='user' AND contains(text, chr(10)) AS p_multi,
 role='assistant' AND length(text)<500 AS q_brief,
 role='assistant' AND length(text)>1200 AS q_long,
 role='assistant' AND contains(text, chr(10)) AS q_multi FROM conversations)"""
WIN = """WINDOW w AS (PARTITION BY conv_id ORDER BY turn),
 r AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
V_SQL = f"""{M_SQL}, t1 AS (SELECT *, bool_or(p_long) OVER r AS p1, bool_or(p_short) OVER r AS p2,
 lag(p_multi,1,false) OVER w AS y1,
 max(CASE WHEN p_multi THEN turn END) OVER r AS st, max(CASE WHEN q_long THEN turn END) OVER r AS br
 FROM m {WIN}), v AS (SELECT *, bool_and(NOT p1 OR NOT q_brief) OVER r AS ok_a,
 bool_and(NOT y1 OR q_multi) OVER r AND bool_and(NOT p2 OR NOT q_long) OVER r AS ok_b,
 NOT p_short OR coalesce(st >= coalesce(br,-1), false) AS ok_c FROM t1 {WIN}),
 vv AS (SELECT *, ok_a AND ok_b AND ok_c AS passed, NOT lag(ok_a,1,true) OVER w AS was_a,
 NOT lag(ok_b,1,true) OVER w AS was_b, NOT lag(ok_c,1,true) OVER w AS was_c FROM v {WIN})"""
LONG_SQL = """l AS (SELECT conv_id, turn, role, 'a' AS policy_id, ok_a AS ok, was_a AS was FROM vv
 UNION ALL SELECT conv_id, turn, role, 'b', ok_b, was_b FROM vv
 UNION ALL SELECT conv_id, turn, role, 'c', ok_c, was_c FROM vv)"""
E_SQL = """e AS (SELECT event_id, ts, user_id, event_type='click' AS click, event_type='error' AS error,
 event_type='purchase' AS purchase, event_type='signup' AS signup, event_type='view' AS vw,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"""
EWIN = """WINDOW w AS (PARTITION BY user_id ORDER BY i),
 r AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

# -- scans and filters ---------------------------------------------------------------------


@query("trace_scan", """SELECT conv_id, turn, role,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS trace_index FROM conversations""")
def trace_scan(spark, sf):
    df, layout = conversations(spark, sf)
    return readers.trace_scan(df, layout).select("conv_id", "turn", "role", "trace_index")


@query("propositions_scan", r"""SELECT doc_id AS prop_id,
 len(l) AS n_pos, array_to_string(l, '|') AS positives, 0 AS n_neg FROM (SELECT doc_id,
 list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x,'^\s+|\s+$','','g')),
lambda x: x <> '') AS l FROM documents)""")
def propositions_scan(spark, sf):
    raw = documents(spark, sf).select(
        F.col("doc_id").alias("prop_id"), F.col("source").alias("description"),
        F.lit("user").alias("role"), F.to_json(F.split("text", "\n")).alias("few_shot_positive"),
        F.concat(F.lit("no list: "), "lang").alias("few_shot_negative"))
    out = readers.propositions_scan(raw)
    return out.select("prop_id", F.size("few_shot_positive").alias("n_pos"),
                      F.array_join("few_shot_positive", "|").alias("positives"),
                      F.size("few_shot_negative").alias("n_neg"))


def part_policies(spark, sf):
    """A policy table as large as ``part``."""
    brand = F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("policy_id"), F.col("p_name").alias("name"),
        F.concat(F.lit("H(P("), F.lower("p_type"), F.lit(") -> !"), brand, F.lit(" | user_turn)"))
        .alias("formula_str"), (F.col("p_size") > 25).alias("enabled"),
        F.col("p_retailprice").alias("created_at"))


def part_propositions(spark, sf):
    part = table(spark, sf, "part")
    brands = part.filter(F.col("p_size") < 10).select(
        F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")).alias("prop_id"))
    return brands.unionByName(part.select(F.lower("p_type").alias("prop_id"))).distinct()


PART_SQL = """pol AS (SELECT p_partkey AS policy_id, p_name AS name, p_size > 25 AS enabled,
 p_retailprice AS created_at, lower(p_type) AS r1, replace(p_brand,'#','_') AS r2,
 'H(P(' || lower(p_type) || ') -> !' || replace(p_brand,'#','_') || ' | user_turn)' AS formula_str FROM part),
 refs AS (SELECT policy_id, enabled, r1 AS prop_id FROM pol UNION ALL SELECT policy_id, enabled, r2 FROM pol),
 props AS (SELECT DISTINCT replace(p_brand,'#','_') AS prop_id FROM part WHERE p_size < 10
 UNION SELECT DISTINCT lower(p_type) FROM part)"""


@query("policies_enabled", f"WITH {PART_SQL} SELECT policy_id, name, formula_str FROM pol WHERE enabled")
def policies_enabled(spark, sf):
    return readers.policies_scan(part_policies(spark, sf), enabled_only=True).select(
        "policy_id", "name", "formula_str")


@query("policies_ranked", f"""WITH {PART_SQL} SELECT policy_id, name, (row_number() OVER (ORDER BY created_at, policy_id) - 1)::INT AS rank
 FROM pol WHERE enabled""")
def policies_ranked(spark, sf):
    """The enabled policies with their place in the list."""
    return readers.policies_scan(part_policies(spark, sf), enabled_only=True, ranks=True).select("policy_id", "name", "rank")


@query("policy_refs", f"""WITH {PART_SQL} SELECT policy_id, prop_id,
 prop_id IN (SELECT prop_id FROM props) AS known FROM refs""")
def policy_refs(spark, sf):
    return M.resolve_refs(part_policies(spark, sf), part_propositions(spark, sf))


@query("policies_using_prop", f"WITH {PART_SQL} SELECT policy_id, name FROM pol WHERE r1='economy'")
def policies_using_prop(spark, sf):
    return M.policies_using(part_policies(spark, sf), "economy").select("policy_id", "name")


@query("needed_propositions", f"""WITH {PART_SQL} SELECT prop_id FROM props
 WHERE prop_id IN (SELECT prop_id FROM refs WHERE enabled)""")
def needed_propositions(spark, sf):
    return M.needed_propositions(part_propositions(spark, sf), part_policies(spark, sf))


def region_propositions(spark, sf):
    return table(spark, sf, "region").select(
        F.lower("r_name").alias("prop_id"),
        F.when(F.col("r_regionkey") < 2, "user").otherwise("assistant").alias("role"))


PAIR_SQL = """SELECT conv_id, turn, prop_id, role FROM conversations JOIN
 (SELECT lower(r_name) AS prop_id, CASE WHEN r_regionkey < 2 THEN 'user' ELSE 'assistant' END AS role
 FROM region) USING (role)"""


@query("role_filter", f"SELECT conv_id, turn, count(*) AS n_props FROM ({PAIR_SQL}) GROUP BY ALL")
def role_filter(spark, sf):
    df, _ = conversations(spark, sf)
    return M.role_filter(df, region_propositions(spark, sf)).groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_props"))


@query("ground_pairs", PAIR_SQL)
def ground_pairs(spark, sf):
    df, _ = conversations(spark, sf)
    return M.role_filter(df, region_propositions(spark, sf)).select("conv_id", "turn", "prop_id", "role")


@query("builtin_user_turn", "SELECT conv_id, turn, role='user' AS user_turn FROM conversations")
def builtin_user_turn(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", M.user_turn().alias("user_turn"))


@query("valid_messages", r"""SELECT doc_id, strlen(text) AS bytes FROM documents
 WHERE regexp_matches(text, '\S') AND strlen(text) <= 51200""")
def valid_messages(spark, sf):
    return M.valid_messages(table(spark, sf, "documents")).select(
        "doc_id", F.octet_length("text").alias("bytes"))


@query("valid_roles", """SELECT conv_id, turn, role IN ('user','assistant','system') AS accepted
 FROM conversations""")
def valid_roles(spark, sf):
    return M.route_roles(table(spark, sf, "conversations")).select("conv_id", "turn", "accepted")


@query("visible_history", f"WITH {V_SQL} SELECT conv_id, turn, role FROM vv WHERE passed")
def visible_history(spark, sf):
    out, _ = monitored(spark, sf)
    return M.visible_history(M.blocked_flags(out)).select("conv_id", "turn", "role")


@query("conversation_validity", r"""WITH k AS (SELECT conv_id, role, row_number() OVER
 (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations
 WHERE role IN ('user','assistant') AND regexp_matches(text,'\S')),
 s AS (SELECT conv_id, count(*) AS n, bool_and(role = CASE WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END) AS alt,
 bool_or(nth=1 AND role='user') AS st FROM k GROUP BY conv_id)
 SELECT c.conv_id, coalesce(n,0) AS turns, CASE WHEN coalesce(n,0) < 4 THEN 'short'
 WHEN NOT st THEN 'opening' WHEN n % 2 <> 0 THEN 'unanswered'
 WHEN NOT alt THEN 'order' ELSE 'ok' END AS reason
 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s USING (conv_id)""")
def conversation_validity(spark, sf):
    df, layout = conversations(spark, sf)
    return M.conversation_validity(df, layout)


# -- labelings -----------------------------------------------------------------------------------


@query("label_matrix", f"WITH {M_SQL} SELECT conv_id, turn, p_long, q_brief, false AS q_unknown FROM m")
def label_matrix(spark, sf):
    df, _ = conversations(spark, sf)
    tests = {k: lexical_tests()[k] for k in ("p_long", "q_brief")}
    judged = F.explode(F.array(*[F.struct(
        F.lit(p).alias("prop_id"), F.lit(role).alias("prop_role"), cond.alias("match"))
        for p, (role, cond) in tests.items()]))
    judgments = df.select("conv_id", "turn", "role", judged.alias("j")).filter(
        F.col("role") == F.col("j.prop_role")).select("conv_id", "turn", "j.prop_id", "j.match")
    return M.label_matrix(df, judgments, ["p_long", "q_brief", "q_unknown"]).select(
        "conv_id", "turn", "p_long", "q_brief", "q_unknown")


# -- temporal operators ---------------------------------------------------------------------------


@query("ltl_bool", f"""WITH {M_SQL} SELECT conv_id, turn, NOT p_long OR (role='user' AND NOT p_multi) AS v1,
 (p_short AND true) OR (q_brief AND NOT false) AS v2, NOT p_long OR (NOT p_multi OR p_short) AS v3 FROM m""")
def ltl_bool(spark, sf):
    df, layout = conversations(spark, sf)
    texts = {"v1": "p_long -> user_turn & !p_multi", "v2": "p_short & true | q_brief & !false",
             "v3": "p_long -> p_multi -> p_short"}
    props = {k: F.col(k) for k in lexical_tests()} | {"user_turn": M.user_turn()}
    return layout.evaluate(M.lexical_labels(df, lexical_tests()),
                           {k: read_formula(v) for k, v in texts.items()}, props).select(
        "conv_id", "turn", *texts)


@query("ltl_yesterday", f"""WITH {E_SQL}, h AS (SELECT *, bool_and(NOT error) OVER r AS h FROM e {EWIN})
 SELECT event_id, lag(click,1,false) OVER w AS y, lag(click,2,false) OVER w AS yy,
 lag(h,1,true) OVER w AS yh, lag(true,1,false) OVER w AS yt FROM h {EWIN}""")
def ltl_yesterday(spark, sf):
    return event_formula(spark, sf, y="Y(click)", yy="Y(Y(click))", yh="Y(H(!error))", yt="Y(true)")


@query("ltl_previously", f"""WITH {E_SQL} SELECT event_id, bool_or(purchase) OVER r AS p,
 NOT bool_or(purchase) OVER r OR bool_or(signup) OVER r AS q FROM e {EWIN}""")
def ltl_previously(spark, sf):
    return event_formula(spark, sf, p="P(purchase)", q="P(purchase) -> P(signup)")


@query("ltl_historically", f"""WITH {E_SQL} SELECT event_id, bool_and(NOT error) OVER r AS h,
 bool_and(NOT error OR NOT vw) OVER r AS always FROM e {EWIN}""")
def ltl_historically(spark, sf):
    return event_formula(spark, sf, h="H(!error)", always="H(error -> !view)")


@query("ltl_since", f"""WITH {E_SQL}, x AS (SELECT *, max(CASE WHEN signup THEN i END) OVER r AS st,
 max(CASE WHEN error THEN i END) OVER r AS br FROM e {EWIN})
 SELECT event_id, coalesce(st >= coalesce(br,-1), false) AS s,
 NOT purchase OR coalesce(st >= coalesce(br,-1), false) AS guarded FROM x""")
def ltl_since(spark, sf):
    return event_formula(spark, sf, s="!error S signup", guarded="purchase -> (!error S signup)")


NESTED = """x1 AS (SELECT *, lag(NOT purchase OR NOT error,1,false) OVER w AS y1, bool_or(signup) OVER r AS p1 FROM e {w}),
 x2 AS (SELECT *, bool_or(y1) OVER r AS p2, max(CASE WHEN click THEN i END) OVER r AS st,
 max(CASE WHEN NOT p1 THEN i END) OVER r AS br FROM x1 {w}),
 x3 AS (SELECT *, bool_and(p2) OVER r AS n1, coalesce(st >= coalesce(br,-1), false) AS s FROM x2 {w}),
 x4 AS (SELECT *, lag(s,1,false) OVER w AS n2, bool_and(NOT error OR s) OVER r AS n3 FROM x3 {w})""".format(w=EWIN)


@query("ltl_nested", f"WITH {E_SQL}, {NESTED} SELECT event_id, n1, n2, n3 FROM x4")
def ltl_nested(spark, sf):
    return event_formula(spark, sf, n1="H(P(Y(purchase -> !error)))", n2="Y(P(signup) S click)",
                         n3="H(error -> (P(signup) S click))")


@query("ltl_verdict_at", f"WITH {V_SQL} SELECT conv_id, turn, ok_a AS verdict FROM vv")
def ltl_verdict_at(spark, sf):
    df, layout = conversations(spark, sf)
    return layout.evaluate(
        M.lexical_labels(df, lexical_tests()), {"verdict": POLICIES[0].formula},
        {k: F.col(k) for k in lexical_tests()}).select("conv_id", "turn", "verdict")


@query("policy_monitor", f"WITH {V_SQL} SELECT conv_id, turn, ok_a, ok_b, ok_c, passed FROM vv")
def policy_monitor(spark, sf):
    out, _ = monitored(spark, sf)
    return out.select("conv_id", "turn", "ok_a", "ok_b", "ok_c", "passed")


EVENT_POLICIES = [
    M.Policy("buy", "no purchase after an error without a view", "H(purchase -> (!error S view))"),
    M.Policy("join", "purchases follow a signup", "H(P(purchase) -> P(signup))"),
    M.Policy("calm", "no two errors in a row", "H(!(error & Y(error)))")]


@query("policy_monitor_events", f"""WITH {E_SQL}, x AS (SELECT *, max(CASE WHEN vw THEN i END) OVER r AS st,
 max(CASE WHEN error THEN i END) OVER r AS br, bool_or(purchase) OVER r AS pp, bool_or(signup) OVER r AS ps,
 lag(error,1,false) OVER w AS ye FROM e {EWIN}), z AS (SELECT event_id,
 bool_and(NOT purchase OR coalesce(st >= coalesce(br,-1), false)) OVER r AS ok_buy,
 bool_and(NOT pp OR ps) OVER r AS ok_join, bool_and(NOT (error AND ye)) OVER r AS ok_calm FROM x {EWIN})
 SELECT *, ok_buy AND ok_join AND ok_calm AS passed FROM z""")
def policy_monitor_events(spark, sf):
    df, layout = event_traces(spark, sf)
    return M.monitor(df, EVENT_POLICIES, layout).select(
        "event_id", "ok_buy", "ok_join", "ok_calm", "passed")


@query("policy_monitor_orders", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey
 ORDER BY o_orderdate, o_orderkey) AS i FROM orders), x AS (SELECT *,
 bool_or(o_orderstatus='F') OVER r AS pf, lag(o_totalprice>300000,1,false) OVER w AS yb FROM o
 WINDOW w AS (PARTITION BY o_custkey ORDER BY i), r AS (PARTITION BY o_custkey ORDER BY i
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT o_orderkey, bool_and(NOT pf OR NOT (o_orderstatus='P')) OVER r AS ok_open,
 NOT yb OR NOT (o_totalprice>300000) AS ok_big FROM x
 WINDOW r AS (PARTITION BY o_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def policy_monitor_orders(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderstatus") == "F").alias("filled"),
        (F.col("o_orderstatus") == "P").alias("pending"), (F.col("o_totalprice") > 300000).alias("big"))
    layout = TraceLayout.of(df, "o_custkey", ["o_orderdate", "o_orderkey"])
    rules = [M.Policy("open", "nothing pending after a filled order", "H(P(filled) -> !pending)"),
             M.Policy("big", "no two big orders in a row", "Y(big) -> !big")]
    return M.monitor(df, rules, layout).select("o_orderkey", "ok_open", "ok_big")


@query("violations", f"""WITH {V_SQL}, {LONG_SQL} SELECT conv_id, turn, policy_id,
 was AS was_already_violated, p_long, q_brief FROM l JOIN m USING (conv_id, turn) WHERE NOT ok""")
def violations(spark, sf):
    out, layout = monitored(spark, sf, history=True)
    labels = list(lexical_tests())
    return M.violations(out, POLICIES, layout, labels).select(
        "conv_id", "turn", "policy_id", "was_already_violated",
        F.col("labeling")["p_long"].alias("p_long"), F.col("labeling")["q_brief"].alias("q_brief"))


# How each proposition of the message's role was decided, as text in the order of the tests.
DETAIL_SQL = """g AS (SELECT conv_id, turn, CASE role
 WHEN 'user' THEN concat('p_long=',p_long::INT,' p_short=',p_short::INT,' p_multi=',p_multi::INT)
 WHEN 'assistant' THEN concat('q_brief=',q_brief::INT,' q_long=',q_long::INT,' q_multi=',q_multi::INT) ELSE '' END AS decided,
 CASE WHEN role IN ('user','assistant') THEN 3 ELSE 0 END AS n, coalesce(length(text), 0) || ' characters' AS reason FROM m)"""


def decided(details):
    return F.array_join(F.transform(F.filter(details, lambda d: d["method"] == "lexical"), lambda d: F.concat(
        d["prop_id"], F.lit("="), d["match"].cast("int").cast("string"))), " ")


@query("violation_details", f"""WITH {V_SQL}, {LONG_SQL}, {DETAIL_SQL} SELECT conv_id, turn, policy_id, was AS carried, decided,
 n + was::INT AS entries, reason FROM l JOIN g USING (conv_id, turn) WHERE NOT ok""")
def violation_details(spark, sf):
    out, layout = monitored(spark, sf, history=True)
    judged = M.lexical_judgments(table(spark, sf, "conversations"), lexical_tests(), layout)
    rows = M.violations(out, POLICIES, layout, list(lexical_tests()), judged)
    details = F.col("grounding_details")
    return rows.select("conv_id", "turn", "policy_id", (F.get(details, F.lit(0))["method"] == M.HISTORY_METHOD).alias("carried"),
                       decided(details).alias("decided"), F.size(details).alias("entries"),
                       F.element_at(details, -1)["reasoning"].alias("reason"))


@query("first_violation", f"""WITH {V_SQL}, {LONG_SQL} SELECT conv_id, policy_id, min(turn) AS turn
 FROM l WHERE NOT ok GROUP BY ALL""")
def first_violation(spark, sf):
    out, layout = monitored(spark, sf)
    return M.first_violations(out, POLICIES, layout)


@query("first_violated_policy", f"""WITH {V_SQL} SELECT conv_id, turn, CASE WHEN NOT ok_a THEN 'a'
 WHEN NOT ok_b THEN 'b' ELSE 'c' END AS policy_id FROM vv WHERE NOT passed""")
def first_violated_policy(spark, sf):
    out, _ = monitored(spark, sf)
    return out.filter(~F.col("passed")).select(
        "conv_id", "turn", M.first_violated_policy(POLICIES).alias("policy_id"))


@query("violation_onsets", f"""WITH {V_SQL}, {LONG_SQL} SELECT conv_id, turn, policy_id FROM l
 WHERE NOT ok AND NOT was""")
def violation_onsets(spark, sf):
    out, layout = monitored(spark, sf, history=True)
    return M.violations(out, POLICIES, layout, ["p_long"]).filter(
        ~F.col("was_already_violated")).select("conv_id", "turn", "policy_id")


@query("subformula_snapshot", f"""WITH {V_SQL} SELECT conv_id, count(*) AS step_count,
 max_by(ok_a, turn) AS verdict, max_by(p1, turn) AS p_prev, max_by(q_brief, turn) AS brief,
 max_by(NOT p1 OR NOT q_brief, turn) AS implication FROM vv GROUP BY conv_id""")
def subformula_snapshot(spark, sf):
    df, layout = conversations(spark, sf)
    out = M.snapshot(M.lexical_labels(df, lexical_tests()), POLICIES[0], layout)
    sub = F.col("sub_formulas")
    return out.select("conv_id", "step_count", "verdict", sub["P(p_long)"].alias("p_prev"),
                      sub["q_brief"].alias("brief"),
                      sub["(P(p_long) -> !(q_brief))"].alias("implication"))


@query("blocked_flag", f"""WITH {V_SQL} SELECT conv_id, turn, NOT passed AS blocked,
 NOT passed AND role='user' AS blocked_user, NOT passed AND role='assistant' AS blocked_response FROM vv""")
def blocked_flag(spark, sf):
    out, _ = monitored(spark, sf)
    return M.blocked_flags(out).select("conv_id", "turn", "blocked", "blocked_user", "blocked_response")


@query("monitor_state_upsert", f"""WITH {V_SQL}, {LONG_SQL} SELECT conv_id, policy_id, max(turn) AS turn,
 max_by(ok, turn) AS verdict FROM l GROUP BY conv_id, policy_id""")
def monitor_state_upsert(spark, sf):
    out, layout = monitored(spark, sf)
    return M.latest_state(out, POLICIES, layout)


def replay(spark, sf):
    """Conversations that open with a long message are expected to violate."""
    df, layout = conversations(spark, sf)
    policy = POLICIES[0]
    out = M.monitor(M.lexical_labels(df, lexical_tests()), [policy], layout)
    expected = df.groupBy("conv_id").agg(F.min_by(F.length("text"), "turn").alias("n")).select(
        "conv_id", F.when(F.col("n") > 150, "violate").otherwise("satisfy").alias("target"))
    return M.replay_outcomes(out, policy, expected, layout)


REPLAY_SQL = f"""WITH {V_SQL}, o AS (SELECT conv_id, bool_or(NOT ok_a) AS act, count(*) AS steps,
 min_by(length(text), turn) > 150 AS want FROM vv GROUP BY conv_id)"""


@query("policy_replay_eval", f"""{REPLAY_SQL} SELECT count(*) AS total, count(nullif(act=want, false)) AS success_count,
 round(count(nullif(act=want, false))/count(*),6) AS success_rate, count(nullif(want, false)) AS expected_violate,
 count(nullif(NOT want, false)) AS expected_satisfy, count(nullif(act, false)) AS actual_violate FROM o""")
def policy_replay_eval(spark, sf):
    return M.replay_summary(replay(spark, sf))


@query("policy_replay_outcomes", f"""{REPLAY_SQL} SELECT conv_id, want AS expected_violation,
 act AS actual_violation, want=act AS success, steps FROM o""")
def policy_replay_outcomes(spark, sf):
    return replay(spark, sf).drop("target")


@query("session_summary", """WITH s AS (SELECT c_custkey AS conv_id, count(o_orderkey) AS message_count
 FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY ALL)
 SELECT *, row_number() OVER (ORDER BY conv_id*7919%1000 DESC, conv_id)-1 AS rank FROM s""")
def session_summary(spark, sf):
    """Sessions in the order of their last change, here a time made from the id."""
    sessions = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("conv_id"), F.timestamp_seconds(F.col("c_custkey") * 7919 % 1000).alias("updated_at"))
    messages = table(spark, sf, "orders").select(F.col("o_custkey").alias("conv_id"))
    return M.session_summary(messages, sessions).drop("updated_at")


# -- sinks ----------------------------------------------------------------------------------------


@query("verdict_sink", f"""WITH {V_SQL} SELECT conv_id, turn, NOT passed AS blocked,
 CASE WHEN NOT ok_a THEN 'a' WHEN NOT ok_b THEN 'b' WHEN NOT ok_c THEN 'c' END AS policy_id, ok_b FROM vv""")
def verdict_sink(spark, sf):
    out, _ = monitored(spark, sf)
    path = new_folder(spark, "verdicts")
    rows = M.blocked_flags(out).select(
        "conv_id", "turn", "role", "text", "blocked", "per_policy",
        M.first_violated_policy(POLICIES).alias("policy_id"))
    sinks.write_verdicts(rows, path)
    return spark.read.parquet(path).select(
        "conv_id", "turn", "blocked", "policy_id", F.col("per_policy")["b"].alias("ok_b"))


@query("message_record_sink", f"""WITH {V_SQL}, {DETAIL_SQL} SELECT conv_id, turn, NOT passed AS blocked,
 nullif(concat_ws(',', CASE WHEN NOT ok_a THEN 'a' END, CASE WHEN NOT ok_b THEN 'b' END, CASE WHEN NOT ok_c THEN 'c' END), '') AS violated,
 nullif(decided, '') AS decided FROM vv JOIN g USING (conv_id, turn)""")
def message_record_sink(spark, sf):
    """Messages stored with violations and grounding details, read back."""
    out, layout = monitored(spark, sf)
    judged = M.lexical_judgments(table(spark, sf, "conversations"), lexical_tests(), layout)
    path = new_folder(spark, "messages")
    sinks.write_verdicts(M.message_records(out, POLICIES, layout, list(lexical_tests()), judged), path)
    return spark.read.parquet(path).select(
        "conv_id", "turn", "blocked", F.array_join("violation_info.policy_id", ",").alias("violated"),
        decided(F.col("grounding_details")).alias("decided"))


@query("experiment_json_sink", f"""{REPLAY_SQL} SELECT conv_id, want AS expected_violation,
 act AS actual_violation, want=act AS success FROM o""")
def experiment_json_sink(spark, sf):
    outcomes = replay(spark, sf)
    path = new_folder(spark, "replay")
    sinks.write_replay_json(M.replay_summary(outcomes), outcomes, path)
    schema = "conv_id long, expected_violation boolean, actual_violation boolean, success boolean"
    return spark.read.schema(schema).json(f"{path}/conversations")
