"""Streams over the given tables, drained into written tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwatch.operators import monitor as M
from turnwatch.operators.resume import judge_from
from turnwatch.session import new_folder
from turnwatch.streaming import monitor as S
from turnwatch.streaming import ordered as O
from workload.grounding import KNN_SQL, POOL_SQL, vector_library
from workload.registry import query, table
from workload.temporal import LONG_SQL, POLICIES, V_SQL, lexical_tests, region_propositions


def stream_of(spark, sf, name):
    """A table as a stream, be it one file or a folder of files: a pattern finds either, a plain path must be a folder."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def conversation_stream(spark, sf):
    return stream_of(spark, sf, "conversations")


def shuffled_stream(spark, sf):
    """The same messages from many files that arrive one by one, out of turn order."""
    path = new_folder(spark, "arrivals")
    table(spark, sf, "conversations").repartition(5, F.xxhash64("conv_id", "turn")).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, stream, name):
    out = new_folder(spark, name)
    S.run_to_table(stream, out, new_folder(spark, f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(out)


def verdicts(stream, version="v1"):
    labelled = M.lexical_labels(stream, lexical_tests()).withColumn("version", F.lit(version))
    return S.stream_monitor(labelled, POLICIES)


FAILED_SQL = """SELECT conv_id, turn, passed, array_to_string(list_filter(['a','b','c'],
 lambda p: (p='a' AND NOT ok_a) OR (p='b' AND NOT ok_b) OR (p='c' AND NOT ok_c)), ',') AS failed FROM vv"""


@query("stream_monitor", f"WITH {V_SQL} {FAILED_SQL}")
def stream_monitor(spark, sf):
    out = drain(spark, verdicts(conversation_stream(spark, sf)), "verdicts")
    return out.select("conv_id", "turn", "passed", F.array_join("failed", ",").alias("failed"))


@query("stream_ordering", f"WITH {V_SQL} {FAILED_SQL}")
def stream_ordering(spark, sf):
    out = drain(spark, verdicts(shuffled_stream(spark, sf)), "ordered")
    return out.select("conv_id", "turn", "passed", F.array_join("failed", ",").alias("failed"))


@query("stream_violations", f"""WITH {V_SQL}, {LONG_SQL} SELECT conv_id, turn, policy_id FROM l WHERE NOT ok AND NOT was""")
def stream_violations(spark, sf):
    alerts = S.stream_violations(verdicts(conversation_stream(spark, sf)))
    return drain(spark, alerts, "alerts").select("conv_id", "turn", "policy_id")


CHANGE_SQL = V_SQL.replace("PARTITION BY conv_id", "PARTITION BY conv_id, turn>=4")


@query("stream_policy_change", f"""WITH {CHANGE_SQL} SELECT CASE WHEN turn>=4 THEN 'v2' ELSE 'v1' END AS version, conv_id, turn, passed FROM vv""")
def stream_policy_change(spark, sf):
    """A new policy set takes over at turn four and starts with fresh state."""
    late = F.col("turn") >= 4
    stream = M.lexical_labels(conversation_stream(spark, sf), lexical_tests()) \
        .withColumn("version", F.when(late, "v2").otherwise("v1")) \
        .withColumn("first_turn", F.when(late, 4).otherwise(0))
    return drain(spark, S.stream_monitor(stream, POLICIES), "versions").select("version", "conv_id", "turn", "passed")


@query("stream_pairs", """SELECT conv_id, turn, prop_id FROM conversations JOIN
 (SELECT lower(r_name) AS prop_id, CASE WHEN r_regionkey < 2 THEN 'user' ELSE 'assistant' END AS role FROM region) USING (role)""")
def stream_pairs(spark, sf):
    pairs = S.stream_pairs(conversation_stream(spark, sf), region_propositions(spark, sf))
    return drain(spark, pairs.select("conv_id", "turn", "prop_id"), "pairs")


@query("stream_ground", f"""WITH {POOL_SQL.replace('ON lib.anchor_id <> q.msg_id', 'ON true')}, {KNN_SQL}
 SELECT msg_id, prop, pos_in_k, round(score,6) AS score FROM knn""")
def stream_ground(spark, sf):
    messages = stream_of(spark, sf, "embeddings").select(F.col("vec_id").alias("msg_id"), F.array("embedding", F.reverse("embedding")).alias("views"))
    out = new_folder(spark, "votes")
    O.ground_to_sink(messages, vector_library(spark, sf), out, new_folder(spark, "votes-state"))
    return O.read_committed(spark, out, "votes", "msg_id long, prop int, score double, pos_in_k int, batch long").select(
        "msg_id", "prop", "pos_in_k", F.round("score", 6).alias("score"))


# -- turns in order, states that go on, outputs written once -------------------------------------


def drain_turns(spark, stream, out, state):
    with O.state_store(spark):
        S.run_to_table(stream, out, state)


LATE_SQL = V_SQL.replace("FROM conversations", """FROM (SELECT * FROM conversations c WHERE NOT (conv_id % 3 = 0 AND turn = 2
 AND EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn > 2)))""")
HELD_SQL = """held AS (SELECT conv_id FROM conversations WHERE conv_id % 3 = 0 GROUP BY conv_id HAVING max(turn) > 2 AND bool_or(turn = 2))"""


@query("stream_late_turns", f"""WITH {LATE_SQL}, {HELD_SQL}, o AS (
 SELECT conv_id, turn, turn AS until, 'ok' AS status, passed FROM vv
 UNION ALL SELECT conv_id, 2, 2, s, false FROM held, (VALUES ('skipped'), ('late')) t(s)
 UNION ALL SELECT conv_id, turn, turn, 'repeated', false FROM conversations WHERE conv_id % 3 = 0 AND turn = 0)
 SELECT 'c' || conv_id AS conv, turn::BIGINT AS turn, until::BIGINT AS until, status, passed FROM o""")
def stream_late_turns(spark, sf):
    """In every third conversation the third turn comes after the others were judged, and the first comes again. The
    query stops in between and goes on from its state."""
    rows = table(spark, sf, "conversations")
    third = F.col("conv_id") % 3 == 0
    source, out, state = new_folder(spark, "arrivals"), new_folder(spark, "turns"), new_folder(spark, "turns-state")
    for part in (rows.filter(~(third & (F.col("turn") == 2))), rows.filter(third & F.col("turn").isin(0, 2))):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source).withColumn("conv", F.concat(F.lit("c"), "conv_id"))
        turns = O.ordered_monitor(M.lexical_labels(stream, lexical_tests()), POLICIES, key=["conv"], max_early=0)
        drain_turns(spark, turns, out, state)
    told = spark.read.schema(turns.schema).parquet(out)
    return told.select("conv", "turn", F.coalesce("until", "turn").alias("until"), "status", F.coalesce("passed", F.lit(False)).alias("passed"))


@query("monitor_resume", f"""WITH {V_SQL} SELECT conv_id, turn, ok_a, ok_b, ok_c, was_a, was_b, was_c, passed FROM vv""")
def monitor_resume(spark, sf):
    """Three runs, each over the turns that came since, from a state that was written and read again."""
    rows = M.lexical_labels(table(spark, sf, "conversations"), lexical_tests())
    state, out = None, None
    for upto in (2, 5, None):
        given = rows if upto is None else rows.filter(F.col("turn") < upto)
        verdicts, after = judge_from(given, POLICIES, "conv_id", "turn", state)
        verdicts = verdicts.select("conv_id", "turn", *[f"{w}_{p.policy_id}" for w in ("ok", "was") for p in POLICIES], "passed")
        out = verdicts if out is None else out.unionByName(verdicts)
        if upto:
            folder = new_folder(spark, "bits")
            after.write.parquet(folder)
            state = spark.read.parquet(folder)
    return out


@query("stream_resume", f"WITH {V_SQL}, f AS ({FAILED_SQL}) SELECT conv_id, turn, passed, failed FROM f WHERE turn >= 3")
def stream_resume(spark, sf):
    """A stream goes on from the state that a batch over the first turns left."""
    rows = M.lexical_labels(table(spark, sf, "conversations"), lexical_tests())
    _, state = judge_from(rows.filter("turn < 3"), POLICIES, "conv_id", "turn")
    stream = M.lexical_labels(conversation_stream(spark, sf), lexical_tests()).filter("turn >= 3")
    turns = O.ordered_monitor(stream, POLICIES, key=["conv_id"], state=state)
    out = new_folder(spark, "resumed")
    drain_turns(spark, turns, out, new_folder(spark, "resumed-state"))
    return spark.read.schema(turns.schema).parquet(out).select("conv_id", "turn", "passed", F.array_join("failed", ",").alias("failed"))


@query("stream_alert_sink", f"""WITH {V_SQL}, {LONG_SQL} SELECT conv_id, turn, policy_id FROM l WHERE NOT ok AND NOT was""")
def stream_alert_sink(spark, sf):
    """Alerts of turns that arrive out of order, from a sink that writes each batch of two outputs once."""
    labelled = M.lexical_labels(shuffled_stream(spark, sf), lexical_tests())
    turns = O.ordered_monitor(labelled, POLICIES, key=["conv_id"])
    out = new_folder(spark, "sink")
    O.run_to_sink(turns, out, new_folder(spark, "sink-state"))
    return O.read_committed(spark, out, "alerts", "conv_id long, turn long, policy_id string, batch long").select("conv_id", "turn", "policy_id")
