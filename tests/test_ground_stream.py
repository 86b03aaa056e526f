"""A stream of messages beside a library of any size, and streams over tables of one file or several."""

from functools import partial

from pyspark.sql import functions as F

from turnwatch.operators.grounding import knn_vote
from turnwatch.plans.similarity import search
from turnwatch.session import new_folder
from turnwatch.streaming import monitor as S
from turnwatch.streaming import ordered as O
from workload.streaming import stream_of


def test_a_large_library_is_searched_in_blocks(spark, monkeypatch):
    rows = spark.range(30).select("id", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.sin(F.col("id") * i).cast("float")).alias("v"))
    library = rows.select((F.col("id") % 2).cast("int").alias("prop"), (F.col("id") % 3 > 0).alias("is_positive"), F.col("id").alias("idx"),
                          F.col("id").alias("anchor_id"), F.col("v").alias("embedding"))
    messages = rows.select(F.col("id").alias("msg_id"), F.array("v").alias("views"))
    source, out = new_folder(spark, "messages"), new_folder(spark, "votes")
    messages.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 2).parquet(source)
    monkeypatch.setattr(S, "search", partial(search, broadcast_values=1, block_rows=8))
    O.ground_to_sink(stream, library, out, new_folder(spark, "votes-state"), 5)
    got = O.read_committed(spark, out, "votes", "msg_id long, prop int, score double, pos_in_k int, batch long").drop("batch").collect()
    want = knn_vote(search(messages, library, 5), 5).select("msg_id", "prop", "score", "pos_in_k").collect()
    assert len(got) == 60 and sorted(got) == sorted(want)


def test_a_table_of_one_file_or_several(spark):
    folder = new_folder(spark, "tables")
    spark.range(10).repartition(3).write.parquet(f"{folder}/many.parquet")
    spark.range(5).coalesce(1).write.parquet(f"{folder}/x")
    one = spark.read.parquet(f"{folder}/x").inputFiles()[0].removeprefix("file://")
    with open(one, "rb") as given, open(f"{folder}/one.parquet", "wb") as out:
        out.write(given.read())
    for name, n in (("many", 10), ("one", 5)):
        drained = new_folder(spark, "drained")
        S.run_to_table(stream_of(spark, folder, name), drained, new_folder(spark, "drained-state"))
        assert spark.read.schema("id long").parquet(drained).count() == n
