from pyspark.sql import functions as F

from strandwise.sources.tables import table
from strandwise.streaming.events import allowed_messages, appended, first_decision, latest_state, read_stream, routed, run_available, windowed_counts


def test_windowed_counts_equal_batch(spark, sf, tmp_path):
    events = table(spark, sf, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    got = {}

    def keep(batch, number):
        for r in batch.collect():
            got[r.window.start, r.event_type] = r.n

    s = windowed_counts(read_stream(spark, str(tmp_path / "in"), events), "ts", ["event_type"], "1 day", "60 days")
    run_available(s, str(tmp_path / "ck"), keep, "update")
    assert sum(got.values()) == events.count()


def test_first_decision_keeps_one_row_a_key(spark, sf, tmp_path):
    events = table(spark, sf, "events")
    events.write.parquet(str(tmp_path / "in"))
    got = []
    s = first_decision(read_stream(spark, str(tmp_path / "in"), events), ["user_id"], "ts", "90 days")
    run_available(s, str(tmp_path / "ck"), lambda b, n: got.extend(r.user_id for r in b.collect()))
    assert len(got) == len(set(got)) == events.select("user_id").distinct().count()


def test_latest_state_equals_batch(spark, sf, tmp_path):
    events = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    got = {}
    s = latest_state(read_stream(spark, str(tmp_path / "in"), events), ["user_id"], "ts")
    run_available(s, str(tmp_path / "ck"), lambda b, n: got.update({r.user_id: r.event_id for r in b.collect()}), "update")
    want = {r.user_id: r.e for r in events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    assert got == want


def test_messages_are_routed_and_unknown_senders_dropped(spark, tmp_path):
    rows = [(1, "/status"), (1, "https://a.example/x.pdf"), (2, "/status"), (1, "short note"), (1, None), (None, "/status")]
    df = spark.createDataFrame(rows, "chat_id long, text string")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    seen = {"command": [], "submission": []}
    s = allowed_messages(read_stream(spark, str(tmp_path / "in"), df), spark.createDataFrame([(1,), (1,)], "chat_id long"))
    run_available(s, str(tmp_path / "ck"), routed({k: (lambda b, n, k=k: seen[k].extend(r.text for r in b.collect())) for k in seen}))
    assert seen == {"command": ["/status"], "submission": ["https://a.example/x.pdf"]}


def test_weekly_batches_are_added_once(spark, tmp_path):
    weeks = [[("a", 1), ("b", 2)], [("b", 9), ("c", 3)], [("a", 7)]]
    df = spark.createDataFrame([], "id string, n int")
    for w, rows in enumerate(weeks):
        spark.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "table")
    sink = appended(out, F.col("id"), ["n"], lambda b: b.where("n < 9"))
    run_available(read_stream(spark, str(tmp_path / "in"), df), str(tmp_path / "ck"), sink)
    ids = sorted(r.id for r in spark.read.parquet(out).collect())
    sink(spark.read.parquet(str(tmp_path / "in")), 0)
    assert ids == ["a", "b", "c"] == sorted(r.id for r in spark.read.parquet(out).collect())
