import json

import pytest
from pyspark.sql import functions as F

from paywatch.operators import features
from paywatch.streaming import events as live
from paywatch.streaming import log
from paywatch.streaming.velocity import VelocityJob

COLUMNS = ["txn_count_1h", "txn_count_24h", "txn_count_7d", "amount_sum_1h", "amount_sum_24h"]
SCHEMA = "txn_id bigint, account_id string, amount double, timestamp timestamp"


def write_parts(txn, folder, parts):
    """Consecutive files in time order, so that each is one micro-batch."""
    rows = txn.select("txn_id", "account_id", "amount", "timestamp").orderBy("timestamp", "txn_id").collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = txn.sparkSession.createDataFrame(rows[i * size:(i + 1) * size], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(folder))
        txn.sparkSession.read.parquet(str(folder)).count()


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_velocity_over_micro_batches_equals_batch(spark, sf_dir, tmp_path):
    from paywatch.sources import testdata

    # Seconds are made unique per account, as a row does not see later micro-batches.
    txn = testdata.transactions(spark, sf_dir).withColumn("account_id", (F.col("account_id") % 3).cast("string"))
    txn = txn.withColumn("timestamp", F.date_trunc("second", "timestamp")).dropDuplicates(["account_id", "timestamp"])
    write_parts(txn, tmp_path / "in", 4)
    job = VelocityJob(str(tmp_path / "job"))
    query = job.run(stream_of(spark, tmp_path / "in"))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows]) == 4
    want = features.rolling_features(txn).select("txn_id", *COLUMNS)
    got = job.result(spark).select("txn_id", *COLUMNS)
    assert sorted(got.collect()) == sorted(want.collect())


def add_file(txn, folder):
    txn.select("txn_id", "account_id", "amount", "timestamp").coalesce(1).write.mode("append").parquet(str(folder))


def test_restarted_job_goes_on_from_its_state(spark, make_txn, tmp_path):
    txn = make_txn([{"at": i * 600, "amount": 0.1 * i, "account_id": f"A{i % 2}"} for i in range(12)])
    add_file(txn.filter("txn_id < 6"), tmp_path / "in")
    VelocityJob(str(tmp_path / "job")).run(stream_of(spark, tmp_path / "in")).awaitTermination()
    add_file(txn.filter("txn_id >= 6"), tmp_path / "in")
    job = VelocityJob(str(tmp_path / "job"))
    job.run(stream_of(spark, tmp_path / "in")).awaitTermination()
    want = features.rolling_features(txn).select("txn_id", *COLUMNS)
    assert sorted(job.result(spark).select("txn_id", *COLUMNS).collect()) == sorted(want.collect())


def test_only_accounts_of_a_batch_are_touched(spark, make_txn, tmp_path):
    txn = make_txn([{"at": i, "account_id": f"A{i}"} for i in range(40)] + [{"at": 100, "account_id": "A3"}])
    add_file(txn.filter("txn_id < 40"), tmp_path / "in")
    add_file(txn.filter("txn_id = 40"), tmp_path / "in")
    query = VelocityJob(str(tmp_path / "job")).run(stream_of(spark, tmp_path / "in"))
    query.awaitTermination()
    told = [p.stateOperators[0] for p in query.recentProgress if p.numInputRows]
    assert [(t.numRowsUpdated, t.numRowsTotal) for t in told] == [(40, 40), (1, 40)]


def test_late_rows_are_dropped_and_old_state_goes(spark, make_txn, tmp_path):
    month = 30 * 86400
    txn = make_txn([{"at": 100_000}, {"at": 99_000}, {"at": month, "account_id": "B"}, {"at": 10}, {"at": month + 5}])
    for i in range(5):
        add_file(txn.filter(F.col("txn_id") == i), tmp_path / "in")
    job = VelocityJob(str(tmp_path / "job"), delay=3600)
    query = job.run(stream_of(spark, tmp_path / "in"))
    query.awaitTermination()
    assert sorted((r.txn_id, r.txn_count_1h) for r in job.result(spark).collect()) == [(0, 1), (1, 1), (2, 1), (4, 1)]
    assert sum(p.stateOperators[0].numRowsRemoved for p in query.recentProgress) == 1


def test_rows_without_account_or_amount(spark, make_txn, tmp_path):
    txn = make_txn([{"account_id": None}, {"account_id": None, "at": 1}, {"at": 2, "amount": None}, {"at": 3, "amount": float("nan")}, {"at": 4}])
    add_file(txn, tmp_path / "in")
    job = VelocityJob(str(tmp_path / "job"))
    job.run(stream_of(spark, tmp_path / "in")).awaitTermination()
    got = {r.txn_id: (r.txn_count_1h, r.amount_sum_1h) for r in job.result(spark).collect()}
    assert got == {0: (1, 100.0), 1: (1, 100.0), 2: (1, 0.0), 3: (2, 0.0), 4: (3, 100.0)}


def test_json_events(spark, tmp_path):
    folder = tmp_path / "topic"
    folder.mkdir()
    lines = [
        json.dumps({"txn_id": f"T{i}", "account_id": "A", "amount": 9500.0 * i, "txn_type": "PAYMENT",
                    "channel": "ONLINE", "timestamp": "2024-01-01T00:00:00"})
        for i in range(3)
    ]
    (folder / "part").write_text("\n".join([*lines, "not json"]))
    stream = live.read_events(spark, "files", {"path": str(folder)})
    vectors = live.with_defaults(stream).withColumns(
        {"txn_risk_score": F.lit(0.9), "behavior_anomaly_score": F.lit(0.2)}
    )
    got = live.drained(live.decide_events(vectors), "json").orderBy("txn_id").collect()
    assert [(r.alert_id, r.final_risk_score, r.action) for r in got] == [
        (f"ALT_RT_T{i}", 0.5, "ALLOW_WITH_MONITORING") for i in range(3)
    ]
    assert [r.reason_codes for r in got] == [
        ["ELEVATED_RISK_SCORE"], ["ELEVATED_RISK_SCORE", "STRUCTURING_PATTERN"], ["ELEVATED_RISK_SCORE", "STRUCTURING_PATTERN"],
    ]


def test_defaults_give_way_to_account_features(spark, make_txn):
    known = spark.createDataFrame([("A1", 7)], "account_id string, account_degree bigint")
    rows = live.with_defaults(make_txn([{}, {"account_id": "Z"}]), known).orderBy("txn_id").collect()
    assert [(r.account_degree, r.txn_count_1h, r.amount_sum_1h) for r in rows] == [(7, 1, 100.0), (0, 1, 100.0)]


def test_limits(spark):
    with pytest.raises(ValueError):
        live.latest_alerts(spark.range(1), 1001)


def test_volume_ends_windows_and_counts_late_events(spark, make_txn, tmp_path):
    hours = [0, 30, 3600, 5 * 3600, 5 * 3600 + 60, 60, 7 * 3600]  # the sixth event is late by hours
    txn = make_txn([{"at": at} for at in hours])
    for i in range(len(hours)):
        add_file(txn.filter(F.col("txn_id") == i), tmp_path / "in")
    job = live.VolumeJob(str(tmp_path / "job"), by="account_id")
    job.run(stream_of(spark, tmp_path / "in")).awaitTermination()
    got = job.result(spark).select(F.hour("window_start").alias("h"), "event_count", "late_count").collect()
    assert sorted(map(tuple, got)) == [(0, 3, 1), (1, 1, 0), (5, 2, 0), (7, 1, 0)]
    # Only what the watermark has not passed is still held.
    assert [r["_start"] % 86400 // 3600 for r in job.open_windows(spark).collect()] == [7]


def test_replayed_volume_batch_writes_the_same(spark, make_txn, tmp_path):
    txn = make_txn([{"at": i * 1800} for i in range(12)] + [{"at": 5}]).withColumn("timestamp", F.when(F.col("txn_id") != 3, F.col("timestamp")))
    job = live.VolumeJob(str(tmp_path), by="account_id")
    job.process(txn.filter("txn_id < 8"), 0)
    job.process(txn.filter("txn_id >= 8"), 1)
    before = sorted(map(str, job.result(spark).collect()))
    job.process(txn.filter("txn_id >= 8"), 1)
    assert sorted(map(str, job.result(spark).collect())) == before
    assert job.result(spark).agg(F.sum("event_count"), F.sum("late_count")).first()[:] == (13, 2)


def test_no_input_gives_no_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert live.drained_volume(stream_of(spark, tmp_path / "in"), by="account_id").collect() == []


def append_events(folder, name, ids, rest=""):
    with open(folder / name, "a") as file:
        for i in ids:
            file.write(json.dumps({"txn_id": f"T{i}", "account_id": "Ä", "amount": 1.0 * i, "timestamp": "2024-01-01T00:00:00"}) + "\n")
        file.write(rest)


def test_log_is_read_on_after_a_restart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "PIECE", 150)
    monkeypatch.setattr(log, "TAIL", 40)
    topic = tmp_path / "topic"
    topic.mkdir()

    def run():
        stream = live.read_events(spark, "log", {"path": str(topic)}).select("txn_id", "amount", "timestamp")
        live.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        return sorted(int(r.txn_id[1:]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    append_events(topic, "p0", range(10), rest='{"txn_id": "T10", "acc')
    append_events(topic, "p1", range(20, 30))
    assert run() == [*range(10), *range(20, 30)]
    # The line that was cut off is whole now; files go on and new ones come.
    with open(topic / "p0", "a") as file:
        file.write('ount_id": "A", "amount": 1.0, "timestamp": "2024-01-01T00:00:00"}\nnot json\n')
    append_events(topic, "p1", range(30, 33))
    append_events(topic, "p2", [40])
    assert run() == [*range(11), *range(20, 33), 40]
    assert run() == [*range(11), *range(20, 33), 40]


def test_kafka_needs_its_brokers(spark):
    with pytest.raises(ValueError, match="brokers"):
        live.read_events(spark)


def test_volume_query_counts_every_event(spark, sf_dir):
    import __spark_entry__ as entry_points

    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    counted = entry_points.queries()["streaming_volume"](spark, sf_dir).agg(F.sum("event_count")).first()[0]
    assert counted == events
