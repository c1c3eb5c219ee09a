"""Streaming sources and the scoring, volume and alert jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paywatch.functions.numbers import settle
from paywatch.operators import alerts as alert_views
from paywatch.operators import forest, fusion, model
from paywatch.runtime import scratch_path, settled
from paywatch.schemas import HOUR, STREAM_EVENT
from paywatch.streaming import log

TOPIC = "paywatch.transactions"

# --- fixed values: feature defaults of an event that has no account features ---
DEFAULTS = {
    "txn_count_1h": 1, "txn_count_24h": 1, "txn_count_7d": 1,
    "unique_merchants_7d": 1, "unique_beneficiaries_7d": 1, "unique_devices_30d": 1,
    "amount_vs_30d_avg": 1.0, "amount_vs_30d_max": 1.0, "days_since_last_txn": 0.0,
    "merchant_fraud_rate_hist": 0.0, "account_degree": 0, "device_shared_account_count": 0,
    "beneficiary_in_degree": 0, "num_devices": 1, "num_beneficiaries": 1, "community_size": 1,
    "community_fraud_rate": 0.0, "graph_risk_score": 0.0, "is_new_device": 0,
    "is_new_beneficiary": 0, "ip_is_vpn": 0, "is_fan_out_source": 0, "is_fan_in_target": 0,
    "is_shared_device": 0, "structuring_flag": 0, "is_mule_chain_member": 0, "mcc_risk_tier": "LOW",
}
# --- end of fixed values ---


def parse_events(raw: DataFrame) -> DataFrame:
    """Events from a JSON ``value`` column."""
    event = F.from_json(F.col("value").cast("string"), STREAM_EVENT)
    parsed = raw.select(event.alias("e")).select("e.*").filter(F.col("txn_id").isNotNull())
    return parsed.withColumn("timestamp", F.to_timestamp("timestamp"))


def read_events(
    spark: SparkSession, source: str = "kafka", options: dict[str, str] | None = None
) -> DataFrame:
    """The event stream: a Kafka topic, an append-only JSON log (``log``), or files of JSON lines
    that appear whole in a folder."""
    if source == "kafka":
        settings = {"subscribe": TOPIC, **(options or {})}
        if "kafka.bootstrap.servers" not in settings:
            raise ValueError("name the brokers in kafka.bootstrap.servers")
        return parse_events(spark.readStream.format("kafka").options(**settings).load())
    if source == "log":
        return parse_events(spark.readStream.format(log.register(spark)).options(**(options or {})).load())
    return parse_events(spark.readStream.format("text").options(**(options or {})).load())


def write_log(rows: DataFrame, path: str) -> str:
    """Rows as JSON lines in a folder that the ``log`` source reads; returns its path."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return path


def with_defaults(events: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Feature vector of each event: the account's features where known, else defaults.

    ``features`` is a static table with one row per account (stream-static join).
    """
    if features is not None:
        events = events.join(features, "account_id", "left")
    filled = {"amount_sum_1h": F.col("amount"), "amount_sum_24h": F.col("amount")}
    filled.update({name: F.lit(value) for name, value in DEFAULTS.items()})
    return events.withColumns({
        name: F.coalesce(F.col(name), default) if name in events.columns else default
        for name, default in filled.items()
    })


def realtime_reasons() -> Column:
    return F.array_compact(F.array(
        F.when(F.col("txn_risk_score") > 0.7, "ELEVATED_RISK_SCORE"),
        F.when(F.col("amount") > 9000, "STRUCTURING_PATTERN"),
    ))


def decide_events(scored: DataFrame) -> DataFrame:
    """Fuse both scores of streamed events; a missing score counts as 0."""
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = F.lit(0.50) * known("txn_risk_score") + F.lit(0.25) * known("behavior_anomaly_score")
    if "graph_risk_score" in scored.columns:
        total = total + F.lit(0.25) * F.coalesce("graph_risk_score", F.lit(0.0))
    fused = scored.withColumn("final_risk_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    return fused.select(
        F.concat(F.lit("ALT_RT_"), F.col("txn_id").cast("string")).alias("alert_id"),
        "txn_id", "account_id", "amount", "timestamp",
        settle("txn_risk_score", 4).alias("txn_risk_score"),
        settle("behavior_anomaly_score", 4).alias("behavior_anomaly_score"),
        settle("final_risk_score", 4).alias("final_risk_score"),
        fusion.risk_band("final_risk_score").alias("risk_band"),
        fusion.action("final_risk_score").alias("action"),
        realtime_reasons().alias("reason_codes"),
        F.col("timestamp").alias("triggered_at"),
    )


def score(
    events: DataFrame, risk: PipelineModel, trees: DataFrame, bounds: tuple[float, float],
    features: DataFrame | None = None,
) -> DataFrame:
    """Stateless scoring of a stream with the batch models and the batch anomaly scale."""
    vectors = with_defaults(events, features)
    scored = forest.forest_score(model.risk_score(risk, vectors), trees, bounds)
    return decide_events(scored)


def volume(
    events: DataFrame, window: str = "1 hour", watermark: str | None = "1 hour", by: str = "action"
) -> DataFrame:
    """Events per window and value. Partial sums keep a dominant value cheap.

    Without a watermark no event is too late; the state then holds every window and value.
    """
    timed = events if watermark is None else events.withWatermark("timestamp", watermark)
    return timed.groupBy(F.window("timestamp", window), by).agg(
        F.count(F.lit(1)).alias("event_count")
    ).select(F.col("window.start").alias("window_start"), by, "event_count")


def to_parquet(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True
) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run the stream over all available input and return what it wrote."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = to_parquet(stream, out, scratch_path(spark, f"{name}-log"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


class VolumeJob:
    """Events per window and value, late ones included, with state for open windows only.

    Each micro-batch adds its counts to the open windows. A window that the watermark (the
    newest event of all micro-batches less ``delay``) has passed is written out and forgotten;
    events that still come for it are counted apart, as late. So the state is a few rows
    per open window, and closed counts, open counts and late counts add up to every event.

    Micro-batches write under their own number and keep the open windows in two slots that they
    use in turn, so a replayed one finds what it found before and writes the same again.
    Events without a time belong to no window and are counted with the late ones.
    """

    def __init__(self, folder: str, by: str = "action", window: int = HOUR, delay: int = HOUR):
        self.folder, self.by, self.window, self.delay = folder.rstrip("/"), by, window, delay

    def _counts(self, kind: str) -> str:
        return f"_start bigint, {self.by} {kind}, event_count bigint"

    def process(self, batch: DataFrame, number: int) -> None:
        spark, kind = batch.sparkSession, batch.schema[self.by].dataType.simpleString()
        second = F.unix_timestamp("timestamp")
        start = (F.floor(second / self.window) * self.window).cast("bigint").alias("_start")
        counts = batch.groupBy(start, self.by).agg(F.count(F.lit(1)).alias("event_count"), F.max(second).alias("_newest"))
        counts = settled(counts, "volume-batch")
        newest = counts.agg(F.max("_newest")).first()[0]
        counts = counts.drop("_newest")
        passed = None
        if number:
            known = spark.read.parquet(f"{self.folder}/newest/slot{(number - 1) % 2}").first()[0]
            passed = None if known is None else known - self.delay
            newest = max((x for x in (newest, known) if x is not None), default=None)
            before = spark.read.schema(self._counts(kind)).parquet(f"{self.folder}/open/slot{(number - 1) % 2}")
        else:
            before = spark.createDataFrame([], self._counts(kind))
        end = F.col("_start") + self.window
        late = F.col("_start").isNull() if passed is None else F.col("_start").isNull() | (end <= passed)
        counts.filter(late).write.mode("overwrite").parquet(f"{self.folder}/late/batch={number}")
        now = before.unionByName(counts.filter(~late)).groupBy("_start", self.by).agg(F.sum("event_count").alias("event_count"))
        now = settled(now, "volume-open")
        closed = F.lit(False) if newest is None else end <= newest - self.delay
        now.filter(closed).write.mode("overwrite").parquet(f"{self.folder}/closed/batch={number}")
        now.filter(~closed).write.mode("overwrite").parquet(f"{self.folder}/open/slot{number % 2}")
        spark.createDataFrame([(newest,)], "newest bigint").write.mode("overwrite").parquet(f"{self.folder}/newest/slot{number % 2}")
        self.last, self.kind = number, kind

    def run(self, stream: DataFrame, available_now: bool = True) -> StreamingQuery:
        self.last, self.kind = None, stream.schema[self.by].dataType.simpleString()
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/log")
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def open_windows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self._counts(self.kind)).parquet(f"{self.folder}/open/slot{self.last % 2}")

    def result(self, spark: SparkSession) -> DataFrame:
        """(window_start, value, event_count, late_count): all events so far; late ones are part of the count."""
        counts = self._counts(self.kind)
        zero, own = F.lit(0).cast("bigint").alias("late_count"), F.col("event_count").alias("late_count")
        if self.last is None:  # no input, so nothing was written
            found = spark.createDataFrame([], counts).select("*", zero)
        else:
            written = lambda name: spark.read.schema(counts).parquet(f"{self.folder}/{name}").select("_start", self.by, "event_count")
            found = self.open_windows(spark).select("*", zero).unionByName(written("closed").select("*", zero))
            found = found.unionByName(written("late").select("*", own))
        summed = found.groupBy("_start", self.by).agg(F.sum("event_count").alias("event_count"), F.sum("late_count").alias("late_count"))
        return summed.select(F.timestamp_seconds("_start").alias("window_start"), self.by, "event_count", "late_count")


def drained_volume(stream: DataFrame, by: str = "action", window: int = HOUR, delay: int = HOUR) -> DataFrame:
    """Run over all available input and return the counts."""
    spark = stream.sparkSession
    job = VolumeJob(scratch_path(spark, "volume"), by, window, delay)
    job.run(stream).awaitTermination()
    return job.result(spark)


def latest_alerts(alerts: DataFrame, limit: int = 50, risk_band: str | None = None) -> DataFrame:
    """The bounded view over the alert sink: last ``limit`` alerts, then the band."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    return alert_views.latest(alerts, limit, risk_band)
