import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SF_DIR = os.environ.get("PAYWATCH_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import __spark_entry__  # noqa: F401  (ships the package to Python workers)

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


TXN = (
    "txn_id bigint, account_id string, merchant_id string, beneficiary_id string, device_id string, "
    "ip_id string, amount double, currency string, txn_type string, channel string, timestamp timestamp, "
    "is_fraud boolean, fraud_scenario string, source string"
)


@pytest.fixture(scope="session")
def make_txn(spark):
    """Transactions from dicts; ``at`` is seconds after 2024-01-01."""
    from pyspark.sql import functions as F

    def make(rows):
        names = [c.split()[0] for c in TXN.split(", ")]
        base = 1704067200
        default = {"amount": 100.0, "currency": "USD", "txn_type": "TRANSFER", "channel": "ONLINE",
                   "is_fraud": False, "source": "A", "account_id": "A1", "device_id": "D1"}
        data = []
        for i, row in enumerate(rows):
            full = {"txn_id": i, **default, **row}
            data.append(tuple(full.get(n) if n != "timestamp" else base + full.get("at", 0) for n in names))
        schema = TXN.replace("timestamp timestamp", "timestamp bigint")
        return spark.createDataFrame(data, schema).withColumn("timestamp", F.timestamp_seconds("timestamp"))

    return make
