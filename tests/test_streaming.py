"""Streams that are stopped and go on, and state that says what a window over the table says."""

import os

import pytest
from pyspark.sql import functions as F

from kasauti.operators import campaign
from kasauti.sources import tables
from kasauti.streaming import rolling, verification

from .compare import SMALL

RECORDS = "row_id long, attack_id string, adversarial_claim string, adversarial_evidence string, injected_evidence_workaround boolean, skip_reason string"
ADD, SWAP = "EA_ADVADD_01_AdvAdd", "CA_CHAR_01_CharacterSwapping"


@pytest.fixture
def run(spark, tmp_path):
    claims = spark.createDataFrame([(i, f"c{i}", f"e{i}", "SUP" if i % 3 else "REF") for i in range(40)], "row_id long, claim string, evidence string, label string")
    rows = [(i, a, None if a == ADD else f"x{i}", f"fake{i}" if a == ADD else None, a == ADD, "why" if i == 7 else None) for i in range(42) for a in (ADD, SWAP)]
    source = str(tmp_path / "records")
    for k in range(4):
        # The last file repeats the first one's records, and a record of its own twice.
        some = rows[k * 21 : (k + 1) * 21] + (rows[:21] + rows[70:71] if k == 3 else [])
        spark.createDataFrame(some, RECORDS).coalesce(1).write.mode("append").parquet(source)
    clean, asked = campaign.baseline(claims, campaign.mock_verifier), []

    def verify(df):
        asked.append([tuple(r) for r in df.select("row_id", "attack_id").collect()])
        return campaign.results(df, claims, tables.attacks(spark), clean, campaign.mock_verifier, campaign.mock_judge)

    whole = sorted(map(repr, map(tuple, verify(spark.createDataFrame(rows, RECORDS)).collect())))
    asked.clear()
    return source, str(tmp_path / "table"), str(tmp_path / "checkpoint"), verify, asked, whole


def rows_of(spark, table):
    return sorted(map(repr, map(tuple, verification.read_results(spark, table).drop("batch").collect())))


def test_stopped_between_batches_and_resumed(spark, run):
    source, table, checkpoint, verify, asked, whole = run

    def breaks(df):
        if len(asked) == 2:
            raise RuntimeError("stopped")
        return verify(df)

    records = verification.read_records(spark, source, RECORDS, 1)
    assert verification.read_results(spark, table) is None
    with pytest.raises(Exception, match="stopped"):
        verification.verify_stream(records, breaks, table, checkpoint)
    assert len(asked) == 2 and len(rows_of(spark, table)) == len(asked[0]) + len(asked[1]) < len(whole)
    verification.verify_stream(records, verify, table, checkpoint)
    assert rows_of(spark, table) == whole
    pairs = [p for batch in asked for p in batch]
    assert len(pairs) == len(set(pairs)) == len(whole)
    verification.verify_stream(records, verify, table, checkpoint)  # nothing is left
    assert sum(map(len, asked)) == len(whole)


def test_a_batch_run_again_changes_nothing(spark, run):
    source, table, checkpoint, verify, asked, whole = run
    records = verification.read_records(spark, source, RECORDS, 1)
    verification.verify_stream(records, verify, table, checkpoint)
    last = max(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")  # as if lost between write and commit
    verification.verify_stream(records, verify, table, checkpoint)
    assert rows_of(spark, table) == whole
    # A new checkpoint passes all records again, but verifies none of them.
    before = sum(map(len, asked))
    verification.verify_stream(records.filter("true"), lambda df: verify(df), table + "2", checkpoint + "2")
    assert sum(map(len, asked)) == before + len(whole)
    for batch, k in ((100, 0), (101, 1)):
        verification.verify_batch(spark.read.schema(RECORDS).parquet(source), batch, verify, table)
        assert asked[-1] == []
    assert rows_of(spark, table) == whole


def run_to(spark, df, name, checkpoint):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_rolling_rates_are_those_of_a_window(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("value") >= 50).alias("hit"))
    events = events.orderBy("ts", "event_id")
    rows = events.toPandas()
    source = str(tmp_path / "events")
    for k in range(3):  # in order of time, as they would arrive
        part = rows.iloc[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = run_to(spark, rolling.rolling_rates(stream, "3650 days"), "rolled", str(tmp_path / "c"))
    plain = lambda df: sorted((r["key"], r["event_id"], r["tries"], r["hits"], round(r["rate"], 9), r["closed"]) for r in df.collect())
    assert plain(got) == plain(rolling.prefix_rates(events)) and got.count() == len(rows) > 0


def test_an_idle_key_is_closed_and_starts_anew(spark, tmp_path):
    rows = [[("a", 0, 1, True), ("a", 1, 2, False), ("b", 0, 3, True)], [("b", 100, 4, True)], [("b", 200, 5, False), ("a", 200, 6, True)]]
    source, schema = str(tmp_path / "events"), "key string, ts timestamp, event_id long, hit boolean"
    for part in rows:
        df = spark.createDataFrame(part, "key string, s long, event_id long, hit boolean")
        df.select("key", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), "event_id", "hit").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = run_to(spark, rolling.rolling_rates(stream, "0 seconds", 50_000), "idle", str(tmp_path / "c")).collect()
    assert [(r["tries"], r["hits"]) for r in got if r["key"] == "a" and not r["closed"]] == [(1, 1), (2, 1), (1, 1)]
    closed = [(r["key"], r["tries"], r["hits"], r["event_id"]) for r in got if r["closed"]]
    assert sorted(closed) == [("a", 2, 1, None), ("b", 1, 1, None), ("b", 1, 1, None)]
