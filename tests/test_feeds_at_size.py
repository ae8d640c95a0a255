"""Feeds through documents that together are larger than what tasks may send to the driver."""

import subprocess
import sys
from pathlib import Path

FEEDS = ["feed_of_aircraft", "feed_of_disaster_alerts", "feed_of_natural_events", "feed_of_outages", "feed_of_earthquakes", "feed_of_weather", "feed_of_launches", "feed_of_kp"]

RUN = """
import sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

conf = {"spark.driver.maxResultSize": "256k", "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": sys.argv[1] + "/warehouse"}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__ as entry

k = F.col("id")
kind = F.element_at(F.array(*map(F.lit, ["signup", "purchase", "view", "click", "error"])), (k % 5 + 1).cast("int"))
rows = spark.range(0, 12000, 1, 2).select(k.alias("event_id"), F.timestamp_seconds(1.7e9 + k).alias("ts"), (k % 500).alias("user_id"), kind.alias("event_type"), F.lit(1.5).alias("value"), F.lit("{}").alias("props"))
rows.write.parquet(sys.argv[1] + "/events.parquet")
for name in sys.argv[2:]:
    found = entry.queries()[name](spark, sys.argv[1]).agg(F.count_distinct("record_id" if name != "feed_of_outages" else "method"), F.count(F.lit(1))).first()
    print(name, *found)
spark.stop()
"""


def test_documents_stay_with_the_tasks(tmp_path):
    ran = subprocess.run([sys.executable, "-c", RUN, str(tmp_path), *FEEDS], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=600)
    assert ran.returncode == 0, ran.stderr[-3000:]
    got = {name: (int(a), int(b)) for name, a, b in (line.split() for line in ran.stdout.splitlines() if line.startswith("feed_of_"))}
    placed = {"feed_of_aircraft", "feed_of_launches"}  # an event without a place is no record of these
    assert got == {name: (9600, 9600) if name in placed else (12000, 12000) for name in FEEDS}
