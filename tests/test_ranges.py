"""The catalogue as databases, one for each range of ids, read over JDBC by other processes."""

import subprocess
import sys

import pytest

from humsearch.sources import catalog, packed, ranges

KIND = "id long, pitch_track binary, title string, raga string, tala string"


def test_rows_come_back(spark):
    blob = bytearray(packed.encode([100.0, None]))
    odd = ["", None, 'a "b", c', "two\nlines\r\n", "NULL", "é漢\U0001f600", " x ", "\\N", "'", "long " * 20_000]
    rows = [(k, blob if k % 3 else None, t, odd[-1 - k], "x") for k, t in enumerate(odd)] + [(2**62, bytearray(b""), "t", None, None), (-5, bytearray(b"\x00\xff\n"), "t", "", "")]
    databases = ranges.publish(spark.createDataFrame(rows, KIND), 3)
    table = ranges.scan(spark, databases)
    assert len(databases) == 3 == table.rdd.getNumPartitions() and table.dtypes == [tuple(c.split()[:1] + [dict(long="bigint").get(c.split()[1], c.split()[1])]) for c in KIND.split(", ")]
    assert sorted(map(tuple, table.collect()), key=lambda r: r[0]) == sorted(rows, key=lambda r: r[0])
    found = catalog.metadata(table, [3, 5])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {r["id"] for r in found.collect()} == {3, 5} and "In(id, [3,5])" in plan and "pitch_track" not in plan.split("ReadSchema")[1]


def test_no_rows(spark):
    assert ranges.scan(spark, ranges.publish(spark.createDataFrame([], KIND))).count() == 0


def test_folder_must_be_mounted():
    assert ranges._local("file:///a/b") == ranges._local("file:/a/b") == ranges._local("/a/b") == "/a/b"
    with pytest.raises(ValueError, match="mounted"):
        ranges._local("hdfs://x/a")


CLUSTER = """
import sys
from pyspark.sql import SparkSession, functions as F
from humsearch.plans.queries import QUERIES

conf = {"spark.ui.enabled": "false", "spark.checkpoint.dir": "file://" + sys.argv[2], "spark.executor.memory": "600m", "spark.sql.shuffle.partitions": "4"}
spark = SparkSession.builder.master("local-cluster[2,1,600]").config(map=conf).getOrCreate()
print("ROWS", *QUERIES["catalogue_over_jdbc"](spark, sys.argv[1]).agg(F.count("*"), F.sum("frames")).first())
"""


def test_other_processes_read_them(sf_dir, tmp_path):
    done = subprocess.run([sys.executable, "-c", CLUSTER, sf_dir, str(tmp_path)], capture_output=True, text=True, timeout=240)
    assert "ROWS 15 1000" in done.stdout, done.stderr[-2000:]
