"""A catalogue published as databases, one for each range of ids, that any executor reads over JDBC.

An embedded database belongs to the process that has opened it, but one in an archive is
only read, by any number of processes. So each range of ids becomes a Derby database of
its own: a task hands its rows to Derby's bulk import and puts the archive into the
folder that driver and executors share. Scans are those of Spark's JDBC source, a
database a partition, and ask a database for the columns and filters that are asked
of the table. Neither rows nor databases pass through the driver.
"""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import shared_dir, written

COLUMNS = ("id", "pitch_track", "title", "raga", "tala")
DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
#: Rows of a range, and the least and most ranges; beyond these a range has more rows.
ROWS, LEAST, MOST = 100_000, 4, 64

_LOAD = """CONNECT 'jdbc:derby:tracks;create=true';
CREATE TABLE tracks ("id" BIGINT, "pitch_track" BLOB, "title" CLOB, "raga" CLOB, "tala" CLOB);
CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'TRACKS', 'rows.csv', NULL, NULL, 'UTF-8', 0);
CREATE INDEX by_id ON tracks ("id");
SELECT 'loaded ' || TRIM(CAST(count(*) AS CHAR(20))) FROM tracks;
CONNECT 'jdbc:derby:;shutdown=true';
"""


def quiet(spark: SparkSession) -> None:
    """The driver's Derby writes no log file."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.field", "java.lang.System.err")


def _local(folder: str) -> str:
    """The path of a mounted folder, which is all that Derby can open."""
    if re.match(r"(?!file:)[A-Za-z][\w+.-]*:", folder):
        raise ValueError(f"databases are opened by path, so the shared folder must be mounted: {folder}")
    return re.sub(r"^file:/*", "/", folder)


def _field(v: str | bytes | None) -> str:
    """A field of Derby's import: nothing for null, binary as hexadecimal digits."""
    return "" if v is None else f'"{v.hex() if isinstance(v, bytes) else v.replace(chr(34), 2 * chr(34))}"'


def publish(catalogue: DataFrame, ranges: int | None = None) -> list[dict[str, str]]:
    """Write (id, pitch_track, title, raga, tala) as databases, one for each range of ids;
    options of the JDBC source for each of them. ``ranges`` follows from the rows if not given."""
    spark = catalogue.sparkSession
    quiet(spark)
    folder = f"{_local(shared_dir(spark))}/tracks-{uuid.uuid4().hex}"
    home = spark._jvm.java.lang.System.getProperty("java.home")
    text = [F.col(c).cast("string").alias(c) for c in COLUMNS[2:]]
    rows = written(catalogue.select(F.col("id").cast("long").alias("id"), F.col("pitch_track").cast("binary").alias("pitch_track"), *text), "catalogue")
    if ranges is None:
        ranges = min(MOST, max(LEAST, -(-rows.count() // ROWS)))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as at:
            at, n = os.path.realpath(at), 0
            with open(f"{at}/rows.csv", "w", encoding="utf-8", newline="") as f:
                for batch in batches:
                    n += batch.num_rows
                    for i, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        f.write(",".join(["" if i is None else str(i), *map(_field, rest)]) + "\n")
            if not n:
                return
            with open(f"{at}/load.sql", "w") as f:
                f.write(_LOAD)
            jars = f"{os.environ.get('SPARK_HOME') or os.path.dirname(pyspark.__file__)}/jars"
            java = f"{home}/bin/java" if os.path.exists(f"{home}/bin/java") else "java"
            done = subprocess.run([java, "-Xmx256m", "-XX:+UseSerialGC", "-Dderby.stream.error.file=log", "-cp", f"{jars}/*", "org.apache.derby.tools.ij", "load.sql"], cwd=at, capture_output=True, text=True)
            if not re.search(rf"^loaded {n}\s*$", done.stdout, re.M):
                raise RuntimeError(f"{n} rows were not loaded: {done.stdout[-2000:]}{done.stderr[-2000:]}")
            # whole archives alone have the name that is told, whichever attempt made them
            os.makedirs(folder, exist_ok=True)
            name = f"{folder}/{uuid.uuid4().hex}"
            with zipfile.ZipFile(f"{name}.part", "w", zipfile.ZIP_STORED) as z:
                for top, _, files in os.walk(f"{at}/tracks"):
                    for x in files:
                        if not x.endswith(".lck"):
                            z.write(f"{top}/{x}", os.path.relpath(f"{top}/{x}", at))
            os.rename(f"{name}.part", f"{name}.jar")
        yield pa.record_batch([pa.array([f"{name}.jar"])], ["path"])

    made = rows.repartitionByRange(ranges, "id").mapInArrow(load, "path string").collect()  # a path for each range
    return [{"url": f"jdbc:derby:jar:({r['path']})tracks", "driver": DRIVER} for r in made]


def scan(spark: SparkSession, databases: list[dict[str, str]], table: str = "tracks") -> DataFrame:
    """The rows of all ``databases``, read over JDBC, a partition each."""
    if not databases:
        return spark.createDataFrame([], "id long, pitch_track binary, title string, raga string, tala string")
    return reduce(DataFrame.union, [spark.read.format("jdbc").options(**o).option("dbtable", table).load() for o in databases])
