import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def scan_lines(spark):
    """Findings of one text: a list of (line, column, rule_id, secret)."""
    from keysieve.plans.scan import scan_files

    def run(lines, **options):
        files = spark.createDataFrame(
            [("r", "a.txt", "\n".join(lines))], "repo string, path string, content string")
        found = scan_files(files, context_lines=0, keep_raw=True, **options)
        rows = found.orderBy("line", "pos").collect()
        return [(r.line, r.column, r.rule_id, r.secret_raw) for r in rows]

    return run
