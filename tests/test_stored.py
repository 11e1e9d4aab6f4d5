"""Queries that use the events many times scan the log once."""

from pyspark.sql import functions as F

from spanframe.plans import QUERIES
from spanframe.plans.registry import STORED
from spanframe.sources.testdata import Model

SF = "/root/testdata/sf0.001"


def test_stored_views_equal_plain_ones(spark):
    plain, kept = Model(spark, SF), Model(spark, SF, stored=True)
    for view in ("events", "fights", "rounds", "excluded", "swaps"):
        a, b = getattr(plain, view), getattr(kept, view)
        assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_no_plan_reads_the_log_again(spark):
    for name in sorted(STORED):
        files = QUERIES[name](spark, SF).inputFiles()
        assert files and not any("/testdata/" in f for f in files), name
    assert QUERIES["A-30"](spark, SF).where(F.lit(True)).inputFiles()
