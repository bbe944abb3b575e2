"""Work that is dealt to tasks, and what moves between them."""

import pytest
from pyspark.sql import functions as F

from noticewright.catalog import QUERIES


def test_pairs_of_customers_are_made_in_many_tasks(spark, sf):
    assert QUERIES["E17_interest_match"](spark, sf).select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("name", ["F13_top_tokens", "F13c_top_tokens_plain", "F13d_top_ten_tokens"])
def test_texts_move_once_and_their_counts_never(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
