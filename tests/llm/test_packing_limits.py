"""Limits that no piece can keep are refused."""

import pytest

from tallyspring.llm.packing import pack


@pytest.mark.parametrize("limit", ["max_tokens", "max_segments", "max_loss"])
@pytest.mark.parametrize("value", [0, -1])
def test_limits_under_one(spark, limit, value):
    docs = spark.createDataFrame([(1, "text")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="no room"):
        pack(docs, "unread.json", **{limit: value})
