import os

import pytest

from tarnbeck.plans import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_debounced_stream_lies_in_a_table(spark):
    streamed = queries.QUERIES["stream_debounce"](spark, FOLDER)
    assert streamed.inputFiles()
    assert sorted(streamed.collect()) == sorted(queries.QUERIES["change_debounce"](spark, FOLDER).collect())
