"""Large queries make their steps one after the other: what is left at the end reads what was written, not the tables."""

import pytest

from chronolith import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["e17_call_edges", "e7_symbol_lineage", "q6_resolve_target", "e9_followed_symbols", "a20_file_lens"])
def test_only_written_steps_are_left_to_read(spark, query):
    files = plans.QUERIES[query](spark, FOLDER).inputFiles()
    assert files and all("/written-" in f for f in files)
