import re

import __spark_entry__


def test_ten_queries_and_the_pipeline_are_registered():
    names = list(__spark_entry__.queries())
    assert [sum(bool(re.match(f"op{n}_", x)) for x in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert {"op5_top_k", "op9_url_filter"} <= set(__spark_entry__.oracle_sql())
