import re

import __spark_entry__ as entry


def test_one_query_for_each_operator():
    numbers = sorted(int(m[1]) for q in entry.queries() if (m := re.match(r"op(\d+)_", q)))
    assert numbers == list(range(1, 11)) and "pipeline" in entry.queries()
