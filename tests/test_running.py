from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.operators.running import PAGES, running

rows = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([0, 1, 2, PAGES - 1, PAGES, 3 * PAGES, None]), st.integers(0, 3), st.sampled_from([1, 5, -2, None])), max_size=30, unique_by=lambda r: r[:3])


def brute(data, kind, inclusive):
    out = {}
    for r in data:
        before = sorted((x for x in data if x[0] == r[0]), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        at = before.index(r)
        vals = [x[3] for x in before[: at + inclusive] if x[3] is not None]
        out[r[:3]] = sum(vals) if kind == "sum" else None if not vals else vals[-1] if kind == "last" else min(vals) if kind == "min" else max(vals)
    return out


@settings(max_examples=6, deadline=None)
@given(rows, st.booleans())
def test_equals_plain_windows(spark, data, inclusive):
    df = spark.createDataFrame([(*r, "x") for r in data], "source string, page_number int, pos int, v int, _r string")
    kinds = ("sum", "min", "max", "last")
    got = running(df, {k: (k, F.col("v")) for k in kinds}, inclusive=inclusive)
    assert got.columns == [*df.columns, *kinds]
    found = {(r.source, r.page_number, r.pos): r for r in got.collect()}
    for k in kinds:
        assert {at: r[k] for at, r in found.items()} == brute(data, k, inclusive)
