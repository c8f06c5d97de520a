import datetime as dt
import random

from marginalia.operators import orphans
from marginalia.operators.orphans import orphan_references, orphan_report, reference_probes

T = dt.datetime(2024, 1, 1)
REFS = "source string, number int, ingested_at timestamp_ntz, deleted_at timestamp_ntz, extra string"
EV = "ev_id bigint, source string, reference_numbers array<int>, created_at timestamp_ntz, at string"
US = "use_id bigint, source string, number int, used_at timestamp_ntz"


def key(s):
    s = s.strip().lower()
    return s[:-4] if s.endswith(".pdf") else s


def brute(refs, probes):
    out = set()
    for table, row, source, number, at in probes:
        if source is None or number is None:
            continue
        live = any(r[0] is not None and r[1] == number and key(r[0]) == key(source) and r[2] is not None and at is not None and r[2] <= at and (r[3] is None or r[3] > at) for r in refs)
        if not live:
            out.add((table, row, number))
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    day = lambda: T + dt.timedelta(days=r.randint(0, 20))
    names = ["a.pdf", " A.PDF ", "a", "b.pdf", "B", None]
    refs = [(r.choice(names), r.choice([1, 2, 3, 4, None]), r.choice([day(), day(), None]), r.choice([None, day()]), "x") for _ in range(60)]
    ev = [(i, r.choice(names), r.choice([None, [], [1, None, 1], [2, 5], [3, 4, 2]]), r.choice([day(), day(), None]), "y") for i in range(80)]
    us = [(i, r.choice(names), r.choice([1, 2, 9, None]), day()) for i in range(80)]
    probes = [("evidence", e[0], e[1], n, e[3]) for e in ev for n in (e[2] or [])] + [("used_refs", u[0], u[1], u[2], u[3]) for u in us]
    p = reference_probes(spark.createDataFrame(ev + ev[:5], EV), spark.createDataFrame(us, US))
    for split in (dict(), dict(parents_per_range=4, probes_per_task=7)):
        got = [tuple(x) for x in orphan_references(spark.createDataFrame(refs, REFS), p, **split).select("ref_table", "row_id", "ref_number").collect()]
        assert len(got) == len(set(got)) and set(got) == brute(refs, probes)


def test_one_key_with_most_references(spark):
    refs = spark.createDataFrame([("hot", 1, T, None, "")], REFS)
    us = spark.range(3000).selectExpr("id AS use_id", "'hot.pdf' AS source", "IF(id % 100 = 0, 2, 1) AS number", "timestamp_ntz '2024-02-01 00:00:00' AS used_at")
    p = reference_probes(spark.createDataFrame([], EV), us)
    assert orphan_references(refs, p, probes_per_task=100).count() == 30


def test_one_key_with_most_parents(spark):
    r = random.Random(5)
    day = lambda: T + dt.timedelta(days=r.randint(0, 300))
    refs = [("hot", 1, d, d + dt.timedelta(hours=r.randint(0, 40)), "") for d in (day() for _ in range(300))] + [("b", 2, T, None, "")]
    us = [(i, "hot.pdf" if i % 3 else "b", 1 if i % 3 else 2, day()) for i in range(200)]
    p = reference_probes(spark.createDataFrame([], EV), spark.createDataFrame(us, US))
    t = spark.createDataFrame(refs, REFS)
    got = [tuple(x) for x in orphan_references(t, p.unionByName(p), parents_per_range=10, probes_per_task=50).select("ref_table", "row_id", "ref_number").collect()]
    want = brute(refs, [("used_refs", u[0], u[1], u[2], u[3]) for u in us])
    assert set(got) == want and len(got) == 2 * len(want)
    kept = orphan_references(t, p, parents_per_range=10, keep_live=True).collect()
    assert len(kept) == 200 and {x.row_id for x in kept if x.reason} == {x[1] for x in want} and {x.reason for x in kept} == {None, "not_live"}


def test_keys_of_one_code_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(orphans, "_key", lambda source, number: number.cast("bigint") % 2)
    refs = [("a", 1, T, None, ""), ("a", 3, T, None, ""), ("b", 2, T, None, "")]
    us = [(i, s, n, T + dt.timedelta(days=1)) for i, (s, n) in enumerate([("a", 1), ("a", 3), ("a", 5), ("b", 2), ("b", 4), ("b", 1), ("a", 2)])]
    p = reference_probes(spark.createDataFrame([], EV), spark.createDataFrame(us, US))
    got = {x.row_id: x.reason for x in orphan_references(spark.createDataFrame(refs, REFS), p).collect()}
    assert got == {2: "missing", 4: "missing", 5: "missing", 6: "missing"}


def test_empty_tables(spark):
    none = reference_probes(spark.createDataFrame([], EV), spark.createDataFrame([], US))
    assert orphan_references(spark.createDataFrame([], REFS), none).count() == 0
    one = reference_probes(spark.createDataFrame([], EV), spark.createDataFrame([(1, "a", 1, T)], US))
    rows = orphan_references(spark.createDataFrame([], REFS), one).collect()
    assert [(x.row_id, x.reason) for x in rows] == [(1, "missing")]


def test_report_counts_everything(spark):
    refs = spark.createDataFrame([("a", 1, T, None, ""), ("a", 2, T, T + dt.timedelta(days=1), "")], REFS)
    p = reference_probes(spark.createDataFrame([], EV), spark.createDataFrame([(i, "a", n, T + dt.timedelta(days=5)) for i, n in enumerate([1, 2, 3])], US))
    r = orphan_report(orphan_references(refs, p, keep_live=True)).collect()
    assert [(x.month, x.n_refs, x.n_orphans, x.n_missing) for x in r] == [("2024-01", 3, 2, 1)]
