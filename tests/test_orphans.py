import datetime as dt

import pytest
from pyspark.sql import functions as F

from weft.operators import orphans as O

REF = "k string, ref string, at timestamp, tab string, verdict string"
REC = "id string, at timestamp, gone boolean, n long"


def t(day, hour=0, month=1):
    return dt.datetime(2024, month, day, hour)


def run(spark, refs, recs, late=True):
    r = O.references(spark.createDataFrame(refs, REF), "x", "k", "ref", "at", late)
    return O.find_orphans(r, spark.createDataFrame(recs, REC), "id", "at", F.col("gone"))


def brute(refs, recs, late=True):
    tidy = lambda x: x.strip(" ").lower() if x else x
    known = {}
    for i, at, gone, _ in recs:
        if tidy(i):
            first, is_gone = known.get(tidy(i), (None, False))
            known[tidy(i)] = (min(x for x in (first, at) if x) if first or at else None, is_gone or bool(gone))
    out = set()
    for k, ref, at, *_ in refs:
        if tidy(ref):
            if tidy(ref) not in known:
                out.add((k, at, "absent"))
            else:
                first, gone = known[tidy(ref)]
                if gone:
                    out.add((k, at, "deleted"))
                elif late and first and at and first > at + dt.timedelta(hours=24):
                    out.add((k, at, "late"))
    return out


@pytest.mark.parametrize("max_heavy", [1000, 3])
def test_against_brute_force(spark, monkeypatch, max_heavy):
    monkeypatch.setattr(O, "MAX_HEAVY", max_heavy)
    recs = [("a", t(1), False, 1), ("a", t(9), False, 1), ("hot", t(20), False, 1), ("b", t(5), True, 1), ("c", None, None, None), (None, t(1), False, 1), ("", t(1), True, 1)]
    refs = [("r1", " A ", t(2), None, None), ("r1", " A ", t(2), None, None), ("r2", "B", t(2), "z", "z"), ("r3", None, t(2), None, None), ("r4", "", t(2), None, None)]
    refs += [("r5", "  ", t(2), None, None), ("r6", "nowhere", None, None, None), ("r7", "c", None, None, None), (None, "gone", t(1, month=2), None, None)]
    refs += [(f"h{i}", "hot", t(1 + i % 28, i % 24), None, None) for i in range(200)] + [("hn", "hot", None, None, None)]
    found = run(spark, refs, recs)
    rows = {(r.row_key, r.loaded_at, r.reason) for r in found.rows.collect()}
    assert rows == brute(refs, recs)
    counts = {}
    for _, at, reason in rows:
        key = (at.strftime("%Y-%m") if at else None, reason)
        counts[key] = counts.get(key, 0) + 1
    assert {(r.period, r.reason): r.orphans for r in found.counts.collect()} == counts
    assert {r.reason for r in run(spark, refs, recs, late=False).rows.collect()} == {"absent", "deleted"}


def test_empty(spark):
    one = [("r", "x", t(1), None, None)]
    assert [r.reason for r in run(spark, one, []).rows.collect()] == ["absent"]
    assert run(spark, [], [("x", t(1), False, 1)]).rows.count() == 0
    assert run(spark, [], []).counts.count() == 0
