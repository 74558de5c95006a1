"""with_validity against a brute-force Python LEAD on generated histories."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakebuild.operators import with_validity

OPEN = dt.datetime(9999, 12, 31)
BASE = dt.datetime(2020, 3, 8)  # includes a US spring-forward day

row = st.tuples(st.sampled_from(["a", "b", "hot", None]),
                st.one_of(st.none(), st.integers(0, 72).map(lambda h: BASE + dt.timedelta(hours=h))),
                st.integers(0, 3))


def brute(rows):
    out = []
    by_key = {}
    for i, (k, ts, v) in enumerate(rows):
        by_key.setdefault(k, []).append((ts, v, i))
    for k, items in by_key.items():
        # NULL starts first, then start, then tie-break (v, id)
        items.sort(key=lambda t: (t[0] is not None, t[0] or BASE, t[1], t[2]))
        for j, (ts, v, i) in enumerate(items):
            nxt = items[j + 1][0] if j + 1 < len(items) else None
            end = nxt if nxt is not None else OPEN
            out.append((k, ts, v, i, end, end == OPEN))
    return sorted(out, key=lambda t: t[3])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=40))
def test_with_validity_matches_brute_force(spark, rows):
    df = spark.createDataFrame([(k, ts, v, i) for i, (k, ts, v) in enumerate(rows)],
                               "k string, ts timestamp_ntz, v int, id int")
    got = sorted((tuple(r) for r in with_validity(df, "k", "ts", ["v", "id"], split="hour").collect()),
                 key=lambda t: t[3])
    assert got == brute(rows)
