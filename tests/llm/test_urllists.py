import datetime as dt
from urllib.parse import urlsplit

import duckdb
import pytest

from sheafline.llm import urllists as U

D = dt.date


def test_given_pages_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(map(str, con.sql(U.OP5_SQL).fetchall()))
    df = U.op5_url_lists(spark, sf)
    got = sorted(str(tuple(r)) for r in df.collect())
    assert df.columns == [x[0] for x in con.sql(U.OP5_SQL).description] and got == want
    assert {r.verdict for r in df.collect()} == {"block", "allow", "none"}
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def brute(captures, entries):
    """The rules by loops."""
    out = []
    for key, url, day in captures:
        s = urlsplit((url or "").split("#")[0])
        keys = []
        if s.scheme and s.hostname:
            labels, steps = s.hostname.split("."), [x for x in s.path.split("/") if x]
            keys += [("domain", ".".join(labels[i:])) for i in range(len(labels) - 1)]
            keys += [("prefix", "/".join([s.hostname, *steps[: i + 1]])) for i in range(len(steps))]
            keys += [("host", s.hostname), ("url", "/".join([s.hostname, *steps]) + ("?" + s.query if s.query else ""))]
        found = []
        for kind, k in keys:
            for name in U.LISTS:
                days = {}
                for e in entries:
                    if e[:3] == (name, kind, k) and None not in e and day and e[3] <= day:
                        days.setdefault(e[3], set()).add(e[4])
                if days and "remove" not in days[max(days)]:
                    found.append((-U.KINDS.index(kind), -len(k), U.LISTS[name] != "allow", name, kind, k, max(days)))
        best = min(found, default=None)
        out.append((key, url, day, "none" if not best else "block" if best[2] else "allow", len(found), *(best[3:] if best else [None] * 4)))
    return sorted(map(str, out))


@pytest.mark.parametrize("rows", [4096, 3])
def test_odd_rows_and_hot_keys(spark, monkeypatch, rows):
    monkeypatch.setattr(U, "RUN_ROWS", rows)
    entries = [("malware", "host", "a.b.org", D(2024, 1, 5), "add"), ("malware", "host", "a.b.org", D(2024, 1, 9), "remove"), ("malware", "host", "a.b.org", D(2024, 1, 20), "add"),
               ("spam", "domain", "b.org", D(2024, 1, 2), "add"), ("spam", "domain", "b.org", D(2024, 1, 2), "add"), ("trusted", "prefix", "a.b.org/x", D(2024, 1, 7), "add"),
               ("trusted", "prefix", "a.b.org/x", D(2024, 1, 8), "add"), ("trusted", "prefix", "a.b.org/x", D(2024, 1, 8), "remove"), ("other", "host", "a.b.org", D(2024, 1, 1), "add"),
               ("spam", "url", "a.b.org/x/y?q=1", D(2024, 1, 3), "add"), ("spam", None, "z", D(2024, 1, 3), "add"), ("spam", "host", "a.b.org", None, "add"), ("trusted", "host", "a.b.org", D(2024, 1, 21), "add")]
    urls = [None, "", "a.b.org/x", "http://a.b.org", "https://A.B.org/x/y?q=1#t", "http://a.b.org/x/", "http://u@a.b.org:80/x/z", "ftp://b.org/?k", "http://localhost/a"]
    captures = [(i, u, D(2024, 1, 1) + dt.timedelta(d)) for i, u in enumerate(urls) for d in range(22)]
    captures += [(3, urls[4], None), (3, urls[4], D(2024, 1, 7)), (3, urls[4], D(2024, 1, 7)), (None, urls[5], D(2024, 1, 7))]
    c = spark.createDataFrame([(*x, 1, "n") for x in captures], "page_id int, url string, fetched_on date, row int, kind string")
    e = spark.createDataFrame([(*x, 0) for x in entries], "list_name string, kind string, key string, listed_on date, action string, row int")
    got = sorted(str(tuple(r)) for r in U.temporal_list_join(c, e, U.LISTS).collect())
    assert got == brute(captures, entries)
    assert U.temporal_list_join(c.limit(0), e, U.LISTS).count() == 0
    assert {r.verdict for r in U.temporal_list_join(c, e.limit(0), U.LISTS).collect()} == {"none"}
