import random
from datetime import datetime, timedelta

import duckdb

from kinfold.llm import urlfilter

T0 = datetime(2024, 1, 1)


def rules(url):
    scheme, _, rest = (url or "").partition("://")
    if not rest or not scheme:
        return [None] * 3
    authority, _, path = rest.partition("/")
    host = authority.split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()
    if not host:
        return [None] * 3
    parts = host.split(".")
    return [f"path:{host}/{path.split('/')[0].split('?')[0].split('#')[0]}", f"host:{host}", "domain:" + ".".join(parts[-3:])]


def brute(url, t, entries):
    """Replay the list up to the fetch time."""
    if t is None:
        return "unlisted", None, None
    for rule in rules(url):
        held, since = {"block": False, "allow": False}, None
        for r, ts, seq, lst, action in sorted((e for e in entries if e[0] is not None and e[1] is not None), key=lambda e: (e[1], e[2])):
            if r == rule and ts <= t:
                held[lst], since = action == "add", seq
        if rule is not None and (held["block"] or held["allow"]):
            return "allowed" if held["allow"] else "blocked", rule, since
    return "unlisted", None, None


def test_verdicts_equal_replaying_the_list(spark):
    rnd = random.Random(2)
    hosts = ["a.example.com", "www.a.example.com", "b.org", "hot.example.net"]
    urls = [f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'de', ''])}/{i}" for i in range(60)]
    urls += [None, "", "nonsense", "HTTPS://u:p@B.ORG:80?x=1", "http:///x", "http://hot.example.net/en/"] + ["http://hot.example.net/en/z"] * 30
    stamp = lambda: T0 + timedelta(minutes=rnd.randrange(0, 60 * 24 * 4, 30))
    captures = [(i, u, None if rnd.random() < 0.05 else stamp()) for i, u in enumerate(urls)]
    pool = sorted({r for u in urls for r in rules(u) if r}) + [None]
    entries = [(rnd.choice(pool), None if rnd.random() < 0.02 else stamp(), i, rnd.choice(["block", "allow"]), rnd.choice(["add", "add", "remove"])) for i in range(150)]
    c = spark.createDataFrame(captures, "id long, url string, fetch_ts timestamp_ntz").selectExpr("*", "1 as day", "2 as host", "3 as start")
    e = spark.createDataFrame(entries, "rule string, ts timestamp_ntz, seq long, list string, action string")
    got = {r.id: (r.verdict, r.rule, r.since_entry) for r in urlfilter.evaluate(c, e).collect()}
    assert got == {i: brute(u, t, entries) for i, u, t in captures}
    assert {v for v, _, _ in got.values()} == {"blocked", "allowed", "unlisted"}
    assert urlfilter.evaluate(c.limit(0), e).count() == 0
    assert {r.verdict for r in urlfilter.evaluate(c, e.limit(0)).collect()} == {"unlisted"}
    assert urlfilter.evaluate(c.unionAll(c), e).count() == 2 * len(captures)


def test_intervals_are_cut_at_day_ends(spark):
    hour = timedelta(hours=1)
    rows = [("r", T0, 1, "block", "add"), ("r", T0, 2, "block", "remove"), ("r", T0 + 50 * hour, 3, "allow", "add"), ("r", T0 + 60 * hour, 4, "block", "add"), ("r", T0 + 120 * hour, 5, "allow", "remove"), ("r", T0 + 999 * hour, 6, "allow", "add")]
    e = spark.createDataFrame(rows, "rule string, ts timestamp_ntz, seq long, list string, action string")
    wanted = spark.createDataFrame([("r", (T0 + timedelta(days=d)).date()) for d in (0, 2, 4, 5, 90)] + [("s", T0.date())], "rule string, day date")
    got = [((r.day - T0.date()).days, r.since, (r.start - T0) / hour, None if r.stop is None else (r.stop - T0) / hour, r.blocks, r.allows) for r in urlfilter.intervals(e, wanted).orderBy("start").collect()]
    assert got == [
        (2, 3, 50, 60, False, True), (2, 4, 60, None, True, True), (4, 4, 96, None, True, True), (5, 5, 120, None, True, False),
        (41, 5, 984, 999, True, False), (41, 6, 999, None, True, True), (90, 6, 2160, None, True, True),
    ]


def test_far_days_make_few_intervals(spark):
    """An entry of the year 1 and a capture of 9999: one day's interval for each day that is asked for."""
    e = spark.createDataFrame([("host:a.b.c", datetime(1, 1, 2), 1, "block", "add")], "rule string, ts timestamp_ntz, seq long, list string, action string")
    c = spark.createDataFrame([(1, "http://a.b.c/x", datetime(9999, 12, 31, 5), "old"), (2, "http://a.b.c/x", datetime(2024, 1, 1), "old")], "id long, url string, fetch_ts timestamp_ntz, verdict string")
    wanted = spark.createDataFrame([("host:a.b.c", datetime(9999, 12, 31).date())], "rule string, day date")
    assert urlfilter.intervals(e, wanted).count() == 2
    out = urlfilter.evaluate(c, e)
    assert out.columns == ["id", "url", "fetch_ts", "verdict", "rule", "since_entry"]
    assert [(r.verdict, r.rule, r.since_entry) for r in out.collect()] == [("blocked", "host:a.b.c", 1)] * 2


def test_sql_gives_the_same(spark, sf_small):
    con = duckdb.connect()
    for t in ("pages", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_small}/{t}.parquet')")
    want = sorted(con.execute(urlfilter.OP1_SQL).fetchall())
    got = urlfilter.op1_query(*(spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("pages", "events")))
    assert got.columns == ["page_id", "url", "verdict", "rule", "since_entry"]
    assert sorted(map(tuple, got.collect())) == want
