"""URL filters by a temporal list join.

A filter list is a history: dated entries add rules to a block or an allow list, or remove them. For each rule the
entries become validity intervals, each from one entry to the next, with the state of both lists inside it. A capture is
judged by the intervals that hold at its fetch time, an as-of join for each of the three rules a URL can meet: its host
with the first path segment, its host, its domain. The most specific rule with an active entry decides; on one rule
allow beats block.

Intervals are cut at day ends, so that captures and intervals meet on rule and day and a range comparison is left for
the few intervals of that day. Only the days on which a list entry or a capture names the rule get any, whatever lies
between them. Intervals of a rule do not overlap: each join finds one at most and keeps the captures'
rows. Captures of a hot host are many rows of one key against few intervals; adaptive execution splits such a key or
broadcasts the intervals where they are small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.sitetree import host_of
from kinfold.runtime import materialize

SEGMENT = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]*)"
LEVELS = ("path", "host", "domain")


def rules_of(url: str = "url") -> dict[str, Column]:
    """The three rules a URL can meet, most specific first; null where it has no host. The domain is the last three
    labels of the host, or the host if it has fewer."""
    host = F.nullif(host_of(url), F.lit(""))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)
    return {
        "path": F.concat(F.lit("path:"), host, F.lit("/"), F.regexp_extract(F.col(url), SEGMENT, 1)),
        "host": F.concat(F.lit("host:"), host),
        "domain": F.concat(F.lit("domain:"), F.when(domain == "", host).otherwise(domain)),
    }


def intervals(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(rule, day, since, start, stop, blocks, allows)``: disjoint validity intervals in which a list holds the rule,
    cut at day ends, on the days that have entries and on those of ``wanted(rule, day)``, distinct pairs.

    ``entries`` is ``(rule, ts, seq, list, action)`` with list block or allow and action add or remove. Entries of one
    time count in the order of ``seq``, the last decides. ``since`` is the seq of the entry that opened the state;
    ``stop`` is null where it lasts to the end of the day. Entries with a null rule or time say nothing.

    A day's intervals follow from its own entries and the state it begins with, which follows from one row for each day
    before: a rule with many entries is worked on day by day in many tasks. A day without entries has one interval.
    """
    kind = entries.schema["ts"].dataType.simpleString()
    known = entries.where("rule is not null and ts is not null").withColumn("day", F.to_date("ts"))
    order = F.struct("ts", "seq")
    adds = lambda name: F.when(F.col("list") == name, F.col("action") == "add")
    last = lambda name: F.max_by(adds(name), F.when(F.col("list") == name, order))
    days = known.groupBy("rule", "day").agg(last("block").alias("b"), last("allow").alias("a"), F.max_by("seq", order).alias("seq"), F.min("ts").alias("first"))
    asked = wanted.join(known.select("rule").distinct(), "rule", "left_semi").join(days.select("rule", "day"), ["rule", "day"], "left_anti")
    days = days.unionByName(asked, allowMissingColumns=True)
    by = Window.partitionBy("rule").orderBy("day")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    no = F.lit(False)
    days = materialize(days.select(
        "rule", "day", "first",
        F.coalesce(F.last("b", ignorenulls=True).over(before), no).alias("b0"), F.coalesce(F.last("a", ignorenulls=True).over(before), no).alias("a0"), F.last("seq", ignorenulls=True).over(before).alias("seq0"),
    ), "days")
    own = Window.partitionBy("rule", "day").orderBy("ts", "seq")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    held = lambda name, start: F.coalesce(F.last(adds(name), ignorenulls=True).over(upto), F.col(start))
    inside = known.join(days.select("rule", "day", "b0", "a0"), ["rule", "day"]).select("rule", "day", F.col("seq").alias("since"), F.col("ts").alias("start"), F.lead("ts").over(own).alias("stop"), held("block", "b0").alias("blocks"), held("allow", "a0").alias("allows"))
    midnight = F.col("day").cast(kind)
    opening = days.where("b0 or a0").select("rule", "day", F.col("seq0").alias("since"), midnight.alias("start"), F.col("first").alias("stop"), F.col("b0").alias("blocks"), F.col("a0").alias("allows"))
    return inside.unionByName(opening).where("(blocks or allows) and (stop is null or start < stop)")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetch_ts") -> DataFrame:
    """``captures`` with ``verdict`` (blocked, allowed or unlisted), ``rule`` (what decided) and ``since_entry``.

    A capture without fetch time, URL or host is unlisted. Repeated captures stay. Columns named like the three new ones
    are replaced; others may have any names but those starting with ``_url_``.
    """
    captures = captures.drop(*(c for c in ("verdict", "rule", "since_entry") if c not in (url, fetched)))
    rows = captures.select("*", *[r.alias(f"_url_{k}") for k, r in rules_of(url).items()], F.to_date(fetched).alias("_url_day"))
    pairs = [rows.select(F.col(f"_url_{k}").alias("rule"), F.col("_url_day").alias("day")).where("rule is not null and day is not null").distinct() for k in LEVELS]
    days = materialize(intervals(entries, materialize(reduce(DataFrame.unionAll, pairs), "wanted")), "intervals")
    for k in LEVELS:
        own = days.select(
            F.col("rule").alias(f"_url_{k}"), F.col("day").alias("_url_day"), F.col("start").alias("_url_start"), F.col("stop").alias("_url_stop"),
            F.struct("allows", "rule", "since").alias(f"_url_by_{k}"),
        )
        rows, at = rows.alias("c"), F.col(f"`{fetched}`")
        on = [F.col(f"c._url_{k}") == F.col(f"i._url_{k}"), F.col("c._url_day") == F.col("i._url_day"), F.col("i._url_start") <= at, F.col("i._url_stop").isNull() | (at < F.col("i._url_stop"))]
        rows = rows.join(own.alias("i"), on, "left").select("c.*", f"i._url_by_{k}")
    by = F.coalesce(*[F.col(f"_url_by_{k}") for k in LEVELS])
    verdict = F.when(by["rule"].isNull(), "unlisted").when(by["allows"], "allowed").otherwise("blocked")
    out = rows.withColumn("_url_by", by).select(*[F.col(f"`{c}`") for c in captures.columns], verdict.alias("verdict"), F.col("_url_by.rule").alias("rule"), F.col("_url_by.since").alias("since_entry"))
    return out


def list_from_events(events: DataFrame, pages: DataFrame) -> DataFrame:
    """A list history out of the tables at hand: an event is an entry about the page its user_id numbers, on the rule
    that event_id mod 3 picks; error and signup add to and remove from the block list, purchase and view the allow list."""
    rules = rules_of()
    named = pages.select("page_id", *[r.alias(k) for k, r in rules.items()]).groupBy("page_id").agg(*[F.min(k).alias(k) for k in LEVELS])
    kind = events.where("event_type in ('error', 'signup', 'purchase', 'view')").join(named, F.col("user_id") == F.col("page_id"))
    level = F.pmod(F.col("event_id"), F.lit(3))
    rule = F.when(level == 0, F.col("path")).when(level == 1, F.col("host")).otherwise(F.col("domain"))
    list_ = F.when(F.col("event_type").isin("error", "signup"), "block").otherwise("allow")
    action = F.when(F.col("event_type").isin("error", "purchase"), "add").otherwise("remove")
    return kind.select(rule.alias("rule"), "ts", F.col("event_id").alias("seq"), list_.alias("list"), action.alias("action"))


def op1_query(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Every page as a capture at the time of the event that has its number; without one it is unlisted."""
    pages = pages.select("page_id", "url")
    times = events.groupBy(F.col("event_id").alias("page_id")).agg(F.min("ts").alias("fetch_ts"))
    captures = pages.join(times, "page_id", "left")
    return evaluate(captures, list_from_events(events, pages)).drop("fetch_ts")


OP1_SQL = r"""
WITH h AS (SELECT page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]*)', 1) AS segment FROM pages),
p AS (SELECT page_id, url, 'path:' || host || '/' || segment AS path, 'host:' || host AS host,
             'domain:' || coalesce(nullif(regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1), ''), host) AS domain FROM h),
n AS (SELECT page_id, min(path) AS path, min(host) AS host, min(domain) AS domain FROM p GROUP BY page_id),
e AS (SELECT CASE event_id % 3 WHEN 0 THEN path WHEN 1 THEN host ELSE domain END AS rule, ts, event_id,
             CASE event_type WHEN 'error' THEN true WHEN 'signup' THEN false END AS block,
             CASE event_type WHEN 'purchase' THEN true WHEN 'view' THEN false END AS allow
      FROM events JOIN n ON user_id = page_id WHERE event_type IN ('error', 'signup', 'purchase', 'view')),
i AS (SELECT rule, event_id, ts AS start, lead(ts) OVER w AS stop,
             coalesce(last_value(block IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS blocks,
             coalesce(last_value(allow IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS allows
      FROM e WHERE rule IS NOT NULL WINDOW w AS (PARTITION BY rule ORDER BY ts, event_id)),
v AS (SELECT * FROM i WHERE (blocks OR allows) AND (stop IS NULL OR start < stop)),
t AS (SELECT event_id AS page_id, min(ts) AS fetch_ts FROM events GROUP BY event_id)
SELECT p.page_id, p.url,
       CASE WHEN coalesce(a.rule, b.rule, c.rule) IS NULL THEN 'unlisted'
            WHEN CASE WHEN a.rule IS NOT NULL THEN a.allows WHEN b.rule IS NOT NULL THEN b.allows ELSE c.allows END THEN 'allowed' ELSE 'blocked' END AS verdict,
       coalesce(a.rule, b.rule, c.rule) AS rule, coalesce(a.event_id, b.event_id, c.event_id) AS since_entry
FROM p LEFT JOIN t ON p.page_id = t.page_id
LEFT JOIN v a ON a.rule = p.path AND a.start <= t.fetch_ts AND (a.stop IS NULL OR t.fetch_ts < a.stop)
LEFT JOIN v b ON b.rule = p.host AND b.start <= t.fetch_ts AND (b.stop IS NULL OR t.fetch_ts < b.stop)
LEFT JOIN v c ON c.rule = p.domain AND c.start <= t.fetch_ts AND (c.stop IS NULL OR t.fetch_ts < c.stop)
"""
