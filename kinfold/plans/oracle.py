"""DuckDB SQL for the queries of ``catalogue``: the same rows from the same tables by plain means."""

from __future__ import annotations

_BITS = " + ".join(f"CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(64))
_SIGNED = "CAST(CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END AS BIGINT)"

#: sg: a signature for each document.
SG = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
h1 AS (SELECT doc_id, CAST('0x' || substr(md5(t), 1, 16) AS UBIGINT) AS h FROM (SELECT doc_id, unnest(w) AS t FROM w)),
h2 AS (SELECT doc_id, CAST('0x' || substr(md5(t), 1, 16) AS UBIGINT) AS h FROM (SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS t FROM w)),
p1 AS (SELECT doc_id, {_SIGNED} AS p FROM (SELECT doc_id, {_BITS} AS v FROM h1 GROUP BY doc_id)),
p2 AS (SELECT doc_id, {_SIGNED} AS p FROM (SELECT doc_id, {_BITS} AS v FROM h2 GROUP BY doc_id)),
sg AS (SELECT documents.doc_id, p1.p AS phash, CASE WHEN p1.p IS NOT NULL THEN coalesce(p2.p, 0) END AS dhash
       FROM documents LEFT JOIN p1 USING (doc_id) LEFT JOIN p2 USING (doc_id))"""

D = "greatest(bit_count(xor(a.phash, b.phash)), bit_count(xor(a.dhash, b.dhash)))"

#: nd: distinct signatures by number, cc: the smallest number each hangs together with, mb: members of groups.
_GROUPS = f""",
nd AS (SELECT phash, dhash, min(doc_id) AS id, count(*) AS n FROM sg WHERE phash IS NOT NULL GROUP BY phash, dhash),
ed AS (SELECT a.id AS x, b.id AS y FROM nd a JOIN nd b ON a.id <> b.id AND {D} <= 5),
rc AS (SELECT id AS x, id AS r FROM nd UNION SELECT ed.x, rc.r FROM rc JOIN ed ON ed.y = rc.x),
cc AS (SELECT x AS id, min(r) AS rep FROM rc GROUP BY x),
ms AS (SELECT cc.rep, sg.doc_id, sg.phash, sg.dhash FROM sg JOIN nd ON sg.phash = nd.phash AND sg.dhash = nd.dhash JOIN cc ON cc.id = nd.id),
mb AS (SELECT * FROM ms WHERE rep IN (SELECT rep FROM ms GROUP BY rep HAVING count(*) > 1))"""

_ASSETS = r"""ast AS (SELECT doc_id, coalesce(source, '') AS folder, coalesce(lang, '') || '/' || doc_id AS path, coalesce(n_chars, 0) AS size,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS width,
  CASE WHEN length(coalesce(text, '')) > 0 THEN len(string_split(text, chr(10))) ELSE 0 END AS height FROM documents)"""

#: jd: members with is_best and is_exact.
_JUDGED = f""",
{_ASSETS},
rk AS (SELECT mb.rep, mb.doc_id, width, height, size, row_number() OVER (PARTITION BY mb.rep ORDER BY width * height DESC, mb.doc_id) = 1 AS is_best FROM mb JOIN ast USING (doc_id)),
jd AS (SELECT r.*, b.doc_id AS best, NOT r.is_best AND r.width = b.width AND r.height = b.height AND r.size = b.size AS is_exact
       FROM rk r JOIN rk b ON r.rep = b.rep AND b.is_best)"""


def _size_label(x: str) -> str:
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    cases = " ".join(f"WHEN {x} < {1024 ** (i + 1)}::DOUBLE THEN printf('%.1f', {x} / {1024**i}::DOUBLE) || ' {u}'" for i, u in enumerate(units[:-1]))
    return f"CASE WHEN {x} IS NULL OR {x} <= 0 THEN '0 B' {cases} ELSE printf('%.1f', {x} / {1024**5}::DOUBLE) || ' PB' END"


_KINDS = """e AS (SELECT event_id AS id, ts, CASE WHEN event_type IN ('click', 'view') THEN 'counter' WHEN event_type = 'purchase' THEN 'gauge' ELSE 'timer' END AS kind,
  event_type || '[u=' || (user_id % 50) || ']' AS key, floor(value * 100) AS value FROM events)"""
_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS n FROM e WHERE kind = 'timer') WHERE n <= 20)"

STATES = """z AS (SELECT user_id, event_id, event_type, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1000000.0::DOUBLE AS sec, epoch_us(ts) AS us FROM events),
g AS (SELECT user_id AS folder, arg_max(event_type, (us, event_id)) AS t, coalesce(max(sec) FILTER (event_type = 'view'), 0.0) AS mtime,
             coalesce(max(sec) FILTER (event_type = 'purchase'), 0.0) AS last_scan, count(*) FILTER (event_type = 'error') % 4 AS failures,
             coalesce(max(sec) FILTER (event_type = 'error'), 0.0) AS last_failure, max(sec) AS seen FROM z GROUP BY user_id),
s AS (SELECT folder, CASE t WHEN 'error' THEN 'error' WHEN 'view' THEN 'stale' WHEN 'purchase' THEN 'complete' ELSE 'pending' END AS status, mtime, mtime AS last_change, last_scan,
             failures, last_failure, folder % 11 = 0 AS held, folder % 3 = 0 AS queued, CASE WHEN folder % 3 = 0 THEN seen END AS enqueued_at, CASE WHEN folder % 3 = 0 THEN folder % 4 END AS priority FROM g),
y AS (SELECT *, failures = 0 OR 2592000 >= last_failure + CASE WHEN failures <= 0 THEN 0 WHEN status = 'error' THEN least(300 * pow(2, failures), 3600) ELSE 300 * pow(2, failures - 1) END AS waited,
             2592000 - last_change >= 300 AND 2592000 - last_scan >= 600 AS quiet FROM s),
r AS (SELECT *, CASE WHEN status = 'pending' AND waited AND failures = 0 THEN 'pending' WHEN status IN ('pending', 'error') AND waited THEN 'retry' WHEN status = 'stale' AND quiet THEN 'stale' END AS reason FROM y)"""

_SESSIONS = """d AS (SELECT user_id AS folder, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < {quiet}::BIGINT * 1000000 THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY folder ORDER BY ts, event_id) AS session FROM d),
q AS (SELECT folder, CAST(session AS BIGINT) AS session, count(*) AS changes, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM n GROUP BY folder, session)"""

_FILES = "f AS (SELECT doc_id, n_chars AS size FROM documents), k AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id), c AS (SELECT doc_id, size + 1 - quality AS size FROM f JOIN k USING (doc_id))"

_RESOLUTION = "{'width': width, 'height': height, 'label': CASE WHEN width > 0 AND height > 0 THEN width || 'x' || height ELSE 'Unknown' END}"

SQL: dict[str, str] = {
    "sig_text": f"{SG} SELECT doc_id, phash, dhash FROM sg",
    "sig_vector": f"""
        WITH v AS (SELECT vec_id, embedding AS e, list_aggregate([CAST(x AS DOUBLE) FOR x IN embedding], 'median') AS m FROM embeddings),
        i AS (SELECT vec_id, e, m, unnest(range(0, least(len(e), 64))) AS i FROM v),
        b AS (SELECT vec_id, sum(CASE WHEN e[i + 1] > m THEN pow(2::HUGEINT, i)::HUGEINT ELSE 0 END) AS p, sum(CASE WHEN i + 2 <= len(e) AND e[i + 2] > e[i + 1] THEN pow(2::HUGEINT, i)::HUGEINT ELSE 0 END) AS q FROM i GROUP BY vec_id)
        SELECT embeddings.vec_id, {_SIGNED.replace("v ", "p ").replace("ELSE v", "ELSE p")} AS phash, {_SIGNED.replace("v ", "q ").replace("ELSE v", "ELSE q")} AS dhash FROM embeddings LEFT JOIN b USING (vec_id)""",
    "hash_hex_roundtrip": f"""{SG} SELECT doc_id, printf('%016x', phash) || '|' || printf('%016x', dhash) AS hex, phash, dhash, true AS legacy_both, phash AS legacy FROM sg WHERE phash IS NOT NULL""",
    "dup_pairs_dual": f"{SG} SELECT a.doc_id AS a, b.doc_id AS b, CAST({D} AS INTEGER) AS distance FROM sg a JOIN sg b ON a.doc_id < b.doc_id AND {D} <= 5",
    "dup_pairs_phash_only": f"{SG} SELECT a.doc_id AS a, b.doc_id AS b, CAST(bit_count(xor(a.phash, b.phash)) AS INTEGER) AS distance FROM sg a JOIN sg b ON a.doc_id < b.doc_id AND bit_count(xor(a.phash, b.phash)) <= 5",
    "thumb_similarity": f"{SG} SELECT a.doc_id AS a, b.doc_id AS b, greatest(0::DOUBLE, 1 - {D} / 10::DOUBLE) AS similarity FROM sg a JOIN sg b ON a.doc_id < b.doc_id AND {D} <= 10",
    "nearest_known": f"""{SG}, m AS (SELECT a.doc_id, b.doc_id AS near, CAST({D} AS INTEGER) AS distance, row_number() OVER (PARTITION BY a.doc_id ORDER BY {D}, b.doc_id) AS n
        FROM sg a JOIN sg b ON a.doc_id % 2 = 1 AND b.doc_id % 2 = 0 AND {D} <= 5) SELECT doc_id, near, distance FROM m WHERE n = 1""",
    "near_dup_groups": f"{SG}{_GROUPS} SELECT rep, doc_id, count(*) OVER (PARTITION BY rep) AS size FROM mb",
    "group_kind_counts": f"""{SG}{_GROUPS}, x AS (SELECT rep, count(DISTINCT (phash, dhash)) AS forms FROM mb GROUP BY rep)
        SELECT count(*) FILTER (forms = 1) AS exact_groups, count(*) FILTER (forms > 1) AS similar_groups, count(*) AS total_groups FROM x""",
    "group_labels": f"""{SG}{_GROUPS} SELECT rep, CAST(count(*) AS INTEGER) AS size, CASE WHEN count(DISTINCT (phash, dhash)) = 1 THEN 'exact' ELSE 'similar' END AS label, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS files FROM mb GROUP BY rep""",
    "exact_text_groups": f"{SG} SELECT min(doc_id) AS rep, count(*) AS size FROM sg WHERE phash IS NOT NULL GROUP BY phash, dhash HAVING count(*) > 1",
    "group_ids": f"{SG}{_GROUPS} SELECT rep, substr(md5(string_agg(DISTINCT CAST(doc_id AS VARCHAR), '|' ORDER BY CAST(doc_id AS VARCHAR))), 1, 8) AS group_id, count(*) AS size FROM mb GROUP BY rep",
    "incremental_attach": f"""{SG},
        nd AS (SELECT * FROM sg WHERE phash IS NOT NULL), ev AS (SELECT * FROM nd WHERE doc_id % 2 = 0),
        ed AS (SELECT a.doc_id AS x, b.doc_id AS y FROM ev a JOIN ev b ON a.doc_id <> b.doc_id AND {D} <= 5),
        rc AS (SELECT doc_id AS x, doc_id AS r FROM ev UNION SELECT ed.x, rc.r FROM rc JOIN ed ON ed.y = rc.x),
        kn AS (SELECT x AS doc_id, min(r) AS rep FROM rc GROUP BY x), kg AS (SELECT * FROM kn WHERE rep IN (SELECT rep FROM kn GROUP BY rep HAVING count(*) > 1)),
        up AS (SELECT doc_id, near FROM (SELECT a.doc_id, b.doc_id AS near, row_number() OVER (PARTITION BY a.doc_id ORDER BY {D}, b.doc_id) AS n
               FROM nd a JOIN nd b ON a.doc_id % 2 = 1 AND a.doc_id <> b.doc_id AND (b.doc_id % 2 = 0 OR b.doc_id < a.doc_id) AND {D} <= 5) WHERE n = 1),
        ch AS (SELECT doc_id, near AS top FROM up UNION SELECT ch.doc_id, up.near FROM ch JOIN up ON up.doc_id = ch.top),
        en AS (SELECT doc_id, top FROM ch WHERE top NOT IN (SELECT doc_id FROM up)),
        al AS (SELECT rep, doc_id FROM kg UNION SELECT coalesce(kg.rep, en.top), en.doc_id FROM en LEFT JOIN kg ON kg.doc_id = en.top UNION SELECT en.top, en.top FROM en WHERE en.top NOT IN (SELECT doc_id FROM kg))
        SELECT rep, doc_id FROM al WHERE rep IN (SELECT rep FROM al GROUP BY rep HAVING count(*) > 1)""",
    "grouping_diff": f"""{SG}{_GROUPS}, l AS (SELECT DISTINCT doc_id FROM labels WHERE doc_id IS NOT NULL)
        SELECT doc_id AS path, 'gone' AS side FROM mb WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT doc_id, 'ungrouped' FROM l WHERE doc_id NOT IN (SELECT doc_id FROM mb)""",
    "group_best": f"{SG}{_GROUPS}{_JUDGED} SELECT rep, doc_id, CAST(width * height AS BIGINT) AS pixels FROM jd WHERE is_best",
    "group_members_exact_flag": f"{SG}{_GROUPS}{_JUDGED} SELECT rep, doc_id, is_best, is_exact FROM jd",
    "exact_elimination": f"""{SG}{_GROUPS}{_JUDGED} SELECT rep, doc_id, CASE WHEN is_exact THEN best END AS best FROM jd
        WHERE is_exact OR rep IN (SELECT rep FROM jd WHERE NOT is_exact GROUP BY rep HAVING count(*) > 1)""",
    "best_override": f"""{SG}{_GROUPS}{_JUDGED}, o AS (SELECT rep, max(doc_id) AS doc_id FROM jd WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY rep)
        SELECT jd.rep, coalesce(o.doc_id, jd.doc_id) AS doc_id FROM jd LEFT JOIN o USING (rep) WHERE is_best""",
    "result_json": f"""{SG}{_GROUPS}{_JUDGED}, m AS (SELECT rep, doc_id, is_best, is_exact, {{'path': doc_id, 'resolution': {_RESOLUTION}, 'size': size, 'size_formatted': {_size_label("size")}}} AS b,
          {{'path': doc_id, 'resolution': {_RESOLUTION}, 'size': size, 'size_formatted': {_size_label("size")}, 'is_exact_match': is_exact}} AS o FROM jd)
        SELECT rep AS group_id, CAST(to_json(max(b) FILTER (is_best)) AS VARCHAR) AS best_file, CAST(to_json(list(o ORDER BY doc_id) FILTER (NOT is_best)) AS VARCHAR) AS duplicate_files FROM m GROUP BY rep""",
    "best_temporal": """WITH c AS (SELECT conv_id, max(turn)::DOUBLE AS duration, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size, CAST(count(*) AS INTEGER) AS width, CAST(count(DISTINCT role) AS INTEGER) AS height FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        f AS (SELECT *, conv_id % 20 AS rep, row_number() OVER (PARTITION BY conv_id % 20 ORDER BY width * height DESC, conv_id) AS n FROM c),
        g AS (SELECT f.*, row_number() OVER (PARTITION BY f.rep ORDER BY f.duration DESC, f.size DESC, f.conv_id) AS k FROM f JOIN f b ON f.rep = b.rep AND b.n = 1 AND f.width = b.width AND f.height = b.height)
        SELECT rep, conv_id, width, height, duration, size FROM g WHERE k = 1""",
    "enhanced_score": f"""WITH {_ASSETS}, r AS (SELECT a.doc_id, a.width, a.height, a.size, first_value(a.size) OVER (PARTITION BY folder, height ORDER BY doc_id) AS rs FROM ast a WHERE doc_id IS NOT NULL),
        q AS (SELECT *, CASE WHEN rs > 0 THEN size::DOUBLE / rs::DOUBLE END AS x FROM r)
        SELECT doc_id, greatest(0::DOUBLE, least(1::DOUBLE, least(1::DOUBLE, (width * height) / 2073600::DOUBLE)
               + CASE WHEN x > 1 THEN least(0.3::DOUBLE, (x - 1) * 0.1::DOUBLE) WHEN x < 0.5 THEN -0.2::DOUBLE ELSE 0::DOUBLE END + CASE WHEN x > 1 THEN least(0.2::DOUBLE, (x - 1) * 0.1::DOUBLE) WHEN x < 0.5 THEN -0.1::DOUBLE ELSE 0::DOUBLE END)) AS score FROM q""",
    "replacement_links": f"""{SG}{_GROUPS}{_JUDGED}, t AS (SELECT x.path AS dup, y.path AS best FROM jd JOIN ast x ON x.doc_id = jd.doc_id JOIN ast y ON y.doc_id = jd.best WHERE is_exact)
        SELECT dup, best, CASE WHEN split_part(dup, '/', 1) = split_part(best, '/', 1) THEN split_part(best, '/', 2) ELSE '../' || best END AS link FROM t""",
    "size_labels": f"""WITH s AS (SELECT doc_id, (n_chars * n_chars * doc_id)::DOUBLE AS x FROM documents) SELECT doc_id, {_size_label("x")} AS label, x / 1048576::DOUBLE AS mb FROM s""",
    "duration_labels": """WITH c AS (SELECT conv_id, max(turn)::DOUBLE / 4 - 0.25::DOUBLE AS x FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN x > 0 THEN printf('%.1f', x) || 's' ELSE 'Unknown' END AS label FROM c""",
    "resolution_labels": f"WITH {_ASSETS} SELECT doc_id, CASE WHEN width > 0 AND height > 0 THEN width || 'x' || height ELSE 'Unknown' END AS label, CAST(width * height AS BIGINT) AS pixels FROM ast",
    "timestamp_labels": """WITH s AS (SELECT doc_id, greatest(0, CAST(floor(doc_id * 37.5::DOUBLE - 40) AS BIGINT)) AS s FROM documents) SELECT doc_id, printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS label FROM s""",
    "ext_normalize": r"""WITH p AS (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/](\.[^./]*)$', 1)) AS ext FROM pages)
        SELECT page_id, ext, '.html' || CASE WHEN ext IN ('', '.html') THEN '' ELSE ',' || ext END AS extensions FROM p""",
    "media_kinds": r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages)
        SELECT page_id, CASE WHEN lower(path) LIKE '%.html' OR lower(path) LIKE '%.htm' THEN 'image' WHEN lower(path) LIKE '%/' OR lower(path) LIKE '%.net' THEN 'video' END AS kind, regexp_matches(path, '(^|/)thumb(-[A-Za-z0-9]+)?\.') AS thumb FROM p""",
    "thumb_paths": "SELECT doc_id, CASE WHEN coalesce(lang, '') = '' THEN '' ELSE lang || '/' END || 'thumb-frame.' || doc_id || '.jpg' AS thumb, false AS safe FROM documents",
    "url_codec": "SELECT page_id, '/data/my%20files/' || replace(url_encode(url), '%2F', '/') AS address, true AS same FROM pages",
    "metric_keys": "SELECT event_type || '[a=' || (user_id % 3) || ',k=' || json_extract_string(props, '$.k') || ']' AS key, count(*) AS n FROM events GROUP BY 1",
    "retry_schedule": """WITH n AS (SELECT user_id, count(*) % 8 AS failures FROM events WHERE event_type = 'error' GROUP BY user_id)
        SELECT user_id, failures, CASE WHEN failures = 0 THEN 0::DOUBLE ELSE 300 * pow(2::DOUBLE, failures - 1) END AS pending_s, CASE WHEN failures = 0 THEN 0::DOUBLE ELSE least(300 * pow(2::DOUBLE, failures), 3600) END AS error_s FROM n""",
    "new_or_changed": f"WITH {_FILES} SELECT doc_id FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = f.doc_id AND c.size = f.size)",
    "cache_partition": f"WITH {_FILES} SELECT CASE WHEN c.doc_id IS NULL THEN 'new' WHEN c.size = f.size THEN 'valid' ELSE 'changed' END AS state, count(*) AS n FROM f LEFT JOIN c ON c.doc_id = f.doc_id GROUP BY 1",
    "cleanup_missing": f"WITH {_FILES} SELECT doc_id, size FROM c WHERE doc_id IN (SELECT doc_id FROM f WHERE doc_id % 3 <> 0)",
    "upsert_latest": f"WITH {_FILES} SELECT f.doc_id, coalesce(c.size, f.size) AS size FROM f LEFT JOIN c ON c.doc_id = f.doc_id",
    "live_groups": f"{SG}{_GROUPS} SELECT rep, count(*) AS live, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS files FROM mb WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY rep",
    "groups_without_file": f'{SG}{_GROUPS} SELECT rep, CAST(count(*) AS INTEGER) AS "left", min(doc_id) AS first FROM mb WHERE doc_id % 5 <> 0 GROUP BY rep',
    "store_stats": f"""{SG}{_GROUPS}, x AS (SELECT rep, count(*) AS n FROM mb GROUP BY rep), y AS (SELECT count(*) AS files, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes FROM documents)
        SELECT y.files, y.bytes, count(rep) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS members, coalesce(max(n), 0) AS largest FROM y LEFT JOIN x ON true GROUP BY ALL""",
    "folder_summary": f"{SG}{_GROUPS} SELECT coalesce(d.source, '') AS folder, count(*) AS files, count(mb.rep) AS grouped, count(DISTINCT mb.rep) AS groups FROM documents d LEFT JOIN mb USING (doc_id) GROUP BY 1",
    "folder_listing": "SELECT folder, files, CAST(row_number() OVER (ORDER BY lower(folder), folder) AS INTEGER) AS position FROM (SELECT coalesce(source, '') AS folder, count(*) AS files FROM documents GROUP BY 1)",
    "counters": f"WITH {_KINDS} SELECT key, sum(value) AS total FROM e WHERE kind = 'counter' GROUP BY key",
    "gauges": f"WITH {_KINDS} SELECT key, arg_max(value, (ts, id)) AS value FROM e WHERE kind = 'gauge' GROUP BY key",
    "timer_stats": f"WITH {_KINDS} SELECT key, min(value) AS min, max(value) AS max, avg(value) AS avg, count(*) AS count FROM {_LAST} GROUP BY key",
    "metric_dump": f"""WITH {_KINDS} SELECT 'counter' AS kind, key, sum(value) AS value, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS avg, NULL::BIGINT AS count FROM e WHERE kind = 'counter' GROUP BY key
        UNION ALL SELECT 'gauge', key, arg_max(value, (ts, id)), NULL, NULL, NULL, NULL FROM e WHERE kind = 'gauge' GROUP BY key
        UNION ALL SELECT 'timer', key, NULL, min(value), max(value), avg(value), count(*) FROM {_LAST} GROUP BY key""",
    "quiet_sessions": f"WITH {_SESSIONS.format(quiet=21600)} SELECT folder, session, changes, last - first AS length_us, 21600000000::BIGINT AS wait_us FROM q",
    "rescan_gate": f"""WITH RECURSIVE {_SESSIONS.format(quiet=3600)}, o AS (SELECT folder, session, last + 3600000000 AS qa FROM q),
        w AS (SELECT folder, session, qa, qa AS due FROM o WHERE session = 1
              UNION ALL SELECT o.folder, o.session, o.qa, CASE WHEN o.qa <= w.due THEN w.due ELSE greatest(o.qa, w.due + 43200000000) END FROM w JOIN o ON o.folder = w.folder AND o.session = w.session + 1),
        u AS (SELECT *, lag(due) OVER (PARTITION BY folder ORDER BY session) AS was FROM w)
        SELECT folder, session, due - qa AS held_us FROM u WHERE was IS NULL OR due <> was""",
    "stale_folders": f"WITH {STATES} SELECT CASE WHEN status = 'complete' AND mtime > last_scan THEN 'stale' ELSE status END AS status, count(*) AS n, CAST(sum(floor(last_change)) AS BIGINT) AS changes FROM s GROUP BY 1",
    "ready_folders": f"WITH {STATES} SELECT folder, reason FROM r WHERE reason IS NOT NULL AND NOT held AND NOT queued AND folder <> 1",
    "scan_queue": f"""WITH {STATES}, x AS (SELECT folder, held, queued, enqueued_at, priority, CASE reason WHEN 'pending' THEN 1 WHEN 'stale' THEN 2 WHEN 'retry' THEN 3 END AS rank FROM r),
        m AS (SELECT folder, CASE WHEN NOT held AND rank IS NOT NULL THEN CASE WHEN queued THEN least(priority, rank) ELSE rank END ELSE priority END AS priority, CASE WHEN queued THEN enqueued_at ELSE 2592000 END AS enqueued_at FROM x WHERE queued OR (NOT held AND rank IS NOT NULL))
        SELECT folder, CAST(priority AS INTEGER) AS priority, CAST(row_number() OVER (PARTITION BY priority ORDER BY enqueued_at, folder) AS INTEGER) AS place FROM m""",
    "scheduler_status": f"WITH {STATES} SELECT CASE WHEN count(*) FILTER (queued) > 0 THEN 'waiting' ELSE 'sleeping' END AS state, NULL::BIGINT AS current_folder, 0::BIGINT AS active_scans, count(*) FILTER (queued) AS queue_size, 30::DOUBLE AS seconds_to_next FROM s",
}
SQL["vec_pairs_within"] = (
    "WITH sg AS (" + SQL["sig_vector"] + f") SELECT a.vec_id AS a, b.vec_id AS b, CAST({D} AS INTEGER) AS distance FROM sg a JOIN sg b ON a.vec_id < b.vec_id AND {D} <= 20"
)
