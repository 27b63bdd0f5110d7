"""DuckDB SQL for each batch query, written independently of the Spark operators.

`VIEWS` are named sub-queries; `sql_for` prepends the ones a query needs as one WITH list.
"""

from __future__ import annotations

import re

AS_OF = 1705363200
FOREVER = 2**62

VIEWS = {
    "ev": """
        SELECT event_id, ts, user_id, event_type, value, props,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS doc_id,
               CAST(floor(epoch(ts)) AS BIGINT) AS sec,
               epoch_us(ts) AS us
        FROM events""",
    "interactions": """
        SELECT event_id, ts,
               CASE event_id % 3 WHEN 0 THEN 'like' WHEN 1 THEN 'question_mark' ELSE 'share' END AS kind,
               CASE WHEN event_type IN ('error', 'signup') THEN 'remove' ELSE 'add' END AS action,
               doc_id, user_id
        FROM ev""",
    "submissions": """
        SELECT doc_id, arrival_seq, user_id AS author_id,
               'u' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 2 AS VARCHAR) AS conn_id,
               client_id,
               seq0 - CASE WHEN arrival_seq % 7 = 0 AND (arrival_seq - 1) % 3 = 0 THEN 1 ELSE 0 END AS client_seq,
               (arrival_seq - 1) // 3 AS base_revision,
               '[{"kind":"retain","count":' || CAST(event_id % 20 AS VARCHAR) || '},' ||
               CASE WHEN event_id % 5 = 0
                    THEN '{"kind":"delete","count":' || CAST(event_id % 4 AS VARCHAR) || '}]'
                    ELSE '{"kind":"insert","text":"' || event_type || 'é"}]' END AS plain_ops,
               CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN '[{"kind":"ins'
                    WHEN event_id % 37 = 0 THEN '[{"kind":"retain","count":-3},{"kind":"insert","text":"X"}]'
                    WHEN event_id % 29 = 0 THEN '[{"kind":"insert","text":"b","attrs":{"bold":true}}]'
                    ELSE plain_ops END AS ops,
               CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN 'INVALID_OPS'
                    WHEN event_id % 37 = 0 THEN 'INVALID_POSITION' END AS fault,
               event_id, event_type, ts
        FROM (SELECT *, 'c' || CAST(user_id % 4 AS VARCHAR) AS client_id,
                     row_number() OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS arrival_seq,
                     row_number() OVER (PARTITION BY doc_id, user_id % 4 ORDER BY ts, event_id) AS seq0
              FROM ev)""",
    "steps": """
        SELECT doc_id, CAST(0 AS BIGINT) AS arrival_seq, CAST(0 AS BIGINT) AS rev,
               CAST(MAP {} AS MAP(VARCHAR, BIGINT)) AS marks, CAST(NULL AS VARCHAR) AS status
        FROM (SELECT DISTINCT doc_id FROM submissions)
        UNION ALL
        SELECT doc_id, arrival_seq,
               CASE WHEN status = 'accepted' THEN rev + 1 ELSE rev END,
               CASE WHEN status = 'accepted' THEN map_concat(marks, MAP {client_id: client_seq}) ELSE marks END,
               status
        FROM (SELECT s.doc_id, s.arrival_seq, p.rev, p.marks, s.client_id, s.client_seq,
                     CASE WHEN s.client_seq <= coalesce(p.marks[s.client_id], 0) THEN 'DUPLICATE_OR_OUT_OF_ORDER'
                          WHEN s.base_revision <> p.rev THEN 'REVISION_CONFLICT'
                          WHEN s.fault IS NOT NULL THEN s.fault
                          ELSE 'accepted' END AS status
              FROM steps p JOIN submissions s
                ON s.doc_id = p.doc_id AND s.arrival_seq = p.arrival_seq + 1)""",
    "labelled": """
        SELECT s.*, p.status, CASE WHEN p.status = 'accepted' THEN p.rev END AS revision
        FROM submissions s JOIN steps p USING (doc_id, arrival_seq)""",
    "log": """
        SELECT doc_id, revision, 'o-' || doc_id || '-' || CAST(revision AS VARCHAR) AS operation_id,
               author_id, conn_id, client_id, client_seq, base_revision, ops, plain_ops, ts,
               epoch_us(ts) AS ts_us,
               event_id, event_type
        FROM labelled WHERE status = 'accepted'""",
    # One row per single op of the log, numbered through the document.
    "flat": """
        SELECT doc_id, revision, row_number() OVER (PARTITION BY doc_id ORDER BY revision, idx) AS n, idx,
               json_extract_string(op, '$.kind') AS kind,
               coalesce(CAST(json_extract_string(op, '$.count') AS BIGINT), 0) AS cnt,
               coalesce(json_extract_string(op, '$.text'), '') AS txt
        FROM (SELECT doc_id, revision, unnest(CAST(ops AS JSON[])) AS op,
                     unnest(range(1, CAST(json_array_length(ops) AS BIGINT) + 1)) AS idx
              FROM (SELECT doc_id, revision, coalesce(ops, '[{"kind":"none"}]') AS ops FROM log))""",
    "replay": """
        SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS pos, '' AS body, CAST(0 AS BIGINT) AS revision
        FROM (SELECT DISTINCT doc_id FROM flat)
        UNION ALL
        SELECT doc_id, n,
               CASE kind WHEN 'retain' THEN pos + cnt WHEN 'insert' THEN pos + length(txt) ELSE pos END,
               CASE WHEN kind = 'insert' THEN substr(body, 1, pos) || txt || substr(body, pos + 1)
                    WHEN kind = 'delete' AND cnt > 0 THEN substr(body, 1, pos) || substr(body, pos + cnt + 1)
                    ELSE body END,
               revision
        FROM (SELECT f.doc_id, f.n, f.revision, f.kind, f.cnt, f.txt, r.body,
                     CASE WHEN f.idx = 1 THEN 0 ELSE r.pos END AS pos
              FROM replay r JOIN flat f ON f.doc_id = r.doc_id AND f.n = r.n + 1)""",
    "texts": """
        SELECT doc_id, revision, arg_max(body, n) AS content FROM replay
        WHERE revision > 0 GROUP BY doc_id, revision""",
    "latest": "SELECT doc_id, max(revision) AS latest FROM log GROUP BY doc_id",
    "ring": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY revision DESC) AS newest FROM log)
        WHERE newest <= 1024""",
    "small_ring": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY revision DESC) AS newest FROM log)
        WHERE newest <= 20""",
    "lossy": """
        SELECT * FROM log WHERE revision % 17 <> 0
        UNION ALL SELECT * FROM log WHERE revision % 17 <> 0 AND revision % 13 = 0""",
    "heartbeats": """
        SELECT event_id, ts, sec, doc_id, user_id, 'u' || CAST(user_id AS VARCHAR) AS username,
               CAST(CASE WHEN event_id % 10 = 0 THEN 600 ELSE 21600 END AS BIGINT) AS ttl
        FROM ev""",
    "final_members": """
        SELECT doc_id, user_id, username, sec + ttl AS expire_at
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, user_id ORDER BY ts DESC, event_id DESC) AS newest
              FROM heartbeats)
        WHERE newest = 1""",
    "members": f"""
        SELECT doc_id, user_id, 'u' || CAST(user_id AS VARCHAR) AS username, expire_at
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, user_id
                                           ORDER BY ts DESC, event_id DESC, phase DESC) AS newest
              FROM beats WHERE sec <= {AS_OF})
        WHERE newest = 1""",
    "names": "SELECT doc_id, user_id, username FROM members WHERE user_id % 7 <> 0",
    "named": f"""
        SELECT m.doc_id, m.user_id, m.expire_at, coalesce(n.username, '') AS username,
               row_number() OVER (PARTITION BY m.doc_id ORDER BY m.expire_at, CAST(m.user_id AS VARCHAR)) AS ord
        FROM members m LEFT JOIN names n USING (doc_id, user_id)
        WHERE m.expire_at > {AS_OF}""",
    "alive": f"""
        SELECT doc_id, user_id, expire_at, username,
               row_number() OVER (PARTITION BY doc_id ORDER BY expire_at, CAST(user_id AS VARCHAR)) AS ord
        FROM members WHERE expire_at > {AS_OF}""",
    "skewed": """
        SELECT doc_id, revision, conn_id, operation_id, author_id,
               max(ts_us - CASE WHEN author_id % 2 = 0 THEN 21600000000 ELSE 0 END)
                 OVER (PARTITION BY doc_id ORDER BY revision ROWS UNBOUNDED PRECEDING) AS sent_us
        FROM log""",
    "cursors": """
        SELECT event_id, ts, sec, us, doc_id, user_id,
               CASE WHEN event_type = 'purchase' THEN 'get' ELSE 'set' END AS op,
               CASE WHEN event_type <> 'purchase' THEN '{"start":' || CAST(k AS VARCHAR) || '}' END AS cursor_json
        FROM ev""",
    "join_requests": """
        SELECT event_id, ts, us,
               'u' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 2 AS VARCHAR) AS conn_id, user_id,
               CASE WHEN event_id % 8 IN (0, 4, 6) THEN CAST(k AS VARCHAR) END AS opened_on,
               CASE event_id % 4 WHEN 1 THEN 'note/' || CAST(k AS VARCHAR)
                                 WHEN 3 THEN 'src' || CAST(k % 25 AS VARCHAR) || '/en' END AS title
        FROM ev""",
    # Every title row against every request that could see it.
    "titles": """
        SELECT title, id, CAST(NULL AS TIMESTAMP) AS since, 0 AS by_event FROM documents_t
        UNION ALL SELECT title, event_id + 1000000000, ts, event_id FROM create_requests""",
    "joins": """
        SELECT event_id, ts, us, conn_id, user_id, title IS NOT NULL AND found IS NULL AS refused,
               CASE WHEN title IS NOT NULL AND found IS NULL THEN NULL
                    ELSE coalesce(last_value(coalesce(found, opened_on) IGNORE NULLS)
                                  OVER (PARTITION BY conn_id ORDER BY ts, event_id
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') END AS doc_id
        FROM join_requests
        LEFT JOIN (SELECT r.event_id, CAST(min(t.id) AS VARCHAR) AS found
                   FROM join_requests r JOIN titles t
                     ON t.title = r.title AND (t.since IS NULL OR row(t.since, t.by_event) <= row(r.ts, r.event_id))
                   GROUP BY r.event_id) USING (event_id)""",
    "requested": "SELECT DISTINCT CAST(k AS VARCHAR) AS doc_id FROM ev",
    "created": """
        SELECT q.*, d.id
        FROM create_requests q
        JOIN (SELECT c.event_id, min(t.id) AS id
              FROM create_requests c JOIN titles t
                ON t.title = c.title AND (t.since IS NULL OR row(t.since, t.by_event) <= row(c.ts, c.event_id))
              GROUP BY c.event_id) d USING (event_id)""",
    "creates": """
        SELECT event_id, ts, sec, CAST(id AS VARCHAR) AS doc_id, user_id FROM created""",
    "gated": """
        SELECT j.*, EXISTS (SELECT 1 FROM first_active f
                            WHERE f.doc_id = j.doc_id AND row(f.ts, f.event_id) <= row(j.ts, j.event_id)) AS ok
        FROM joins j""",
    "first_active": """
        SELECT doc_id, ts, event_id
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts, event_id) AS n
              FROM (SELECT doc_id, ts, event_id FROM heartbeats UNION ALL SELECT doc_id, ts, event_id FROM creates))
        WHERE n = 1""",
    "beats": """
        SELECT doc_id, user_id, ts, sec, event_id, 0 AS phase, sec + 600 AS expire_at FROM creates
        UNION ALL SELECT doc_id, user_id, ts, sec, event_id, 1, sec + ttl FROM heartbeats
        UNION ALL SELECT doc_id, user_id, ts, CAST(floor(epoch(ts)) AS BIGINT), event_id, 2,
                         CAST(floor(epoch(ts)) AS BIGINT) + 600
                  FROM gated WHERE ok""",
    "turns": """
        SELECT *, lead(row(ts, event_id, phase)) OVER (PARTITION BY doc_id, user_id
                                                       ORDER BY ts, event_id, phase) AS next_beat
        FROM beats""",
    # The latest join up to a request that named a document.
    "asks": """
        SELECT a.event_id, a.ts, a.sec, a.clean, coalesce(arg_max(j.doc_id, (j.ts, j.event_id)), '') AS doc_id
        FROM (SELECT event_id, ts, sec, event_id % 9 <> 3 AS clean,
                     'u' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 2 AS VARCHAR) AS conn_id
              FROM ev WHERE event_id % 9 = 3 OR event_id % 50 = 8) a
        LEFT JOIN (SELECT * FROM joins WHERE NOT refused) j
          ON j.conn_id = a.conn_id AND row(j.ts, j.event_id) <= row(a.ts, a.event_id)
        GROUP BY ALL""",
    # Every read against every sign of life that it could find expired.
    "removals": """
        SELECT t.doc_id, t.user_id, t.ts, t.event_id, t.phase, arg_min(a.event_id, (a.ts, a.event_id)) AS ask
        FROM turns t JOIN asks a
          ON a.doc_id = t.doc_id AND a.sec >= t.expire_at
         AND (t.next_beat IS NULL OR row(a.ts, a.event_id, 3) < t.next_beat)
        GROUP BY t.doc_id, t.user_id, t.ts, t.event_id, t.phase""",
    "seen": """
        SELECT a.event_id, a.clean, a.ts, a.doc_id, m.user_id
        FROM asks a JOIN turns m
          ON m.doc_id = a.doc_id AND row(m.ts, m.event_id, m.phase) <= row(a.ts, a.event_id, 3)
         AND (m.next_beat IS NULL OR m.next_beat > row(a.ts, a.event_id, 3)) AND m.expire_at > a.sec""",
    "answered": """
        SELECT a.event_id, a.ts, a.doc_id, coalesce(r.n, 0) AS removed, coalesce(s.n, 0) AS members_left,
               a.clean AND coalesce(s.n, 0) = 0 AS leaves_active
        FROM asks a
        LEFT JOIN (SELECT ask AS event_id, count(*) AS n FROM removals GROUP BY ask) r USING (event_id)
        LEFT JOIN (SELECT event_id, count(*) AS n FROM seen GROUP BY event_id) s USING (event_id)""",
    "stays": """
        SELECT conn_id, user_id, doc_id, us AS joined_us, left_us
        FROM (SELECT *, lead(us) OVER (PARTITION BY conn_id ORDER BY ts, event_id) AS left_us
              FROM (SELECT *, lag(doc_id) OVER (PARTITION BY conn_id ORDER BY ts, event_id) AS old_doc,
                           lag(ok) OVER (PARTITION BY conn_id ORDER BY ts, event_id) AS old_ok
                    FROM gated WHERE NOT refused)
              WHERE old_doc IS NULL OR old_doc <> doc_id OR NOT old_ok)
        WHERE ok""",
    "users": "SELECT c_custkey AS id, c_name AS username FROM customer",
    "register_requests": """
        SELECT o_orderkey AS request_id,
               CASE WHEN o_orderkey % 3 = 0 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')
                    ELSE 'new#' || CAST(o_orderkey % 500 AS VARCHAR) END AS username
        FROM orders""",
    "documents_t": """
        SELECT doc_id AS id, doc_id % 100 AS owner_id, source || '/' || lang AS title FROM documents""",
    "create_requests": """
        SELECT event_id, ts, user_id, sec,
               CASE WHEN event_id % 2 = 0 THEN 'note/' || CAST(k AS VARCHAR)
                    ELSE 'src' || CAST(k % 20 AS VARCHAR) || '/en' END AS title
        FROM ev WHERE event_id % 9 = 1""",
    "doc_stats": """
        SELECT doc_id, count(*) FILTER (kind = 'like') AS like_count, CAST(0 AS BIGINT) AS view_count,
               count(*) FILTER (kind = 'share') AS share_count,
               count(*) FILTER (kind = 'question_mark') AS question_mark_count
        FROM interactions WHERE action = 'add' AND doc_id < '8' GROUP BY doc_id""",
    "stat_cache": """
        SELECT doc_id, kind,
               CASE WHEN doc_id = '4' THEN '-1' ELSE CAST(count(DISTINCT user_id) AS VARCHAR) END AS cached
        FROM interactions WHERE action = 'add' AND doc_id < '5' GROUP BY doc_id, kind""",
    "last_actions": """
        SELECT kind, doc_id, user_id, arg_max(action, (ts, event_id)) AS last_action
        FROM interactions GROUP BY kind, doc_id, user_id""",
    "counts": """
        SELECT kind, doc_id, count(*) FILTER (last_action = 'add') AS cnt
        FROM last_actions GROUP BY kind, doc_id""",
    "messages": """
        SELECT event_id, ts, k, user_id,
               CASE event_id % 9 WHEN 0 THEN 'heartbeat' WHEN 1 THEN 'createDocument' WHEN 2 THEN 'joinDocument'
                    WHEN 3 THEN 'show_alive_members' WHEN 4 THEN 'op_submit' WHEN 5 THEN 'saveDocument'
                    WHEN 6 THEN 'loadDocumentContent' WHEN 7 THEN 'setCursor' ELSE 'ping' END AS type,
               CASE WHEN event_id % 11 = 0 THEN '' ELSE doc_id END AS doc_id,
               event_id % 97 = 0 AS broken
        FROM ev""",
    # Each load and save against every submission up to its instant.
    "served": """
        SELECT m.event_id, m.type, m.doc_id, m.ts,
               CASE WHEN count(l.doc_id) > 0 THEN coalesce(max(l.revision), 0) END AS revision
        FROM messages m LEFT JOIN labelled l ON l.doc_id = m.doc_id AND l.ts <= m.ts
        WHERE m.type IN ('loadDocumentContent', 'saveDocument') AND NOT m.broken
        GROUP BY m.event_id, m.type, m.doc_id, m.ts""",
    "served_stores": """
        SELECT *, CASE WHEN type = 'saveDocument' THEN revision IS NOT NULL AND
                    row_number() OVER (PARTITION BY type, doc_id, revision ORDER BY ts, event_id) = 1 END AS stores
        FROM served""",
    "case_ops": """
        SELECT event_id, event_type || 'a😀b' || doc_id AS initial, k % 9 AS c, event_id % 8 AS n FROM ev""",
}
RECURSIVE = {"steps", "replay"}

BODIES = {
    "op_sequence": """
        SELECT doc_id, arrival_seq, client_id, client_seq, base_revision, status, revision FROM labelled""",
    "op_ack": """
        SELECT doc_id, arrival_seq, CASE WHEN status = 'accepted' THEN 'op_applied' ELSE 'error' END AS type,
               client_id, client_seq, CASE WHEN status = 'accepted' THEN base_revision END AS base_revision,
               revision AS current_revision, CASE WHEN status <> 'accepted' THEN status END AS content
        FROM labelled""",
    "current_revision": """
        SELECT doc_id, coalesce(latest, 0) AS revision FROM requested LEFT JOIN latest USING (doc_id)""",
    "client_high_water": """
        SELECT doc_id, client_id, max(client_seq) AS last_seq FROM log GROUP BY doc_id, client_id""",
    "document_content": """
        SELECT q.doc_id, CASE WHEN k.doc_id IS NOT NULL THEN coalesce(l.latest, 0) END AS revision,
               CASE WHEN k.doc_id IS NOT NULL THEN coalesce(t.content, '') END AS content,
               CASE WHEN k.doc_id IS NOT NULL THEN length(coalesce(t.content, '')) END AS length,
               CASE WHEN k.doc_id IS NULL THEN 'document not found' END AS error
        FROM requested q
        LEFT JOIN (SELECT DISTINCT doc_id FROM submissions) k USING (doc_id)
        LEFT JOIN latest l USING (doc_id)
        LEFT JOIN texts t ON t.doc_id = l.doc_id AND t.revision = l.latest""",
    "document_at_revision": """
        SELECT q.doc_id, q.revision,
               CASE WHEN q.revision = 0 THEN '' ELSE t.content END AS content,
               CASE WHEN q.revision > coalesce(l.latest, 0) THEN 'REVISION_NOT_REACHED' END AS error
        FROM (SELECT DISTINCT doc_id, k AS revision FROM ev) q
        LEFT JOIN latest l USING (doc_id)
        LEFT JOIN texts t ON t.doc_id = q.doc_id AND t.revision = q.revision""",
    "documents_served": """
        SELECT event_id, type, doc_id, revision, stores,
               CASE WHEN type = 'saveDocument'
                    THEN CASE WHEN revision IS NULL THEN 'Document ' || doc_id || ' save failed' || chr(10) ELSE '' END
                         || 'Document ' || doc_id || ' saved' END AS answer,
               CASE WHEN revision IS NULL THEN 'document not found' END AS error
        FROM served_stores""",
    "document_texts_served": """
        SELECT s.event_id, s.type, s.doc_id, s.revision, s.stores, coalesce(t.content, '') AS content
        FROM served_stores s LEFT JOIN texts t ON t.doc_id = s.doc_id AND t.revision = s.revision
        WHERE s.revision IS NOT NULL AND s.event_id % 20 = 0""",
    "snapshot_rows": """
        SELECT t.doc_id AS document_id, t.revision, t.content
        FROM texts t JOIN latest l ON t.doc_id = l.doc_id AND t.revision = l.latest""",
    "snapshot_insert_ignore": """
        SELECT doc_id AS document_id, revision, content
        FROM (SELECT *, revision // 25 AS n FROM texts WHERE revision % 25 = 0)
        WHERE n & (n - 1) = 0 OR (n % 3 = 0 AND (n // 3) & (n // 3 - 1) = 0)""",
    "op_ring": "SELECT doc_id, revision, operation_id, author_id, ops FROM ring",
    "op_small_ring": "SELECT doc_id, revision, operation_id, author_id, ops FROM small_ring",
    "ops_since": """
        SELECT doc_id, from_revision, lim, oldest > from_revision + 1 AS truncated, revision,
               operation_id, author_id, ops
        FROM (SELECT q.*, r.revision, r.operation_id, r.author_id, r.ops,
                     (SELECT min(revision) FROM ring o WHERE o.doc_id = q.doc_id) AS oldest,
                     row_number() OVER (PARTITION BY q.doc_id, q.from_revision, q.lim ORDER BY r.revision) AS rn
              FROM (SELECT DISTINCT doc_id, k AS from_revision,
                           CASE WHEN k % 3 = 0 THEN CAST(0 AS BIGINT) ELSE k % 7 END AS lim FROM ev) q
              JOIN ring r ON r.doc_id = q.doc_id AND r.revision > q.from_revision)
        WHERE lim <= 0 OR rn <= lim""",
    "op_log_gaps": """
        SELECT doc_id, before + 1 AS missing_from, revision - 1 AS missing_to, revision - before - 1 AS missing
        FROM (SELECT doc_id, revision, lag(revision, 1, 0) OVER (PARTITION BY doc_id ORDER BY revision) AS before
              FROM (SELECT DISTINCT doc_id, revision FROM lossy))
        WHERE revision - before > 1""",
    "op_log_dedup": "SELECT doc_id, revision, operation_id, client_id, client_seq FROM log",
    "op_log_encode": """
        SELECT doc_id AS key, 'OP_APPLIED' AS event_type, doc_id, operation_id, client_id,
               strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS applied_at,
               revision, author_id, client_seq, base_revision,
               CASE WHEN ops = plain_ops THEN nullif(event_id % 20, 0) END AS retained,
               CASE WHEN ops = plain_ops AND event_id % 5 = 0 THEN nullif(event_id % 4, 0) END AS deleted,
               CASE WHEN ops = plain_ops AND event_id % 5 <> 0 THEN event_type || 'é' END AS inserted
        FROM log""",
    "op_log_decode": """
        SELECT doc_id AS key, doc_id, operation_id, revision, author_id, client_id, client_seq, base_revision,
               replace(ops, ',"count":0}', '}') AS ops, ts_us AS applied_us
        FROM log WHERE revision % 31 <> 0""",
    "op_log_quarantine": """
        SELECT doc_id AS key,
               CASE WHEN revision % 31 = 0 THEN substr(event, 1, 40)
                    ELSE replace(event, '"revision":' || CAST(revision AS VARCHAR), '"revision":"x7"') END AS value
        FROM (SELECT *, '{"eventType":"OP_APPLIED","docId":"' || doc_id || '","operationId":"' || operation_id ||
                     '","revision":' || CAST(revision AS VARCHAR) || ',"authorId":' || CAST(author_id AS VARCHAR) ||
                     ',"clientId":"' || client_id || '","clientSeq":' || CAST(client_seq AS VARCHAR) ||
                     ',"baseRevision":' || CAST(base_revision AS VARCHAR) ||
                     coalesce(',"ops":' || replace(ops, ',"count":0}', '}'), '') ||
                     ',"appliedAt":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '"}' AS event
              FROM log)
        WHERE revision % 31 = 0 OR revision % 23 = 0""",
    "op_log_files": """
        SELECT doc_id, count(*) AS events, CAST(0 AS BIGINT) AS out_of_order, max(revision) AS last_revision
        FROM log GROUP BY doc_id""",
    "interaction_apply": """
        SELECT event_id, kind, doc_id, user_id, delta <> 0 AS changed,
               CAST(sum(delta) OVER (PARTITION BY kind, doc_id ORDER BY ts, event_id
                                     ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value
        FROM (SELECT *, CASE WHEN action = prev THEN 0 WHEN action = 'add' THEN 1 ELSE -1 END AS delta
              FROM (SELECT *, lag(action, 1, 'remove') OVER (PARTITION BY kind, doc_id, user_id
                                                             ORDER BY ts, event_id) AS prev
                    FROM interactions))""",
    "interaction_counts": "SELECT kind, doc_id, cnt FROM counts",
    "interaction_members": "SELECT kind, doc_id, user_id FROM last_actions WHERE last_action = 'add'",
    "doc_stats_build": """
        SELECT doc_id, CAST(coalesce(sum(cnt) FILTER (kind = 'like'), 0) AS BIGINT) AS like_count,
               CAST(0 AS BIGINT) AS view_count,
               CAST(coalesce(sum(cnt) FILTER (kind = 'share'), 0) AS BIGINT) AS share_count,
               CAST(coalesce(sum(cnt) FILTER (kind = 'question_mark'), 0) AS BIGINT) AS question_mark_count
        FROM counts GROUP BY doc_id""",
    "doc_stats_lookup": """
        SELECT doc_id, like_count, view_count, share_count, question_mark_count
        FROM requested LEFT JOIN doc_stats USING (doc_id)""",
    "stat_read_through": """
        SELECT event_id, kind, doc_id, coalesce(hit, stored, 0) AS value,
               CASE WHEN hit IS NOT NULL THEN 'cache' WHEN stored IS NOT NULL THEN 'store'
                    ELSE 'default' END AS source
        FROM (SELECT i.event_id, i.kind, i.doc_id, nullif(CAST(c.cached AS BIGINT), -1) AS hit,
                     CASE i.kind WHEN 'like' THEN s.like_count WHEN 'share' THEN s.share_count
                                 ELSE s.question_mark_count END AS stored
              FROM interactions i LEFT JOIN stat_cache c USING (doc_id, kind) LEFT JOIN doc_stats s USING (doc_id))""",
    "count_convert": r"""
        SELECT event_id, raw, greatest(n, 0) AS count_value,
               CASE WHEN n IS NULL THEN 'invalid result' END AS error
        FROM (SELECT event_id, raw,
                     CASE WHEN regexp_full_match(raw, '[+-]?[0-9]+') THEN TRY_CAST(raw AS BIGINT) END AS n
              FROM (SELECT event_id, CASE event_id % 6
                             WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '-' || CAST(event_id AS VARCHAR)
                             WHEN 2 THEN '+' || CAST(event_id AS VARCHAR) WHEN 3 THEN CAST(event_id AS VARCHAR) || '.5'
                             WHEN 4 THEN ' ' || CAST(event_id AS VARCHAR)
                             ELSE '9223372036854775' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') END AS raw
                    FROM ev))""",
    "presence_state": """
        SELECT doc_id, user_id, 'u' || CAST(user_id AS VARCHAR) AS username, expire_at
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, user_id
                                           ORDER BY ts DESC, event_id DESC, phase DESC) AS newest FROM beats)
        WHERE newest = 1""",
    "presence_expired": f"SELECT doc_id, user_id, expire_at FROM members WHERE expire_at <= {AS_OF}",
    "presence_alive": "SELECT doc_id, user_id, expire_at, username, ord FROM named",
    "presence_quarantine": """
        SELECT event_id, user_id, CASE WHEN event_id % 53 = 0 THEN '' END AS doc_id
        FROM heartbeats WHERE event_id % 53 = 0 OR event_id % 59 = 0""",
    "presence_alive_semi": "SELECT doc_id, user_id, username FROM named",
    "room_members": "SELECT DISTINCT doc_id, user_id FROM beats",
    "active_documents": f"SELECT DISTINCT doc_id FROM beats WHERE sec <= {AS_OF}",
    "active_documents_from_keys": "SELECT DISTINCT doc_id FROM heartbeats",
    "presence_cleanup": f"""
        SELECT doc_id, count(*) FILTER (expire_at <= {AS_OF}) AS expired,
               count(*) FILTER (expire_at > {AS_OF}) AS alive,
               count(*) FILTER (expire_at > {AS_OF}) = 0 AS remove_doc
        FROM members GROUP BY doc_id""",
    "member_reads_answered": "SELECT event_id, doc_id, removed, members_left, leaves_active FROM answered",
    "members_after_reads": """
        SELECT t.doc_id, t.user_id, 'u' || CAST(t.user_id AS VARCHAR) AS username, t.expire_at
        FROM turns t LEFT JOIN removals r USING (doc_id, user_id, ts, event_id, phase)
        WHERE t.next_beat IS NULL AND r.ask IS NULL""",
    "active_after_reads": """
        SELECT doc_id FROM (SELECT doc_id, max(row(ts, event_id)) AS written FROM beats GROUP BY doc_id)
        LEFT JOIN (SELECT doc_id, max(row(ts, event_id)) AS cleaned FROM answered
                   WHERE leaves_active GROUP BY doc_id) USING (doc_id)
        WHERE cleaned IS NULL OR cleaned < written""",
    "members_shown": """
        SELECT event_id, doc_id, user_id,
               'User ' || CAST(user_id AS VARCHAR) || '(u' || CAST(user_id AS VARCHAR) || ') is online' AS content
        FROM seen WHERE NOT clean AND event_id % 20 = 0""",
    "join_gate": """
        SELECT event_id, conn_id, doc_id, ok,
               CASE WHEN refused THEN 'GET_DOCID_FAILED'
                    WHEN ok THEN 'Document ' || doc_id || ' joined by user ' || CAST(user_id AS VARCHAR)
                    ELSE 'Document ' || doc_id || ' not found' END AS content
        FROM gated""",
    "presence_sessions": """
        SELECT doc_id, user_id, min(sec) AS session_start, arg_max(expire_at, (ts, event_id, phase)) AS session_end,
               count(*) AS heartbeats
        FROM (SELECT *, sum(CASE WHEN held IS NULL OR sec > held THEN 1 ELSE 0 END)
                        OVER (PARTITION BY doc_id, user_id ORDER BY ts, event_id, phase) AS no
              FROM (SELECT *, lag(expire_at) OVER (PARTITION BY doc_id, user_id ORDER BY ts, event_id, phase) AS held
                    FROM beats))
        GROUP BY doc_id, user_id, no""",
    # Every heartbeat against the latest sign of life of every user at that moment.
    "heartbeat_alive": """
        SELECT h.event_id, h.doc_id, h.user_id, count(*) AS alive_members
        FROM heartbeats h JOIN turns m
          ON m.doc_id = h.doc_id AND row(m.ts, m.event_id, m.phase) <= row(h.ts, h.event_id, 1)
         AND (m.next_beat IS NULL OR m.next_beat > row(h.ts, h.event_id, 1)) AND m.expire_at > h.sec
        GROUP BY h.event_id, h.doc_id, h.user_id""",
    "cursor_asof": """
        SELECT event_id, doc_id, user_id, CASE WHEN live THEN json END AS cursor_json, coalesce(live, false) AS found
        FROM (SELECT g.event_id, g.doc_id, g.user_id, s.cursor_json AS json, s.sec + 259200 > g.sec AS live
              FROM (SELECT * FROM cursors WHERE op = 'get') g
              ASOF LEFT JOIN (SELECT * FROM cursors WHERE op = 'set') s
                ON s.doc_id = g.doc_id AND s.user_id = g.user_id AND s.us <= g.us)""",
    "presence_messages": """
        SELECT doc_id, user_id, 'User ' || CAST(user_id AS VARCHAR) || '(' || username || ') is online' AS content
        FROM alive""",
    "room_intervals": "SELECT conn_id, user_id, doc_id, joined_us, left_us FROM stays",
    "op_fanout": f"""
        SELECT s.conn_id, s.doc_id, s.joined_us, min(o.revision) AS first_revision, max(o.revision) AS last_revision,
               count(*) AS ops_in_stay, count(*) FILTER (o.conn_id <> s.conn_id) AS delivered
        FROM stays s JOIN log o ON o.doc_id = s.doc_id AND o.ts_us >= s.joined_us
                               AND o.ts_us < coalesce(s.left_us, {FOREVER})
        GROUP BY s.conn_id, s.doc_id, s.joined_us""",
    "op_outbox": f"""
        SELECT s.conn_id, o.doc_id, o.revision, o.operation_id, o.author_id
        FROM skewed o JOIN stays s ON o.doc_id = s.doc_id AND o.sent_us >= s.joined_us
                                  AND o.sent_us < coalesce(s.left_us, {FOREVER}) AND s.conn_id <> o.conn_id
        WHERE s.user_id % 20 = 0""",
    "heartbeat_members": """
        SELECT h.event_id, h.doc_id, m.user_id, 'u' || CAST(m.user_id AS VARCHAR) AS username
        FROM heartbeats h JOIN turns m
          ON m.doc_id = h.doc_id AND row(m.ts, m.event_id, m.phase) <= row(h.ts, h.event_id, 1)
         AND (m.next_beat IS NULL OR m.next_beat > row(h.ts, h.event_id, 1)) AND m.expire_at > h.sec
        WHERE h.event_id % 20 = 0""",
    "cursor_receivers": f"""
        SELECT c.event_id, c.doc_id, s.conn_id
        FROM cursors c JOIN stays s ON c.doc_id = s.doc_id AND c.us >= s.joined_us
                                   AND c.us < coalesce(s.left_us, {FOREVER})
        WHERE c.op = 'set' AND c.event_id % 20 = 0""",
    "op_recipients": f"""
        SELECT o.doc_id, o.revision, count(s.conn_id) AS recipients
        FROM log o LEFT JOIN stays s ON o.doc_id = s.doc_id AND o.ts_us >= s.joined_us
                               AND o.ts_us < coalesce(s.left_us, {FOREVER}) AND s.conn_id <> o.conn_id
        GROUP BY o.doc_id, o.revision""",
    "presence_fanout": f"""
        SELECT s.conn_id, s.doc_id, (SELECT count(*) FROM alive a WHERE a.doc_id = s.doc_id) AS members
        FROM stays s
        WHERE s.joined_us <= {AS_OF}000000 AND coalesce(s.left_us, {FOREVER}) > {AS_OF}000000""",
    "presence_pages": """
        SELECT doc_id, (ord - 1) // 1000 AS page,
               '[' || string_agg('{"userId":' || CAST(user_id AS VARCHAR) ||
                                 CASE WHEN username = '' THEN '' ELSE ',"username":"' || username || '"' END || '}',
                                 ',' ORDER BY ord) || ']' AS content,
               'Alive members: [' || string_agg('{' || CAST(user_id AS VARCHAR) || ' ' || username || '}',
                                                ' ' ORDER BY ord) || ']' AS listing
        FROM alive GROUP BY doc_id, (ord - 1) // 1000""",
    "cursor_fanout": f"""
        SELECT c.doc_id, c.event_id, count(s.conn_id) AS recipients
        FROM cursors c LEFT JOIN stays s ON c.doc_id = s.doc_id AND c.us >= s.joined_us
                                        AND c.us < coalesce(s.left_us, {FOREVER})
        WHERE c.op = 'set' GROUP BY c.doc_id, c.event_id""",
    "document_id_by_title": """
        SELECT q.event_id, q.title, CAST(d.id AS VARCHAR) AS document_id
        FROM (SELECT event_id, 'src' || CAST(k % 25 AS VARCHAR) || '/' ||
                     CASE user_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS title
              FROM ev) q
        LEFT JOIN (SELECT title, min(id) AS id FROM documents_t GROUP BY title) d USING (title)""",
    "user_by_username": """
        SELECT r.request_id, r.username, u.id AS user_id, CASE WHEN u.id IS NULL THEN 'USER_NOT_FOUND' END AS error
        FROM register_requests r LEFT JOIN users u USING (username)""",
    "create_documents": """
        SELECT event_id, CAST(event_id + 1000000000 AS VARCHAR) AS created_id, user_id AS owner_id, title,
               CAST(id AS VARCHAR) AS document_id, 'u' || CAST(user_id AS VARCHAR) AS username,
               sec + 600 AS expire_at,
               'Document ' || CAST(id AS VARCHAR) || ' created by user ' || CAST(user_id AS VARCHAR) AS content
        FROM created""",
    "register_users": """
        SELECT request_id, username,
               CASE WHEN username NOT IN (SELECT username FROM users) AND nth = 1 THEN 'created'
                    ELSE 'USERNAME_TAKEN' END AS status
        FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY request_id) AS nth
              FROM register_requests)""",
    "message_route": """
        SELECT event_id,
               CASE WHEN broken THEN 'quarantine' WHEN type IN ('setCursor', 'ping') THEN 'ignored'
                    ELSE type END AS route,
               CASE WHEN broken THEN 'quarantine' WHEN type = 'ping' THEN 'ignored' ELSE type END AS older_route,
               CASE WHEN broken THEN NULL WHEN type = 'heartbeat' THEN 'Heartbeat received'
                    WHEN type IN ('setCursor', 'ping') THEN 'Unknown message type' END AS reply
        FROM messages""",
    "submission_project": """
        SELECT event_id, doc_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE k END AS base_revision,
               CASE WHEN event_id % 5 = 0 THEN '' ELSE 'c' || CAST(user_id % 4 AS VARCHAR) END AS client_id,
               CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id END AS client_seq,
               CASE WHEN event_id % 5 <> 0
                    THEN replace('[{"kind":"retain","count":' || CAST(k AS VARCHAR) ||
                                 '},{"kind":"insert","text":"m"}]', ',"count":0}', '}') END AS ops
        FROM messages WHERE type = 'op_submit' AND NOT broken""",
    "request_doc_id": """
        SELECT event_id, doc_id, CASE WHEN doc_id IS NULL THEN 'missing doc_id' END AS error
        FROM (SELECT event_id, CASE WHEN event_id % 8 = 3 THEN NULL ELSE doc_id END AS doc_id FROM ev)""",
    "request_validate": """
        SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN doc_id END AS doc_id,
               CASE WHEN event_id % 13 <> 0 THEN user_id END AS user_id,
               CASE WHEN event_id % 11 = 0 THEN 'missing doc_id'
                    WHEN event_id % 13 = 0 THEN 'unauthorized' END AS error
        FROM ev""",
    "apply_delta_cases": """
        SELECT event_id, CASE n
                 WHEN 0 THEN substr(initial, 1, 5) || ' collaborative' || substr(initial, 6)
                 WHEN 1 THEN substr(initial, 1, c) || substr(initial, c + 5)
                 WHEN 2 THEN initial || 'xy'
                 WHEN 3 THEN ''
                 WHEN 4 THEN substr(initial, 1, 2) || '中文' || substr(initial, 3)
                 WHEN 5 THEN substr(initial, 1, 1) || substr(initial, 2 + c)
                 WHEN 6 THEN 'é' || initial
                 ELSE CASE WHEN c <= 2 THEN substr(initial, 1, 2 - c) || 'X' || substr(initial, 3 - c) END
               END AS result,
               CASE WHEN n = 7 AND c > 2 THEN 'INVALID_POSITION' END AS error
        FROM case_ops""",
    "key_format": """
        SELECT doc_id, user_id,
               'Like:{docID:' || doc_id || '}' AS like_key,
               'QuestionMark:{docID:' || doc_id || '}' AS question_mark_key,
               'Share:{docID:' || doc_id || '}' AS share_key,
               'LikedUser:{docID:' || doc_id || '}' AS liked_user_key,
               'QuestionMarkedUser:{docID:' || doc_id || '}' AS question_marked_user_key,
               'SharedUser:{docID:' || doc_id || '}' AS shared_user_key,
               'presence:room:{docID:' || doc_id || '}' AS room_key,
               'presence:room:names:{docID:' || doc_id || '}' AS names_key,
               'presence:room:' || doc_id AS plain_room_key,
               'presence:room:names:' || doc_id AS plain_names_key,
               'presence:member:' || doc_id || ':' || CAST(user_id AS VARCHAR) AS member_key,
               'presence:cursor:' || doc_id || ':' || CAST(user_id AS VARCHAR) AS cursor_key,
               'auth:user:{' || CAST(user_id AS VARCHAR) || '}' AS auth_user_key,
               'auth:login:name:{' || username || '}' AS auth_login_key,
               'presence:docs' AS docs_key
        FROM final_members""",
    "score_rank": """
        SELECT doc_id, member, score,
               row_number() OVER (PARTITION BY doc_id ORDER BY score, member) - 1 AS rank,
               row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, member DESC) - 1 AS reverse_rank
        FROM (SELECT doc_id, CAST(user_id AS VARCHAR) AS member, count(*) AS score FROM ev GROUP BY ALL)""",
    "activity_bitmap": """
        SELECT doc_id, user_id, bits, CAST(bit_count(bits) AS BIGINT) AS days, (bits >> 1) & 1 AS second_day
        FROM (SELECT doc_id, user_id, bit_or(CAST(1 AS BIGINT) << CAST(day(ts) - 1 AS INTEGER)) AS bits
              FROM ev GROUP BY doc_id, user_id)""",
    "active_user_bitmap": """
        SELECT doc_id, CASE WHEN user_id > 0 THEN 1 + (user_id - 1) // 32768 ELSE 0 END AS bucket, count(DISTINCT user_id) AS users
        FROM ev GROUP BY ALL""",
}


def _needed(sql: str, own: str | None, found: dict[str, None]) -> None:
    """Collect the views a text names, each after the views it depends on."""
    for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)):
        if word in VIEWS and word != own and word not in found:
            _needed(VIEWS[word], word, found)
            found[word] = None


def sql_for(body: str) -> str:
    found: dict[str, None] = {}
    _needed(body, None, found)
    parts = [f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({VIEWS[n]})" for n in found]
    recursive = "RECURSIVE " if RECURSIVE & found.keys() else ""
    return f"WITH {recursive}{', '.join(parts)} {body}" if parts else body


BODIES["ops_since_small_ring"] = re.sub(r"\bring\b", "small_ring", BODIES["ops_since"])
ORACLE = {name: sql_for(body) for name, body in BODIES.items()}
