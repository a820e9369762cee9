"""DuckDB SQL oracles for the registered queries.

Written independently of the Spark code: the stand-in mapping is restated as
SQL common table expressions over the raw ``pages`` and ``events`` views, and
each query's expected answer is computed directly from those rules.
"""

from __future__ import annotations

from fieldlink.config import DEFAULT_SITES as S

SITE = {
    "download_dir": S.download_dir,
    "hq_files": S.hq_files,
    "edge_files": S.edge_files,
    "images": S.source_images,
    "hq_repl": S.hq_replicated_stream,
    "hq_stream": S.hq_stream,
}


def rel_sql(aid: str, fn: str) -> str:
    """An asset file's path below a volume root, for the default layout."""
    if S.layout == "sharded":
        return f"substr({aid}, 1, 2) || '/' || {aid} || '/' || {fn}"
    if S.layout == "by_asset":
        return f"{aid} || '/' || {fn}"
    return fn


def shorten_sql(x: str, width: int) -> str:
    c = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    room = width - 6
    return (f"(CASE WHEN length({c}) <= {width} THEN {c} "
            f"ELSE ltrim(regexp_extract({c}, '^(.{{0,{room}}}) ', 1) || ' [...]') END)")


def timedelta_sql(s: str) -> str:
    days = f"CAST(floor(({s}) / 86400.0) AS BIGINT)"
    rem = f"(({s}) - {days} * 86400)"
    hms = f"printf('%d:%02d:%02d', {rem} // 3600, ({rem} % 3600) // 60, {rem} % 60)"
    return (f"(CASE WHEN {days} = 0 THEN {hms} ELSE CAST({days} AS VARCHAR) || "
            f"CASE WHEN abs({days}) = 1 THEN ' day, ' ELSE ' days, ' END || {hms} END)")


PG = """pg AS (
  SELECT page_id, lpad(CAST(page_id AS VARCHAR), 12, '0') AS assetID, url,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         CAST(length(html) AS BIGINT) AS html_len, split_part(url, '/', -1) AS filename
  FROM pages)"""

MSG = """ev AS (
  SELECT event_id AS seq, ts, user_id, event_type, props,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         event_id % (SELECT count(*) * 6 // 5 FROM pages) AS asset_no
  FROM events),
msg AS (
  SELECT ev.*, lpad(CAST(ev.asset_no AS VARCHAR), 12, '0') AS assetID,
         pg.title, pg.url, pg.filename, pg.page_id,
         CASE WHEN ev.user_id % 2 = 0 THEN 'HQ' ELSE 'EDGE' END AS origin,
         ev.k = 99 AS bad
  FROM ev LEFT JOIN pg ON pg.page_id = ev.asset_no)"""

LOG = """lg AS (
  SELECT seq, ts, origin, bad,
         CASE event_type WHEN 'signup' THEN 'IMAGEFEED' WHEN 'view' THEN 'IMAGE_DOWNLOAD'
              WHEN 'purchase' THEN 'ASSET_BROADCAST' WHEN 'click' THEN 'ASSET_REQUEST'
              WHEN 'error' THEN 'AUDIT' END AS topic
  FROM msg
  UNION ALL SELECT seq, ts, origin, bad, 'VOLUME_INFO' FROM msg WHERE event_type = 'view'
  UNION ALL SELECT seq, ts, origin, bad, 'REPLICA_INFO' FROM msg WHERE event_type = 'error')"""

DOCS = f"""docs AS (
  SELECT assetID, page_id, title, url, filename, TRUE AS found,
         CASE WHEN page_id % 10 <> 0 THEN '{SITE['download_dir']}/' || {rel_sql('assetID', 'filename')} END AS location
  FROM pg)"""

LISTINGS = f"""src_files AS (
  SELECT {rel_sql('assetID', 'filename')} AS rel_path, html_len AS len FROM pg WHERE page_id % 10 <> 0),
mir_files AS (
  SELECT {rel_sql('assetID', 'filename')} AS rel_path,
         html_len + CASE WHEN page_id % 9 = 0 THEN 1 ELSE 0 END AS len
  FROM pg WHERE (page_id % 10 <> 0 AND page_id % 3 = 0) OR page_id % 20 = 0)"""

DL = f"""dl AS (
  SELECT m.seq, m.ts, m.assetID, d.title, d.url AS description, d.filename,
         '{SITE['download_dir']}/' || {rel_sql('m.assetID', 'd.filename')} AS location,
         CASE WHEN d.found IS NULL THEN 'not_found'
              WHEN '{SITE['images']}/' || {rel_sql('m.assetID', 'd.filename')}
                   NOT IN (SELECT '{SITE['images']}/' || rel_path FROM src_files) THEN 'file_missing'
              WHEN m.k >= 10 THEN 'success' ELSE 'failed' END AS outcome
  FROM msg m LEFT JOIN docs d ON d.assetID = m.assetID
  WHERE m.event_type = 'signup' AND NOT m.bad)"""

# Real files: a page's HTML, where its URL ends in a file name; copies of assets with page_id % 13 = 0 fail.
FILES = f"""real AS (
  SELECT pg.assetID, pg.page_id, {rel_sql('pg.assetID', 'pg.filename')} AS rel_path,
         CAST(octet_length(encode(pages.html)) AS BIGINT) AS n_bytes, sha256(pages.html) AS sha
  FROM pg JOIN pages ON pages.page_id = pg.page_id WHERE pg.filename <> '')"""

RQ = """rq AS (
  SELECT m.seq, m.ts, m.assetID, m.title AS msg_title, d.found, d.location
  FROM msg m LEFT JOIN docs d ON d.assetID = m.assetID
  WHERE m.event_type = 'click' AND NOT m.bad)"""

LC = f"""b AS (
  SELECT assetID, min(seq) AS b_seq, arg_min(filename, seq) AS filename,
         arg_min(title, seq) AS title, arg_min(url, seq) AS description
  FROM msg WHERE event_type = 'purchase' AND NOT bad GROUP BY assetID),
c AS (SELECT assetID, max(seq) AS c_seq FROM msg WHERE event_type = 'click' GROUP BY assetID),
p AS (SELECT assetID, max(seq) AS p_seq, arg_max(ts, seq) AS p_ts FROM msg WHERE event_type = 'view' GROUP BY assetID),
lc0 AS (
  SELECT b.assetID, b.b_seq, c.c_seq, p.p_seq, p.p_ts, b.title, b.description, b.filename,
         CASE WHEN b.filename IS NULL THEN concat_ws('/', '{SITE['edge_files']}', {"substr(b.assetID, 1, 2), " if S.layout == "sharded" else ""}b.assetID)
              ELSE '{SITE['edge_files']}/' || {rel_sql('b.assetID', 'b.filename')} END AS path
  FROM b LEFT JOIN c ON c.assetID = b.assetID LEFT JOIN p ON p.assetID = b.assetID),
lc AS (
  SELECT lc0.*,
         CASE WHEN c_seq IS NULL OR c_seq < b_seq THEN '!'
              WHEN p_seq IS NULL OR p_seq < c_seq THEN 'requesting...'
              WHEN path NOT IN (SELECT '{SITE['edge_files']}/' || rel_path FROM mir_files) THEN 'requested'
              ELSE 'received' END AS status
  FROM lc0)"""

RO = """ro AS (
  SELECT CAST(user_id AS VARCHAR) AS replica, seq,
         CASE WHEN k % 7 = 0 THEN CASE WHEN k % 2 = 0 THEN 'NO STREAM' ELSE 'ERROR' END
              WHEN k % 5 = 0 THEN 'PAUSED' WHEN k % 2 = 0 THEN 'SYNCED' ELSE 'UNKNOWN' END AS state
  FROM msg WHERE event_type = 'error' AND NOT bad)"""

TILES = """tiles AS (
  SELECT seq, ts, 'IMAGE Feed Service' AS service, 'Asset: ' || assetID AS title,
         'New asset available from IMAGE' AS description, CAST(NULL AS VARCHAR) AS image_url
  FROM msg WHERE event_type = 'signup' AND NOT bad
  UNION ALL SELECT seq, ts, 'Image Download Service', title, description, location
  FROM dl WHERE outcome IN ('success', 'failed')
  UNION ALL SELECT seq, ts, 'Asset Broadcast Service', 'Broadcasting: ' || assetID, title, NULL
  FROM msg WHERE event_type = 'view' AND NOT bad AND k >= 10
  UNION ALL SELECT seq, ts, 'Asset Response Service', 'Processing: ' || assetID, msg_title, NULL
  FROM rq WHERE found AND location IS NOT NULL
  UNION ALL SELECT p_seq, p_ts, 'Asset Viewer Service', title, description, path
  FROM lc WHERE status = 'received')"""

VI = """vi AS (
  SELECT CAST(user_id AS VARCHAR) AS replica, seq, k, epoch_us(ts) // 1000 AS ms
  FROM msg WHERE event_type = 'view' AND NOT bad),
vi_last AS (SELECT replica, arg_max(k, seq) AS k, arg_max(ms, seq) AS ms FROM vi GROUP BY replica),
vi_lag AS (
  SELECT replica, CASE WHEN k % 7 = 0 THEN NULL
         ELSE CAST(((SELECT epoch_us(max(ts)) // 1000 FROM events) - ms) // 1000 AS BIGINT) END AS lag_s
  FROM vi_last)"""

FEED = """feed AS (
  SELECT substr(sha256(CAST(page_id AS VARCHAR) || ':' || url), 1, 12) AS assetID,
         title, url AS description, url AS href, filename
  FROM pg)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ALL = (PG, MSG, LOG, DOCS, LISTINGS, DL, RQ, LC, RO, TILES, FEED)

_VIEWER_SVC = "Asset Viewer Service"

ORACLE_SQL: dict[str, str] = {
    "feed_normalize": _with(PG, FEED) + "SELECT assetID, title, description, href, filename FROM feed",
    "feed_message": _with(PG, FEED) + (
        "SELECT title, description, 'imagesTable' AS tablename, assetID, 'ezshow' AS messageCreatorID FROM feed"),
    "assign_asset_ids": (
        "SELECT page_id, substr(sha256(CAST(page_id AS VARCHAR) || ':' || url), 1, 12) AS asset_id FROM pages"),
    "feed_sample": _with(PG, FEED) + "SELECT assetID, title FROM feed ORDER BY sha256('42' || assetID) LIMIT 5",
    "topic_consume": _with(PG, MSG) + (
        "SELECT seq, assetID, title, origin FROM msg WHERE event_type = 'signup' AND NOT bad"),
    "document_upsert": _with(PG, MSG) + (
        "SELECT assetID, max(seq) AS seq, arg_max(props, seq) AS raw, CAST(arg_max(k, seq) AS INTEGER) AS k FROM msg GROUP BY assetID"),
    "document_lookup": _with(PG, MSG) + (
        "SELECT assetID, title FROM pg WHERE assetID IN "
        "(SELECT assetID FROM msg WHERE event_type = 'signup' AND NOT bad)"),
    "image_download": _with(PG, MSG, DOCS, LISTINGS, DL) + (
        "SELECT seq, assetID, title, description, filename, location, outcome AS status "
        "FROM dl WHERE outcome IN ('success', 'failed')"),
    "image_download_copies": _with(PG, MSG, DOCS, FILES) + (
        "SELECT m.seq, m.assetID, d.title, d.url AS description, d.filename, d.location, "
        "CASE WHEN d.page_id % 13 = 0 THEN 'failed' ELSE 'success' END AS status, "
        "CASE WHEN d.page_id % 13 <> 0 THEN r.n_bytes END AS n_bytes, CASE WHEN d.page_id % 13 <> 0 THEN r.sha END AS sha256 "
        "FROM msg m JOIN docs d ON d.assetID = m.assetID JOIN real r ON r.assetID = m.assetID "
        "WHERE m.event_type = 'signup' AND NOT m.bad AND d.page_id % 10 <> 0"),
    "asset_response_copies": _with(PG, MSG, DOCS, RQ, FILES) + (
        f"SELECT g.assetID, g.filename, g.src, '{SITE['hq_files']}/' || {rel_sql('g.assetID', 'g.filename')} AS dst, g.n_requests, "
        "r.page_id IS NOT NULL AS ok, r.n_bytes, r.sha AS sha256 FROM ("
        "SELECT assetID, split_part(location, '/', -1) AS filename, location AS src, count(*) AS n_requests "
        "FROM rq WHERE found AND location IS NOT NULL GROUP BY assetID, location) g "
        "LEFT JOIN real r ON r.assetID = g.assetID AND r.page_id % 13 <> 0"),
    "volume_files": _with(PG, FILES) + (
        f"SELECT '{SITE['hq_files']}' AS volume, rel_path, n_bytes AS length FROM real WHERE page_id % 10 <> 0 UNION ALL "
        f"SELECT '{SITE['edge_files']}', rel_path, n_bytes + CASE WHEN page_id % 9 = 0 THEN 1 ELSE 0 END FROM real "
        "WHERE (page_id % 10 <> 0 AND page_id % 3 = 0) OR page_id % 20 = 0"),
    "asset_digests": _with(PG, DOCS, FILES) + (
        "SELECT d.assetID, d.location, r.n_bytes, r.sha AS sha256 FROM docs d LEFT JOIN real r ON r.assetID = d.assetID "
        "WHERE d.location IS NOT NULL"),
    "image_download_deadletter": _with(PG, MSG, DOCS, LISTINGS, DL) + (
        "SELECT seq, assetID, outcome AS reason FROM dl WHERE outcome IN ('not_found', 'file_missing')"),
    "download_outcomes": _with(PG, MSG, DOCS, LISTINGS, DL) + (
        "SELECT outcome, count(*) AS n FROM dl GROUP BY outcome"),
    "filename_collisions": _with(PG) + (
        "SELECT filename, count(DISTINCT assetID) AS n_assets FROM pg GROUP BY filename "
        "HAVING count(DISTINCT assetID) > 1"),
    "asset_broadcast": _with(PG, MSG) + (
        "SELECT seq, assetID, 'success' AS status FROM msg WHERE event_type = 'view' AND NOT bad AND k >= 10"),
    "broadcast_listener": _with(PG, MSG) + (
        "SELECT assetID, min(seq) AS seq, '!' AS status FROM msg "
        "WHERE event_type = 'purchase' AND NOT bad GROUP BY assetID"),
    "asset_lifecycle": _with(PG, MSG, LISTINGS, LC) + "SELECT assetID, status FROM lc",
    "asset_status_counts": _with(PG, MSG, LISTINGS, LC) + "SELECT status, count(*) AS n FROM lc GROUP BY status",
    "asset_request_publish": _with(PG, MSG, LISTINGS, LC) + (
        "SELECT assetID, title, status FROM lc WHERE status = 'requesting...'"),
    "asset_response": _with(PG, MSG, DOCS, RQ) + (
        f"SELECT assetID, split_part(location, '/', -1) AS filename, location AS src, "
        f"'{SITE['hq_files']}/' || {rel_sql('assetID', "split_part(location, '/', -1)")} AS dst, "
        f"count(*) AS n_requests FROM rq WHERE found AND location IS NOT NULL GROUP BY assetID, location"),
    "asset_response_deadletter": _with(PG, MSG, DOCS, RQ) + (
        "SELECT seq, assetID, CASE WHEN found IS NULL THEN 'not_found' ELSE 'no_location' END AS reason "
        "FROM rq WHERE found IS NULL OR location IS NULL"),
    "asset_viewer": _with(PG, MSG, LISTINGS, LC) + "SELECT assetID, path FROM lc WHERE status = 'received'",
    "published_assets": _with(PG, MSG, LISTINGS, LC) + (
        "SELECT row_number() OVER (ORDER BY b_seq DESC, assetID) AS pos, assetID, title, status FROM lc"),
    "audit_replication": _with(PG, MSG) + (
        "SELECT seq, CASE WHEN k % 4 = 0 THEN 'DB_UPSTREAMADD' WHEN k % 4 = 1 THEN 'DB_UPSTREAMREMOVE' "
        "ELSE 'DB_GET' END AS operation, "
        f"CASE WHEN user_id % 2 = 0 THEN '{SITE['hq_repl']}' ELSE '{SITE['hq_stream']}' END AS upstreamPath, "
        "(k % 4 = 0 AND user_id % 2 = 0) AS established "
        "FROM msg WHERE event_type = 'error' AND NOT bad"),
    "replica_state": _with(PG, MSG, RO) + (
        "SELECT replica, max(seq) AS seq, arg_max(state, seq) AS state FROM ro GROUP BY replica"),
    "replica_state_changes": _with(PG, MSG, RO) + (
        "SELECT replica, seq, state, prev_state FROM ("
        "SELECT replica, seq, state, lag(state) OVER (PARTITION BY replica ORDER BY seq) AS prev_state FROM ro) "
        "WHERE prev_state IS NULL OR prev_state <> state"),
    "mirror_lag": _with(PG, MSG, VI) + (
        "SELECT replica, lag_s, CASE WHEN lag_s IS NULL THEN 'ERROR' ELSE "
        + timedelta_sql("lag_s") + " || ' ago' END AS lag_text FROM vi_lag"),
    "mirror_diff": _with(PG, LISTINGS) + (
        "SELECT rel_path, action FROM ("
        "SELECT coalesce(s.rel_path, d.rel_path) AS rel_path, "
        "CASE WHEN d.rel_path IS NULL THEN 'copy' WHEN s.rel_path IS NULL THEN 'delete' "
        "WHEN s.len <> d.len THEN 'refresh' ELSE 'same' END AS action "
        "FROM src_files s FULL OUTER JOIN mir_files d ON s.rel_path = d.rel_path) WHERE action <> 'same'"),
    "volume_usage": _with(PG, LISTINGS) + (
        f"SELECT '{SITE['hq_files']}' AS volume, count(*) AS n_files, CAST(sum(len) AS BIGINT) AS bytes "
        f"FROM src_files UNION ALL "
        f"SELECT '{SITE['edge_files']}', count(*), CAST(sum(len) AS BIGINT) FROM mir_files"),
    "topic_replicate": _with(PG, MSG, LOG) + (
        "SELECT s.site, lg.origin, lg.topic, lg.seq FROM lg, (VALUES ('HQ'), ('EDGE')) AS s(site)"),
    "topic_retention": _with(PG, MSG, LOG) + (
        "SELECT seq, topic, ts FROM lg WHERE ts >= (SELECT max(ts) FROM lg) - INTERVAL 38400 SECOND"),
    "activity_feed": _with(*ALL) + (
        f"SELECT seq, service, {shorten_sql('title', 32)} AS title_short, "
        f"{shorten_sql('description', 64)} AS description_short, image_url "
        "FROM tiles ORDER BY seq DESC, service LIMIT 20"),
    "activity_visible": _with(*ALL) + (
        f"SELECT seq, service FROM tiles WHERE service = '{_VIEWER_SVC}' "
        "OR ts >= (SELECT max(ts) FROM tiles) - INTERVAL 86400 SECOND"),
    "service_counters": _with(*ALL) + (
        "SELECT s.service, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM (VALUES ('IMAGE Feed'), "
        "('Image Download'), ('Asset Broadcast'), ('Asset Response'), ('Audit Listener'), ('Upstream Comm'), "
        "('Broadcast Listener'), ('Asset Request'), ('Asset Viewer')) AS s(service) LEFT JOIN ("
        "SELECT 'IMAGE Feed' AS service, count(*) AS n FROM msg WHERE event_type = 'signup' AND NOT bad "
        "UNION ALL SELECT 'Image Download', count(*) FROM dl WHERE outcome IN ('success', 'failed') "
        "UNION ALL SELECT 'Asset Broadcast', count(*) FROM msg WHERE event_type = 'view' AND NOT bad AND k >= 10 "
        "UNION ALL SELECT 'Asset Response', count(*) FROM rq WHERE found AND location IS NOT NULL "
        "UNION ALL SELECT 'Audit Listener', count(*) FROM msg WHERE event_type = 'error' AND NOT bad "
        "UNION ALL SELECT 'Broadcast Listener', count(*) FROM msg WHERE event_type = 'purchase' AND NOT bad "
        "UNION ALL SELECT 'Asset Request', count(*) FROM msg WHERE event_type = 'view' "
        "UNION ALL SELECT 'Asset Viewer', count(*) FROM lc WHERE status = 'received') AS c "
        "ON c.service = s.service"),
    "malformed_messages": _with(PG, MSG, LOG) + "SELECT seq, topic FROM lg WHERE bad",
    "path_and_text_functions": _with(PG) + (
        "SELECT page_id, split_part(url, '/', -1) AS last_segment, "
        "regexp_extract(url, '([^/]*)$', 1) AS basename, "
        "regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS basename_normpath, "
        "substr(sha256(CAST(page_id AS VARCHAR) || ':' || url), 1, 12) AS asset_id, "
        "CAST(json_object('url', url) AS VARCHAR) AS json_text, url AS json_roundtrip, "
        "decode(encode(title)) AS utf8_title, "
        f"'{SITE['hq_stream']}:IMAGEFEED' AS topic_address, "
        "replace(url_encode(url), '%20', '+') AS quoted_url, "
        f"{shorten_sql('title', 32)} AS title_32, {shorten_sql('title', 64)} AS title_64, "
        "html_len * 97 - 400000 AS seconds, "
        f"{timedelta_sql('html_len * 97 - 400000')} AS timedelta_text, "
        "CAST(trunc(((html_len * 97 - 400000) * 7 + 3) / 1000.0) AS BIGINT) AS ms_to_s, "
        "coalesce(nullif(title, ''), 'untitled') AS title_or_default, "
        "contains(url, 'example.com') AS has_example, "
        "CASE WHEN len(string_split(title, ' ')) >= 2 THEN string_split(title, ' ')[2] END AS second_word "
        "FROM pg"),
}
