"""The queries' equivalents in DuckDB's SQL over the same tables."""

from __future__ import annotations

VIDEOS = """videos AS (SELECT c_custkey AS id, '/inbox/' || c_name || '.mp4' AS path, CAST(25 AS DOUBLE) AS fps,
  CAST(250 + (c_custkey * 37) % 5000 AS BIGINT) AS frames FROM customer)"""
DETECTIONS = """detections AS (SELECT o_orderkey AS id, o_custkey AS video_id,
  1000 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS merge_ms, CAST(coalesce(n, 0) AS INTEGER) AS events_count,
  o_orderdate AS created_at FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
DET_EVENTS = """det_events AS (SELECT l_orderkey AS detection_id,
  CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 1000 + l_linenumber AS BIGINT) AS t_ms FROM lineitem)"""
FOUR = "lpad(CAST(k * 83 % 10000 AS VARCHAR), 4, '0')"
SERIES = f"""series0 AS (SELECT user_id AS video_id, event_id, event_type, epoch_us(ts) // 1000 AS t_ms,
  row_number() OVER (PARTITION BY user_id ORDER BY ts) AS frame_idx, CAST(floor(value * 1000) AS BIGINT) AS changed_px,
  CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events),
series AS (SELECT *, CASE k % 5 WHEN 0 THEN 'о' || lpad(CAST(k AS VARCHAR), 3, 'O') || 'рр' WHEN 1 THEN 'be ' || {FOUR} || 'a0'
  WHEN 2 THEN 'A8' || translate({FOUR}, '0', 'O') WHEN 3 THEN ' ' END AS raw FROM series0)"""
CAMERAS = """cameras AS (SELECT s_suppkey AS id, s_name AS name, 'rtsp://user:pw@cam' || s_suppkey || '/stream' AS url,
  s_acctbal > 0 AS active FROM supplier)"""
FILES = """files AS (SELECT doc_id AS ord, '/usb/' || source || '/clip' || (doc_id % 100) ||
  CASE doc_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.mkv' WHEN 2 THEN '.ts' ELSE '.txt' END AS path, text AS content,
  sha256(coalesce(text, '')) AS sha256 FROM documents)"""


def compact(raw: str) -> str:
    return rf"regexp_replace(translate(upper({raw}), 'АВЕКМНОРСТУХ', 'ABEKMHOPCTYX'), '[^\p{{L}}\p{{N}}]', '', 'g')"


def plate(raw: str, region: bool = False) -> str:
    """A scalar subquery-free expression; the text is compacted by each use."""
    c = compact(raw)
    g = f"regexp_extract({c}, '[A-Z012458]{{2}}[0-9OISZBEA]{{4}}[A-Z012458]{{2}}')"
    r = f"regexp_extract({c}, '[ABEKMHOPCTYX08][0-9OISZBEA]{{3}}[ABEKMHOPCTYX08]{{2}}" + ("([0-9OISZBEA]{2,3})?" if region else "") + "')"
    s = f"regexp_extract({c}, '[ABEKMHOPCTYX048]{{2}}[0-9OISZBEA]{{4}}')"
    tail = f" || translate(substr({r}, 7, 3), 'OISZBEA', '0152861')" if region else ""
    return f"""CASE WHEN {g} <> '' THEN translate(substr({g}, 1, 2), '015248', 'OISZAB') || translate(substr({g}, 3, 4), 'OISZBEA', '0152864')
      || translate(substr({g}, 7, 1), '015248', 'OISZAA') || translate(substr({g}, 8, 1), '015248', 'OISZAO')
    WHEN {r} <> '' THEN translate(substr({r}, 1, 1), '08', 'OB') || translate(substr({r}, 2, 3), 'OISZBEA', '0152861')
      || translate(substr({r}, 5, 2), '08', 'OB'){tail}
    WHEN {s} <> '' THEN translate(substr({s}, 1, 2), '048', 'OAB') || translate(substr({s}, 3, 4), 'OISZBEA', '0152864') END"""


def kind(p: str) -> str:
    return f"""CASE WHEN regexp_matches({p}, '^[A-Z]{{2}}[0-9]{{4}}[A-Z]{{2}}$') THEN 3 WHEN regexp_matches({p}, '^[A-Z]{{2}}[0-9]{{4}}$') THEN 2
      WHEN regexp_matches({p}, '^[A-Z][0-9]{{3}}[A-Z]{{2}}$') THEN 1 ELSE 0 END"""


def shape(t: str) -> str:
    return f"""(CASE WHEN regexp_matches({t}, '^[A-Z]{{2}}[0-9]{{4}}[A-Z]{{2}}$') THEN 200 ELSE 0 END
      + CASE WHEN regexp_matches({t}, '^[A-Z][0-9]{{3}}[A-Z]{{2}}([0-9]{{2}}|[0-9]{{3}})?$') THEN 200 ELSE 0 END
      + CASE WHEN length({t}) = 8 THEN 10 ELSE 0 END)"""


def clean(raw: str) -> str:
    t = f"regexp_replace(upper({raw}), '[^A-Z0-9А-ЯЁ]', '', 'g')"
    return f"""CASE WHEN length({t}) >= 3 AND regexp_matches({t}, '[0-9]') AND regexp_matches({t}, '[A-ZА-ЯЁ]')
      AND regexp_matches({t}, '[ABEKMHOPCTYX0123456789]') THEN {t} END"""


def clock(ms: str) -> str:
    return f"printf('%02d:%02d:%02d.%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


PLATED = f"{SERIES}, plated AS (SELECT video_id AS detection_id, t_ms, {plate('raw')} AS plate FROM series)"
STAMP = "strftime(created_at, '%Y-%m-%d %H:%M') || CASE WHEN second(created_at) = 0 THEN '' ELSE strftime(created_at, ':%S') END"
ROW = f"'#' || id || ' | ' || events_count || ' ev | merge=' || merge_ms || ' | ' || {STAMP} || ' | ' || path"
PAGED = f"{VIDEOS}, {DETECTIONS}, joined AS (SELECT d.*, v.path FROM detections d JOIN videos v ON v.id = d.video_id)"
COUNTED = "count(*) AS detections, CAST(coalesce(sum(events_count), 0) AS BIGINT) AS events"


def marked(gap: int) -> str:
    return f"""{PLATED}, gaps AS (SELECT *, row_number() OVER w - 1 AS idx,
  CASE WHEN t_ms - lag(t_ms) OVER w > {gap} THEN 1 ELSE 0 END AS fresh FROM plated WINDOW w AS (PARTITION BY detection_id ORDER BY t_ms)),
marked AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY detection_id ORDER BY t_ms ROWS UNBOUNDED PRECEDING) AS INTEGER) AS trip FROM gaps),
counted AS (SELECT detection_id, trip, plate, count(*) AS votes FROM marked WHERE trim(coalesce(plate, '')) <> '' GROUP BY ALL),
votes AS (SELECT * FROM counted WHERE votes >= 2 QUALIFY row_number() OVER (PARTITION BY detection_id, trip ORDER BY votes DESC, plate) = 1)"""


def trips(gap: int, plates: str) -> str:
    return f"""WITH {marked(gap)} SELECT m.detection_id, m.trip, {plates} AS plate, CAST(min(idx) AS INTEGER) AS from_index,
  CAST(max(idx) AS INTEGER) AS to_index, min(t_ms) AS t_start_ms, max(t_ms) AS t_end_ms, CAST(count(*) AS INTEGER) AS events_count
FROM marked m LEFT JOIN votes v USING (detection_id, trip) GROUP BY m.detection_id, m.trip"""


def anchored(source: str, key: str, window: int, more: str = "") -> str:
    """Recursive steps over numbered rows: kept is the time of the last kept row, keep whether this row is kept."""
    return f"""numbered AS (SELECT {key}, t_ms, row_number() OVER (PARTITION BY {key} ORDER BY t_ms) AS rn FROM {source}),
walk AS (SELECT {key}, rn, t_ms, t_ms AS kept, true AS keep FROM numbered WHERE rn = 1
  UNION ALL SELECT n.{key}, n.rn, n.t_ms, CASE WHEN n.t_ms - w.kept > {window} THEN n.t_ms ELSE w.kept END, n.t_ms - w.kept > {window}
  FROM walk w JOIN numbered n ON n.{key} = w.{key} AND n.rn = w.rn + 1){more}"""


NMS = f"""WITH RECURSIVE {PLATED}, {anchored('plated', 'detection_id', 36000000)},
nms AS (SELECT w.detection_id, w.t_ms, p.plate FROM walk w JOIN plated p USING (detection_id, t_ms) WHERE keep)"""
MERGE = f"""{NMS}, numbered2 AS (SELECT *, row_number() OVER (PARTITION BY detection_id ORDER BY t_ms) AS rn FROM nms),
walk2 AS (SELECT detection_id, rn, t_ms, t_ms AS head FROM numbered2 WHERE rn = 1
  UNION ALL SELECT n.detection_id, n.rn, n.t_ms, CASE WHEN n.t_ms - w.head > 90000000 THEN n.t_ms ELSE w.head END
  FROM walk2 w JOIN numbered2 n ON n.detection_id = w.detection_id AND n.rn = w.rn + 1)
SELECT w.detection_id, w.head AS t_ms, arg_min(n.plate, n.t_ms) FILTER (WHERE trim(coalesce(n.plate, '')) <> '') AS plate
FROM walk2 w JOIN numbered2 n USING (detection_id, rn) GROUP BY w.detection_id, w.head"""

MOVING = f"""{SERIES}, moving AS (SELECT video_id, frame_idx, CAST(trunc(frame_idx / CAST(25 AS DOUBLE) * 1000) AS BIGINT) AS ms,
  changed_px / CAST(100000 AS DOUBLE) AS ratio FROM series WHERE frame_idx > 0 AND frame_idx % 2 = 0 AND changed_px >= 20000)"""


six = lambda x: f"floor({x} * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1e6 AS DOUBLE)"
EOF = "greatest(n // 2 * 2 + 1, n)"


def machine(extra_where: str = "", warmup: int = 0, eof: str = EOF, moving: str = MOVING, high: str = "0.55") -> str:
    """The state machine stepped row by row: e is the average, a whether active, s the start, l the last end, t the event."""
    ms = lambda f: f"CAST(trunc(({f}) / CAST(25 AS DOUBLE) * 1000) AS BIGINT)"
    warm = f" AND {ms('greatest(f.s, k.frame_idx - 1)')} > {warmup}" if warmup else ""
    ema = "(CAST(0.45 AS DOUBLE) * k.ratio + (1 - CAST(0.45 AS DOUBLE)) * f.e)"
    low = f"(CAST({high} AS DOUBLE) * CAST(0.9 AS DOUBLE))"
    return f"""{moving}, kept AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS rn FROM moving {extra_where}),
ends AS (SELECT video_id, {eof} AS eof FROM (SELECT video_id, max(frame_idx) AS n FROM series GROUP BY 1)),
fsm AS (SELECT video_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS frame, CAST(0 AS BIGINT) AS ms, CAST(0 AS DOUBLE) AS ratio, CAST(0 AS DOUBLE) AS e,
    false AS a, CAST(-1 AS BIGINT) AS s, CAST(-3 AS BIGINT) AS l, CAST(NULL AS BIGINT) AS t, 'IDLE' AS shown FROM ends
  UNION ALL SELECT video_id, rn, frame_idx, ms, ratio, e2, opens OR (a AND NOT closes), CASE WHEN opens THEN frame_idx ELSE s END,
    CASE WHEN emits THEN frame_idx ELSE l END, CASE WHEN emits THEN {ms('s + (frame_idx - s) // 2')} END,
    CASE WHEN a AND NOT closes THEN 'ACTIVE' ELSE 'IDLE' END
  FROM (SELECT k.video_id, k.rn, k.frame_idx, k.ms, k.ratio, {ema} AS e2, f.a, f.s, f.l,
      NOT f.a AND k.frame_idx - f.l > 2 AND {ema} >= CAST({high} AS DOUBLE) AS opens, f.a AND {ema} < {low} AS closes,
      f.a AND {ema} < {low} AND k.frame_idx - f.s >= 2{warm} AS emits
    FROM fsm f JOIN kept k ON k.video_id = f.video_id AND k.rn = f.rn + 1)),
final AS (SELECT f.* FROM fsm f JOIN (SELECT video_id, max(rn) AS rn FROM fsm GROUP BY 1) USING (video_id, rn)),
found AS (SELECT video_id, t AS t_ms FROM fsm WHERE t IS NOT NULL
  UNION ALL SELECT video_id, {ms('s + (eof - s) // 2')} FROM final JOIN ends USING (video_id) WHERE a AND eof - s >= 2)"""


PIXEL_MOVING = """{PIXELS}, series AS (SELECT CAST(video_id AS BIGINT) AS video_id, CAST(frame AS BIGINT) AS frame_idx, sum(m) AS changed_px FROM grown GROUP BY 1, 2),
moving AS (SELECT video_id, frame_idx, CAST(trunc(frame_idx / CAST(25 AS DOUBLE) * 1000) AS BIGINT) AS ms, changed_px / CAST(64 AS DOUBLE) AS ratio FROM series WHERE changed_px >= 6)"""
TOKENS = f"""{SERIES}, tokens AS (SELECT CAST(video_id * 10000 + frame_idx // 50 AS BIGINT) AS event, CAST(frame_idx % 50 AS INTEGER) AS roi_idx,
  CAST(frame_idx % 3 AS INTEGER) AS offset_ord, raw, changed_px / CAST(5000 AS DOUBLE) AS conf FROM series)"""
MANIFEST = f"{FILES}, manifest AS (SELECT sha256, path FROM files WHERE ord % 7 = 0)"
NEW_FILES = f"""{MANIFEST}, fresh AS (SELECT min(ord) AS ord, arg_min(path, ord) AS path, sha256 FROM files
  WHERE sha256 NOT IN (SELECT sha256 FROM manifest) GROUP BY sha256)"""
URLS = """urls AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN replace(url, '://', '://u:p@') WHEN 1 THEN replace(url, '://', '://u@') ELSE url END AS url FROM pages)"""
CAMERA_LOG = f"""{CAMERAS}, {SERIES}, camera_log AS (
  SELECT id AS seq, id % 40 AS id, 'insert' AS op, name, url, active, CAST(NULL AS BIGINT) AS last_seen_at, CAST(NULL AS VARCHAR) AS last_error FROM cameras
  UNION ALL SELECT event_id + 1000000, event_id * 31 % 40,
    CASE event_id % 7 WHEN 2 THEN 'active' WHEN 3 THEN 'edit' WHEN 5 THEN 'delete' WHEN 6 THEN 'insert' ELSE 'health' END,
    'cam ' || k, 'rtsp://x', event_id % 2 = 0, CASE WHEN event_id % 3 <> 0 THEN t_ms END, CASE WHEN event_id % 3 = 0 THEN 'timeout' END FROM series),
camera_state AS (SELECT id, (array_agg(name ORDER BY seq DESC) FILTER (WHERE op IN ('insert', 'edit')))[1] AS name,
  (array_agg(url ORDER BY seq DESC) FILTER (WHERE op IN ('insert', 'edit')))[1] AS url,
  (array_agg(active ORDER BY seq DESC) FILTER (WHERE op IN ('insert', 'edit', 'active')))[1] AS active,
  (array_agg(last_seen_at ORDER BY seq DESC) FILTER (WHERE op = 'health'))[1] AS last_seen_at,
  (array_agg(last_error ORDER BY seq DESC) FILTER (WHERE op = 'health'))[1] AS last_error
  FROM camera_log GROUP BY id HAVING arg_max(op, seq) <> 'delete')"""
QUEUE = f"""{SERIES}, queue_log AS (SELECT event_id AS seq, event_id // 5 AS task_id,
  CASE k % 7 WHEN 0 THEN 'enqueue' WHEN 1 THEN 'start' WHEN 4 THEN 'done' WHEN 5 THEN 'cancel' WHEN 6 THEN 'fail' ELSE 'progress' END AS op,
  k * 3 - 50 AS progress FROM series),
tasks AS (SELECT task_id, min(seq) FILTER (WHERE op = 'start') AS started, min(seq) FILTER (WHERE op = 'cancel') AS canceled,
  arg_max(op, seq) FILTER (WHERE op IN ('done', 'fail')) AS ended, arg_max(progress, seq) FILTER (WHERE op = 'progress') AS progress
  FROM queue_log GROUP BY task_id),
state AS (SELECT task_id, CASE WHEN canceled IS NOT NULL AND (started IS NULL OR canceled < started) THEN 'CANCELED' WHEN ended = 'done' THEN 'DONE'
  WHEN ended = 'fail' THEN 'FAILED' WHEN started IS NOT NULL THEN 'RUNNING' ELSE 'PENDING' END AS status, coalesce(progress, 0) AS p FROM tasks)"""
REQUESTS = f"""{DETECTIONS}, requests AS (SELECT c_custkey, c_custkey + 1 AS request_id, c_custkey % 400 AS video_id, CAST(1000 * (c_custkey % 7 + 1) AS INTEGER) AS merge_ms FROM customer),
accepted AS (SELECT *, (SELECT max(id) FROM detections) AS last FROM requests r
  WHERE NOT EXISTS (SELECT 1 FROM detections d WHERE d.video_id = r.video_id AND d.merge_ms = r.merge_ms)
  QUALIFY row_number() OVER (PARTITION BY video_id, merge_ms ORDER BY request_id) = 1)"""
DAILY = lambda days: f"""SELECT CAST(created_at AS DATE) AS day, {COUNTED} FROM detections
  WHERE created_at >= (SELECT max(o_orderdate) FROM orders) - INTERVAL {days} DAY GROUP BY 1"""  # noqa: E731
WEEK = f"""{DETECTIONS}, week AS (SELECT CAST(g AS INTEGER) AS iso, count(id) AS detections, CAST(coalesce(sum(events_count), 0) AS BIGINT) AS events
  FROM range(1, 8) r(g) LEFT JOIN detections ON isodow(created_at) = g GROUP BY g)"""
Q3 = "replace(path, '\"', '\"\"')"

# Pictures of 8 x 8: the blur is a 5 x 5 binomial mirrored at the edges, the opening takes neighbours within the picture only.
PIXELS = """pics AS (SELECT label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding[1:64] AS e FROM embeddings),
px AS (SELECT video_id, frame, p // 8 AS y, p % 8 AS x, greatest(0, least(255, floor(CAST(e[p + 1] AS DOUBLE) * 400 + 128))) AS v
  FROM (SELECT *, unnest(range(0, 64)) AS p FROM pics WHERE frame % 2 = 0)),
taps AS (SELECT a.y, a.x, m.d AS dy, n.d AS dx, m.w * n.w AS w FROM (SELECT i // 8 AS y, i % 8 AS x FROM range(0, 64) r(i)) a,
  (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) m(d, w), (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) n(d, w)),
edged AS (SELECT y, x, w, CASE WHEN y + dy < 0 THEN -(y + dy) WHEN y + dy > 7 THEN 14 - (y + dy) ELSE y + dy END AS sy,
  CASE WHEN x + dx < 0 THEN -(x + dx) WHEN x + dx > 7 THEN 14 - (x + dx) ELSE x + dx END AS sx FROM taps),
soft AS (SELECT video_id, frame, edged.y, edged.x, round_even(sum(w * v) / CAST(256 AS DOUBLE), 0) AS v FROM edged JOIN px ON px.y = edged.sy AND px.x = edged.sx GROUP BY ALL),
moved AS (SELECT b.video_id, b.frame, b.y, b.x, CAST(abs(b.v - a.v) > 12 AS INTEGER) AS m FROM soft b JOIN soft a ON a.video_id = b.video_id AND a.frame = b.frame - 2 AND a.y = b.y AND a.x = b.x),
eroded AS (SELECT a.video_id, a.frame, a.y, a.x, min(b.m) AS m FROM moved a JOIN moved b ON b.video_id = a.video_id AND b.frame = a.frame AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY ALL),
grown AS (SELECT a.video_id, a.frame, a.y, a.x, max(b.m) AS m FROM eroded a JOIN eroded b ON b.video_id = a.video_id AND b.frame = a.frame AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY ALL)"""

ORACLES: dict[str, str] = {
    "trips": trips(21600000, "any_value(v.plate)"),
    "trips_time_only": trips(21600000, "CAST(NULL AS VARCHAR)"),
    "trip_plate_vote": f"WITH {marked(144000000)} SELECT detection_id, trip, plate, votes FROM votes",
    "nms_events": f"{NMS} SELECT detection_id, t_ms, plate FROM nms",
    "merge_events": MERGE,
    "heartbeat_throttle": f"WITH RECURSIVE {SERIES}, {anchored('series', 'video_id', 43199999)} SELECT video_id, t_ms FROM walk WHERE keep",
    "motion_filter": f"WITH {MOVING} SELECT video_id, frame_idx, ms, ratio FROM moving",
    "motion_trace": f"WITH RECURSIVE {machine()} SELECT video_id, ms, frame, {six('ratio')} AS ratio, {six('e')} AS ema, shown AS state, "
    "CAST(t IS NOT NULL AS INTEGER) AS event FROM fsm WHERE rn > 0",
    "motion_trace_lines": f"""WITH RECURSIVE {machine()}
SELECT video_id, frame, printf('%d,%d,%.6f,%.6f,%s,%d', ms, frame, {six('ratio')}, {six('e')}, shown, CAST(t IS NOT NULL AS INTEGER)) AS line FROM fsm WHERE rn > 0
UNION ALL SELECT DISTINCT video_id, CAST(-1 AS BIGINT), 'ms,frame,ratio,ema,state,event' FROM fsm WHERE rn > 0""",
    "motion_ema": f"WITH RECURSIVE {machine()} SELECT video_id, frame, {six('e')} AS ema FROM fsm WHERE rn > 0",
    "motion_events": f"WITH RECURSIVE {machine()} SELECT * FROM found",
    "motion_events_warmup": f"WITH RECURSIVE {machine('WHERE ms < 2200', 1000, f'CASE WHEN n >= 56 THEN 56 ELSE {EOF} END')} SELECT * FROM found",
    "summary_counts": "SELECT (SELECT count(*) FROM customer) AS videos, (SELECT count(*) FROM orders) AS detections, (SELECT count(*) FROM lineitem) AS events",
    "week_agg": f"""WITH {WEEK} SELECT iso, ['MONDAY', 'TUESDAY', 'WEDNESDAY', 'THURSDAY', 'FRIDAY', 'SATURDAY', 'SUNDAY'][iso] AS day, detections, events FROM week""",
    "week_heatmap": f"""WITH {WEEK}, r AS (SELECT iso, events, CASE WHEN max(events) OVER () = 0 THEN 0.0 ELSE events / CAST(max(events) OVER () AS DOUBLE) END AS r FROM week),
c AS (SELECT *, CAST(230 - floor(r * 180 + 0.5) AS INTEGER) AS red FROM r)
SELECT iso, events, CAST(40 + floor(r * 240 + 0.5) AS INTEGER) AS width, red, CAST(240 - (230 - red) // 2 AS INTEGER) AS green, 255 AS blue FROM c""",
    "daily_agg": f"WITH {DETECTIONS} {DAILY(30)}",
    "daily_agg_year": f"WITH {DETECTIONS} {DAILY(365)}",
    "video_agg": f"WITH {PAGED} SELECT path, {COUNTED} FROM joined GROUP BY path ORDER BY max(created_at) DESC, path LIMIT 20",
    "merge_agg": f"WITH {DETECTIONS} SELECT merge_ms, {COUNTED} FROM detections GROUP BY 1",
    "detections_page": f"WITH {PAGED} SELECT id, video_id, path, merge_ms, events_count, created_at FROM joined ORDER BY id DESC LIMIT 50 OFFSET 100",
    "recent_detections": f"WITH {PAGED} SELECT id, {ROW} AS row_text FROM joined ORDER BY id DESC LIMIT 200",
    "report_text_filter": f"WITH {PAGED} SELECT * FROM (SELECT id, {ROW} AS row_text FROM joined ORDER BY id DESC LIMIT 500) WHERE contains(lower(row_text), '3 ev')",
    "page_info": """WITH t AS (SELECT count(*) AS total FROM orders) SELECT least(601, total) AS from_row, least(800, total) AS to_row,
  'Showing ' || least(601, total) || '-' || least(800, total) || ' of ' || total AS banner, false AS prev_off, least(800, total) >= total AS next_off FROM t""",
    "page_fallback": """SELECT CAST(p AS INTEGER) AS page, total, CAST(CASE WHEN p * 200 >= total AND p > 0 THEN p - 1 ELSE p END AS INTEGER) AS shown
  FROM (VALUES (0), (1), (74), (75), (76), (10000)) v(p), (SELECT count(*) AS total FROM orders)""",
    "events_of_detection": f"WITH {DET_EVENTS} SELECT * FROM det_events WHERE detection_id = 3",
    "video_path_of_detection": f"WITH {PAGED} SELECT id, path FROM joined WHERE id = 3",
    "event_preview": f"""WITH {DET_EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY detection_id ORDER BY t_ms) AS rn,
  count(*) OVER (PARTITION BY detection_id) AS c FROM det_events)
SELECT detection_id, string_agg({clock('t_ms')}, ', ' ORDER BY t_ms) || CASE WHEN any_value(c) > 3 THEN ' +' || (any_value(c) - 3) || ' more' ELSE '' END AS preview
FROM n WHERE rn <= 3 GROUP BY detection_id""",
    "events_csv_lines": f"""WITH {PAGED}, {DET_EVENTS}, b AS (SELECT t_ms, row_number() OVER (ORDER BY t_ms) AS n FROM det_events WHERE detection_id = 3)
SELECT CAST(0 AS BIGINT) AS ord, 'Detection,3' AS line UNION ALL SELECT 1, 'Video,"' || {Q3} || '"' FROM joined WHERE id = 3
UNION ALL SELECT 2, '' UNION ALL SELECT 3, '#;t_ms;time' UNION ALL SELECT n + 3, n || ';' || t_ms || ';' || {clock('t_ms')} FROM b""",
    "report_csv_lines": f"""WITH {PAGED}, daily AS ({DAILY(365)}), tops AS (SELECT path, {COUNTED} FROM joined GROUP BY path ORDER BY max(created_at) DESC, path LIMIT 1000)
SELECT 'summary' AS section, CAST(1 AS BIGINT) AS ord, (SELECT count(*) FROM customer) || ',' || (SELECT count(*) FROM orders) || ',' || (SELECT count(*) FROM lineitem) AS line
UNION ALL SELECT 'daily', row_number() OVER (ORDER BY day DESC), day || ',' || detections || ',' || events FROM daily
UNION ALL SELECT 'videos', row_number() OVER (ORDER BY path), '"' || {Q3} || '",' || detections || ',' || events FROM tops""",
    "snapshot_plan": f"""WITH {PAGED}, {DET_EVENTS} SELECT path, detection_id, t_ms, greatest(0, t_ms - 700) AS seek_ms,
  'out/' || regexp_extract(path, '([^/]+)[.][^.]+$', 1) || '/det_' || detection_id || '/event_' || t_ms || '.jpg' AS target
FROM joined JOIN det_events ON detection_id = id""",
    "snapshot_tally": f"""WITH {VIDEOS}, {DETECTIONS}, {DET_EVENTS}, p AS (SELECT greatest(0, t_ms - 700) < CAST(trunc(frames / fps * 1000) AS BIGINT) * 50 AS ok
  FROM det_events JOIN detections d ON d.id = detection_id JOIN videos v ON v.id = d.video_id)
SELECT count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE ok IS NOT TRUE) AS failed FROM p""",
    "snapshot_sql": f"""WITH {PAGED}, {DET_EVENTS} SELECT path AS video_path, t_ms, id AS detection_id, t_ms % 10 AS event_id
FROM joined JOIN det_events ON detection_id = id WHERE merge_ms = 1000""",
    "detection_event_counts": f"""WITH {DETECTIONS}, s AS (SELECT id, CAST(events_count + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS INTEGER) AS events_count FROM detections)
SELECT events_count, count(*) AS n, count(*) FILTER (WHERE events_count <> coalesce(r, 0)) AS wrong
FROM s LEFT JOIN (SELECT l_orderkey, count(*) AS r FROM lineitem GROUP BY 1) ON l_orderkey = id GROUP BY 1""",
    "plate_normalize": f"WITH {SERIES} SELECT event_id, raw, {plate('raw')} AS plate FROM series",
    "plate_normalize_region": f"WITH {SERIES}, x AS (SELECT event_id, raw || (event_id % 1000) AS raw FROM series) SELECT event_id, {plate('raw', True)} AS plate FROM x",
    "plate_kind": f"WITH {SERIES}, x AS (SELECT event_id, coalesce({plate('raw')}, '') AS p FROM series) SELECT event_id, {kind('p')} AS kind FROM x",
    "plate_shape_score": f"WITH {SERIES}, x AS (SELECT event_id, coalesce({compact('raw')}, '') AS p FROM series) SELECT event_id, {shape('p')} AS score FROM x",
    "plate_loose_equal": f"""WITH {SERIES}, x AS (SELECT event_id, coalesce({plate('raw')}, '') AS a FROM series), y AS (SELECT *, translate(a, 'AO', 'HH') AS b FROM x)
SELECT event_id, a = b OR (length(a) >= 6 AND left(a, length(a) - 2) = left(b, length(b) - 2)
  AND replace(right(a, 2), 'H', 'O') = replace(right(b, 2), 'H', 'O')) AS same FROM y""",
    "fmt_ms": f"WITH {SERIES}, x AS (SELECT event_id, t_ms % 500000000 AS m FROM series) SELECT event_id, {clock('m')} AS clock FROM x",
    "mask_url": f"""WITH {URLS} SELECT page_id, CASE WHEN regexp_matches(url, '://[^@]*:[^@]*@') THEN regexp_replace(url, '://[^@]*@', '://*****@') ELSE url END AS masked FROM urls""",
    "camera_url_class": f"""WITH {URLS}, {CAMERAS}, b AS (SELECT * FROM urls UNION ALL SELECT id, url FROM cameras)
SELECT page_id, url, CASE WHEN url ILIKE '%youtube.com%' OR url ILIKE '%youtu.be%' THEN 'youtube' WHEN url ILIKE 'rtsp://%' THEN 'rtsp'
  WHEN url ILIKE 'http://%' OR url ILIKE 'https://%' THEN 'http' ELSE 'file' END AS kind FROM b""",
    "parse_detection_id": f"""WITH {PAGED} SELECT id, CAST(CASE WHEN id % 5 IN (0) THEN NULL WHEN id % 5 = 1 THEN id ELSE id END AS INTEGER) AS parsed
FROM joined""",
    "ocr_token_clean": f"WITH {SERIES} SELECT event_id, {clean('''raw || '-' ''')} AS token FROM series",
    "camera_error_text": "SELECT page_id, left(html, 1000) AS last_error FROM pages",
    "ocr_line_fold": "SELECT page_id, nullif(trim(translate(html, chr(10) || chr(13), '  ')), '') AS line FROM pages",
    "parallel_lists": f"WITH {PLATED} SELECT detection_id, t_ms, CASE WHEN detection_id % 3 > 0 THEN coalesce(plate, '') END AS plate FROM plated",
    "undefined_plates": f"WITH {SERIES} SELECT coalesce(nullif(trim(raw), ''), 'undefined') AS label, count(*) AS n FROM series GROUP BY 1",
    "ocr_snapshot_frames": f"""WITH {SERIES}, {VIDEOS} SELECT event_id, CAST(o AS INTEGER) AS offset_ord,
  greatest(0, least(frames - 1, frame_idx + s * 25)) AS frame FROM series JOIN videos ON id = video_id, (VALUES (0, 0), (1, -4), (2, 4)) f(o, s)""",
    "roi_grid": """WITH a AS (SELECT * FROM (SELECT unnest([0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85]) AS fx, generate_subscripts([0, 1, 2, 3, 4, 5, 6, 7, 8], 1) - 1 AS i),
  (SELECT unnest([0.12, 0.18, 0.25]) AS fw, generate_subscripts([0, 1, 2], 1) - 1 AS j), (SELECT unnest([0.35, 0.45, 0.55, 0.65]) AS fy, generate_subscripts([0, 1, 2, 3], 1) - 1 AS k),
  (SELECT unnest([0.08, 0.12, 0.18]) AS fh, generate_subscripts([0, 1, 2], 1) - 1 AS l)),
z AS (SELECT DISTINCT CAST(p_size * 16 + 640 AS INTEGER) AS width, CAST(floor((p_size * 16 + 640) * 9 / CAST(16 AS DOUBLE)) AS INTEGER) AS height FROM part),
b AS (SELECT width, height, CAST(((i * 3 + j) * 4 + k) * 3 + l AS INTEGER) AS roi_idx, CAST(floor(width * CAST(fx AS DOUBLE) + 0.5) AS BIGINT) AS rx,
  CAST(floor(height * CAST(fy AS DOUBLE) + 0.5) AS BIGINT) AS ry, CAST(floor(width * CAST(fw AS DOUBLE) + 0.5) AS BIGINT) AS w, CAST(floor(height * CAST(fh AS DOUBLE) + 0.5) AS BIGINT) AS h FROM a, z)
SELECT width, height, roi_idx, rx, ry, least(w, width - rx) AS rw, least(h, height - ry) AS rh FROM b""",
    "roi_quality_gate": f"""WITH {SERIES} SELECT event_id, changed_px / CAST(500000 AS DOUBLE) >= 0.1 AND (changed_px % 1000) / CAST(1000 AS DOUBLE) BETWEEN 0.01 AND 0.9 AS passes FROM series""",
    "ocr_budget": f"WITH {TOKENS} SELECT event, offset_ord, roi_idx, row_number() OVER (PARTITION BY event ORDER BY offset_ord, roi_idx) AS call FROM tokens QUALIFY call <= 20",
    "roi_best_plate": f"""WITH {TOKENS}, r AS (SELECT event, roi_idx, {plate('raw')} AS norm FROM tokens WHERE roi_idx < 40),
v AS (SELECT *, count(*) OVER (PARTITION BY event, norm ORDER BY roi_idx) AS v, {kind("norm")} AS kind FROM r),
s AS (SELECT *, min(CASE WHEN norm IS NOT NULL AND ((v >= 2 AND length(norm) >= 6) OR length(norm) >= 8) THEN roi_idx END) OVER (PARTITION BY event) AS stop,
  row_number() OVER (PARTITION BY event ORDER BY norm IS NOT NULL DESC, length(norm) DESC NULLS LAST, kind DESC, roi_idx) AS rk FROM v)
SELECT event, coalesce(max(CASE WHEN roi_idx = stop THEN norm END), max(CASE WHEN rk = 1 THEN norm END)) AS plate FROM s GROUP BY event""",
    "roi_read_in_rounds": f"""WITH {TOKENS}, r AS (SELECT event, roi_idx, {plate('raw')} AS norm, row_number() OVER (PARTITION BY event ORDER BY roi_idx) AS call FROM tokens WHERE roi_idx < 40),
v AS (SELECT *, count(*) OVER (PARTITION BY event, norm ORDER BY roi_idx) AS v, {kind("norm")} AS kind FROM r),
s AS (SELECT *, min(CASE WHEN norm IS NOT NULL AND ((v >= 2 AND length(norm) >= 6) OR length(norm) >= 8) THEN call END) OVER (PARTITION BY event) AS stop,
  row_number() OVER (PARTITION BY event ORDER BY norm IS NOT NULL DESC, length(norm) DESC NULLS LAST, kind DESC, roi_idx) AS rk FROM v)
SELECT event, coalesce(max(CASE WHEN call = stop THEN norm END), max(CASE WHEN rk = 1 THEN norm END)) AS plate,
  CAST(least(max(call), coalesce(CASE WHEN min(stop) <= 1 THEN 1 WHEN min(stop) <= 3 THEN 3 WHEN min(stop) <= 7 THEN 7 WHEN min(stop) <= 15 THEN 15 WHEN min(stop) <= 31 THEN 31 END, 40)) AS BIGINT) AS calls
FROM s GROUP BY event""",
    "event_plate_first_offset": f"""WITH {TOKENS}, f AS (SELECT event, offset_ord, max({plate('raw')}) AS plate FROM tokens GROUP BY ALL)
SELECT event, (array_agg(plate ORDER BY offset_ord) FILTER (WHERE plate IS NOT NULL))[1] AS plate FROM f GROUP BY event""",
    "ocr_best_token": f"""WITH RECURSIVE {TOKENS}, f AS (SELECT event, roi_idx, {clean('raw')} AS text, conf FROM tokens),
n AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY roi_idx) AS rn FROM f WHERE length(text) BETWEEN 3 AND 10),
w AS (SELECT event, rn, text, CAST(trunc(conf) AS INTEGER) AS c FROM n WHERE rn = 1
  UNION ALL SELECT n.event, n.rn, CASE WHEN n.conf > w.c THEN n.text ELSE w.text END, CASE WHEN n.conf > w.c THEN CAST(trunc(n.conf) AS INTEGER) ELSE w.c END
  FROM w JOIN n ON n.event = w.event AND n.rn = w.rn + 1)
SELECT event, text FROM w QUALIFY row_number() OVER (PARTITION BY event ORDER BY rn DESC) = 1""",
    "ocr_choose_candidate": f"""WITH {TOKENS}, f AS (SELECT event, roi_idx, {clean('raw')} AS text FROM tokens)
SELECT event, text FROM f WHERE length(text) >= 3 QUALIFY row_number() OVER (PARTITION BY event ORDER BY {shape('text')} DESC, length(text) DESC, roi_idx) = 1""",
    "otsu_threshold": f"""WITH {SERIES}, h AS (SELECT video_id, CAST(changed_px // 2000 AS INTEGER) AS level, count(*) AS n FROM series GROUP BY ALL),
s AS (SELECT video_id, level, CAST(sum(n) OVER w AS DOUBLE) AS w0, CAST(sum(level * n) OVER w AS DOUBLE) AS s0,
  CAST(sum(n) OVER (PARTITION BY video_id) AS DOUBLE) AS t, CAST(sum(level * n) OVER (PARTITION BY video_id) AS DOUBLE) AS a FROM h
  WINDOW w AS (PARTITION BY video_id ORDER BY level ROWS UNBOUNDED PRECEDING))
SELECT video_id, level AS threshold FROM s WHERE w0 < t
QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(w0 * (t - w0) * (s0 / w0 - (a - s0) / (t - w0)) ** 2, 3) DESC, level) = 1""",
    "perf_summary": f"""WITH {TOKENS}, c AS (SELECT event, count(raw) AS calls, CAST(sum(floor(conf * 10)) AS BIGINT) AS ms FROM tokens GROUP BY event)
SELECT event, calls, ms, CASE WHEN calls > 0 THEN ms // calls ELSE 0 END AS avg_ms FROM c""",
    "ingest_pattern_filter": f"WITH {FILES} SELECT ord, path FROM files WHERE path LIKE '%.mp4' OR path LIKE '%.mkv' OR path LIKE '%.ts'",
    "manifest_parse": f"WITH {MANIFEST} SELECT sha256, path, CAST(1200 AS BIGINT) AS duration_ms FROM manifest",
    "manifest_append": f"""WITH {NEW_FILES} SELECT sha256 || ' ' || path || ' duration=1200ms' AS value FROM manifest
UNION ALL SELECT sha256 || ' ' || path || ' duration=' || (ord * 40) || 'ms' FROM fresh""",
    "ingest_new_files": f"WITH {NEW_FILES} SELECT ord, path, sha256 FROM fresh",
    "inbox_collisions": f"""WITH {NEW_FILES}, n AS (SELECT *, regexp_extract(path, '([^/]+)$', 1) AS file_name FROM fresh)
SELECT file_name, count(*) AS n, arg_max(path, ord) AS stays FROM n GROUP BY 1 HAVING count(*) > 1""",
    "video_duration_ms": f"WITH {VIDEOS} SELECT id, CAST(trunc(frames / fps * 1000) AS BIGINT) AS duration_ms FROM videos",
    "upsert_videos": f"""WITH {DETECTIONS} SELECT '/inbox/' || (video_id % 500) || '.mp4' AS path, min(id) AS id, arg_max(merge_ms / CAST(100 AS DOUBLE), id) AS fps,
  arg_max(events_count, id) AS frames, arg_min(created_at, id) AS created_at FROM detections GROUP BY 1""",
    "stored_detections": f"""WITH {REQUESTS} SELECT CAST(last + request_id AS INTEGER) AS id, CAST(video_id AS INTEGER) AS video_id, merge_ms,
  CAST(c_custkey % 4 AS INTEGER) AS events_count FROM accepted
UNION ALL SELECT CAST(id AS INTEGER), CAST(video_id AS INTEGER), merge_ms, events_count FROM detections""",
    "stored_events_left": """SELECT CAST(l_orderkey AS INTEGER) AS detection_id, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE o_custkey % 3 <> 0 GROUP BY 1""",
    "stored_videos": f"""WITH {VIDEOS}, old AS (SELECT CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS n, * FROM videos)
SELECT n AS id, path, CASE WHEN id % 3 = 0 THEN CAST(30 AS DOUBLE) ELSE fps END AS fps, frames + CAST(id % 3 = 0 AS BIGINT) AS frames, '2024-01-01' AS created FROM old
UNION ALL SELECT CAST((SELECT count(*) FROM videos) + row_number() OVER (ORDER BY '/new/' || id) AS INTEGER), '/new/' || id, fps, frames, '2024-01-02' FROM videos WHERE id % 5 = 0""",
    "stored_upgrade": f"""WITH {DETECTIONS}, {DET_EVENTS}, kept AS (SELECT * FROM detections
  QUALIFY row_number() OVER (PARTITION BY video_id, merge_ms ORDER BY created_at DESC, id DESC) = 1)
SELECT CAST(id AS INTEGER) AS id, CAST(video_id AS INTEGER) AS video_id, merge_ms, (SELECT count(*) FROM det_events WHERE detection_id = kept.id) AS n_events,
  CAST(0 AS BIGINT) AS n_plates, 6 AS version FROM kept""",
    "dedup_detections": f"WITH {DETECTIONS} SELECT * FROM detections QUALIFY row_number() OVER (PARTITION BY video_id, merge_ms ORDER BY created_at DESC, id DESC) = 1",
    "insert_detections": f"""WITH {REQUESTS} SELECT CAST(last + request_id AS INTEGER) AS id, CAST(video_id AS INTEGER) AS video_id, merge_ms,
  CAST(c_custkey % 4 AS INTEGER) AS events_count FROM accepted""",
    "insert_detection_events": f"""WITH {REQUESTS}, u AS (SELECT *, unnest(range(0, c_custkey % 4)) AS n FROM accepted WHERE c_custkey % 4 > 0)
SELECT last + request_id AS detection_id, CAST(c_custkey * 1000 + 10 * (n + 1) AS BIGINT) AS t_ms,
  CASE WHEN n = 0 AND c_custkey % 5 > 0 AND c_custkey % 3 > 0 THEN 'A' || c_custkey END AS plate FROM u""",
    "insert_detections_refused": f"WITH {REQUESTS} SELECT request_id, video_id, merge_ms FROM requests WHERE request_id NOT IN (SELECT request_id FROM accepted)",
    "detection_conflicts": f"WITH {DETECTIONS} SELECT id, video_id, merge_ms FROM detections QUALIFY row_number() OVER (PARTITION BY video_id, merge_ms ORDER BY id) > 1",
    "delete_detection_cascade": """SELECT l_orderkey AS detection_id, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 3 <> 0 GROUP BY 1""",
    "list_cameras": f"WITH {CAMERAS} SELECT * FROM cameras",
    "camera_state": f"WITH {CAMERA_LOG} SELECT * FROM camera_state",
    "camera_name_conflicts": f"WITH {CAMERA_LOG} SELECT lower(name) AS name_key, count(*) AS n FROM camera_state GROUP BY 1 HAVING count(*) > 1",
    "cameras_to_start": f"WITH {CAMERAS} SELECT id, name FROM cameras WHERE active AND id % 4 <> 0",
    "queue_state": f"""WITH {QUEUE} SELECT task_id, status, CAST(CASE status WHEN 'CANCELED' THEN 0 WHEN 'DONE' THEN 100 ELSE greatest(0, least(100, p)) END AS INTEGER) AS progress FROM state""",
    "queue_unfinished": f"WITH {QUEUE} SELECT task_id FROM state WHERE status IN ('PENDING', 'RUNNING')",
    "queue_processed": f"""WITH {QUEUE}, u AS (SELECT task_id FROM state WHERE status IN ('PENDING', 'RUNNING'))
SELECT task_id, 'start' AS op, 0 AS progress, CAST(NULL AS VARCHAR) AS error FROM u
UNION ALL SELECT task_id, CASE WHEN task_id % 5 = 0 THEN 'fail' ELSE 'done' END, CASE WHEN task_id % 5 = 0 THEN 0 ELSE 100 END,
  CASE WHEN task_id % 5 = 0 THEN left('task ' || task_id || ' ' || repeat('x', 2000), 1000) END FROM u""",
    "queue_stream": f"""WITH {QUEUE}, asked AS (SELECT task_id, CASE WHEN seq % 5 < 2 THEN 1 ELSE 2 END AS run, seq, op IN ('cancel', 'fail', 'done') AS cancels FROM queue_log),
first AS (SELECT * FROM (SELECT task_id, run, min(seq) AS seq FROM asked WHERE NOT cancels GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY run) = 1),
settled AS (SELECT task_id, EXISTS (SELECT 1 FROM asked a WHERE a.task_id = f.task_id AND a.run = f.run AND a.seq > f.seq AND cancels) AS canceled FROM first f)
SELECT task_id, CASE WHEN canceled THEN 'CANCELED' WHEN task_id % 5 = 0 THEN 'FAILED' ELSE 'DONE' END AS status,
  CASE WHEN canceled OR task_id % 5 = 0 THEN 0 ELSE 100 END AS progress,
  CASE WHEN NOT canceled AND task_id % 5 = 0 THEN left('task ' || task_id || ' ' || repeat('x', 2000), 1000) END AS error FROM settled""",
    "queue_progress": f"WITH {QUEUE} SELECT seq, CAST(greatest(0, least(100, progress)) AS INTEGER) AS progress FROM queue_log",
    "snapshot_csv_parse": f"""WITH {SERIES} SELECT event_id AS ord, '/v' || video_id || '.mp4' AS video_path, t_ms, CAST(video_id AS VARCHAR) AS detection_id,
  CAST(event_id AS VARCHAR) AS event_id FROM series WHERE event_id <> 0 AND k % 10 <> 0""",
    "frame_differences": """WITH p AS (SELECT vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings)
SELECT vec_id, CAST(len(list_filter(list_zip(embedding, before), lambda x: abs(x[1] - x[2]) > 0.05)) AS BIGINT) AS changed FROM p WHERE before IS NOT NULL""",
    "pixel_changes": f"""WITH {PIXELS} SELECT CAST(video_id AS BIGINT) AS video_id, CAST(frame AS BIGINT) AS frame_idx, CAST(sum(m) AS BIGINT) AS changed_px,
  CAST(64 AS BIGINT) AS total_px FROM grown GROUP BY ALL""",
    "snapshot_files": f"""WITH {SERIES}, pics AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding[1:64] AS e FROM embeddings),
luma AS (SELECT label, frame, string_agg(lpad(hex(CAST(greatest(0, least(255, floor(CAST(e[p + 1] AS DOUBLE) * 400 + 128))) AS BIGINT)), 2, '0'), '' ORDER BY p) AS h
  FROM (SELECT *, unnest(range(0, 64)) AS p FROM pics) GROUP BY 1, 2)
SELECT 'v' || (event_id % 10) || '/det_' || video_id || '/event_' || event_id || '.pgm' AS name, CAST(75 AS BIGINT) AS length,
  sha256(unhex('50350A3820380A3235350A' || h)) AS sha256 FROM series JOIN luma ON label = event_id % 10 AND frame = greatest(0, k * 40 - 700) * 25 // 1000""",
    "inbox_files": f"""WITH {NEW_FILES}, last AS (SELECT max(ord) AS ord FROM fresh GROUP BY regexp_extract(path, '([^/]+)$', 1))
SELECT regexp_extract(path, '([^/]+)$', 1) AS name, CAST(strlen(coalesce(content, '')) AS BIGINT) AS length, files.sha256 AS sha256 FROM last JOIN files USING (ord)""",
    "frame_scan": f"""WITH {PIXELS}, rows_of AS (SELECT video_id, frame, string_agg(lpad(hex(CAST(v AS BIGINT)), 2, '0'), '' ORDER BY y, x) AS luma FROM px GROUP BY 1, 2)
SELECT CAST(video_id AS BIGINT) AS video_id, CAST(frame AS BIGINT) AS frame_idx, CAST(frame * 40 AS BIGINT) AS ms, 8 AS width, 8 AS height, luma FROM rows_of WHERE frame BETWEEN 3 AND 40""",
    "frame_events": f"""WITH RECURSIVE {machine(moving=PIXEL_MOVING.replace('{PIXELS}', PIXELS), high='0.4')} SELECT * FROM found""",
    "wanted_frames": f"WITH {SERIES} SELECT video_id, frame_idx, changed_px FROM series WHERE frame_idx % 3 = 0",
    "trips_stream": f"""WITH {marked(21600000)} SELECT detection_id, min(t_ms) AS t_start_ms, max(t_ms) AS t_end_ms, count(*) AS events_count FROM marked GROUP BY detection_id, trip""",
    "heartbeat_throttle_stream": f"""WITH RECURSIVE {SERIES}, {anchored('series', 'video_id', 43199999)}
SELECT video_id AS camera_id, t_ms FROM walk WHERE keep""",
    "camera_log_stream": f"""WITH {SERIES} SELECT video_id AS camera_id, count(*) AS lines, count(*) FILTER (WHERE event_id % 3 = 0) AS errors,
  max(t_ms) AS last_ms, CAST(1 + (count(*) > 10)::INTEGER AS BIGINT) AS batches FROM series GROUP BY 1""",
    "heartbeat_stream": "SELECT user_id AS camera_id, epoch_us(max(ts)) // 1000 AS last_seen_ms, count(*) AS beats FROM events GROUP BY 1",
    "camera_retries": """WITH b AS (SELECT user_id AS camera_id, epoch_us(ts) // 1000 AS t FROM events),
n AS (SELECT *, lead(t) OVER w AS nxt, lag(t) OVER w AS prv FROM b WINDOW w AS (PARTITION BY camera_id ORDER BY t)),
tries(k, after, wait) AS (VALUES (1, 12, 2), (2, 14, 4), (3, 18, 8), (4, 26, 0))
SELECT camera_id, CAST(t + after * 3600000 AS BIGINT) AS at_ms, CASE WHEN k = 4 THEN 'STOPPED' ELSE 'ERROR' END AS state, CAST(k AS INTEGER) AS retries,
  CAST(wait * 3600000 AS BIGINT) AS wait_ms, t AS last_seen_ms FROM n, tries WHERE nxt IS NULL OR t + after * 3600000 < nxt
UNION ALL SELECT camera_id, t, 'OK', 0, 0, t FROM n WHERE t - prv > 43200000""",
}
_lines = ORACLES["motion_trace_lines"].removeprefix("WITH RECURSIVE ")
_steps, _, _rows = _lines.partition("\nSELECT video_id, frame, printf")
ORACLES["trace_files"] = f"""WITH RECURSIVE {_steps}, lines AS (SELECT video_id, frame, printf{_rows}),
whole AS (SELECT video_id, string_agg(line || chr(10), '' ORDER BY frame) AS t FROM lines GROUP BY 1)
SELECT video_id || '.csv' AS name, CAST(strlen(t) AS BIGINT) AS length, sha256(t) AS sha256 FROM whole"""
ORACLES["live_trips"] = ORACLES["trips"]
