"""DuckDB SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

HOUR = 3_600_000_000_000
DAY = 24 * HOUR
EV = """ev AS (
  SELECT user_id AS episode, event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, event_type AS topic, round(value * 100)::BIGINT AS cents, props AS payload FROM events)"""


def activity(name: str, topics: str, gap: int) -> str:
    return f"""{name}_g AS (
  SELECT episode, ts_ns, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY episode ORDER BY ts_ns) > {gap} THEN 1 ELSE 0 END AS brk FROM ev WHERE topic IN ({topics})),
{name}_r AS (SELECT *, sum(brk) OVER (PARTITION BY episode ORDER BY ts_ns ROWS UNBOUNDED PRECEDING) AS run FROM {name}_g),
{name} AS (SELECT episode, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns FROM {name}_r GROUP BY episode, run HAVING min(ts_ns) < max(ts_ns))"""


def merged(name: str, source: str) -> str:
    return f"""{name}_m AS (
  SELECT *, CASE WHEN max(end_ns) OVER (PARTITION BY episode ORDER BY start_ns, end_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start_ns THEN 0 ELSE 1 END AS fresh FROM {source}),
{name}_n AS (SELECT *, sum(fresh) OVER (PARTITION BY episode ORDER BY start_ns, end_ns ROWS UNBOUNDED PRECEDING) AS g FROM {name}_m),
{name} AS (SELECT episode, min(start_ns) AS start_ns, max(end_ns) AS end_ns FROM {name}_n GROUP BY episode, g)"""


def pairwise(name: str, a: str, b: str) -> str:
    """Intersection by pairs."""
    both = f"""{name}_p AS (
  SELECT a.episode, greatest(a.start_ns, b.start_ns) AS start_ns, least(a.end_ns, b.end_ns) AS end_ns
  FROM {a} a JOIN {b} b ON a.episode = b.episode AND a.start_ns < b.end_ns AND b.start_ns < a.end_ns)"""
    return f"{both},\n{merged(name, f'{name}_p')}"


def minus(name: str, a: str, b: str) -> str:
    """Elementary regions of a that lie in no interval of b."""
    return f"""{name}_t AS (
  SELECT episode, start_ns AS t FROM {a} UNION SELECT episode, end_ns FROM {a} UNION SELECT episode, start_ns FROM {b} UNION SELECT episode, end_ns FROM {b}),
{name}_c AS (SELECT episode, t AS start_ns, lead(t) OVER (PARTITION BY episode ORDER BY t) AS end_ns FROM {name}_t),
{name}_k AS (
  SELECT c.episode, c.start_ns, c.end_ns FROM {name}_c c
  WHERE EXISTS (SELECT 1 FROM {a} x WHERE x.episode = c.episode AND x.start_ns <= c.start_ns AND c.end_ns <= x.end_ns)
    AND NOT EXISTS (SELECT 1 FROM {b} y WHERE y.episode = c.episode AND y.start_ns <= c.start_ns AND c.end_ns <= y.end_ns)),
{merged(name, f'{name}_k')}"""


ALL = "'click', 'error', 'purchase', 'signup', 'view'"
TWO = f"{activity('a', chr(39) + 'view' + chr(39), 48 * HOUR)},\n{activity('b', chr(39) + 'click' + chr(39), 72 * HOUR)}"
INACTIVE = f"""{activity('a', "'view'", 48 * HOUR)}, {activity('b', "'click', 'purchase'", 72 * HOUR)},
s AS (SELECT episode, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns FROM ev WHERE topic = 'view' GROUP BY episode HAVING min(ts_ns) < max(ts_ns)),
{pairwise('ab', 'a', 'b')}, {pairwise('o', 'ab', 's')}"""


def thinned(source: str, keys: str, keep: str, last: str, first: str) -> str:
    """Rows of ``source`` walked in order: n (rank), keep and last by recursion."""
    same = " AND ".join(f"w.{k} = r.{k}" for k in keys.split(", "))
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts_ns, seq) AS n FROM {source}),
w AS (
  SELECT r.*, {keep.format(last=first)} AS keep, CASE WHEN {keep.format(last=first)} THEN {last.format(last=first)} ELSE {first} END AS last FROM r WHERE n = 1
  UNION ALL
  SELECT r.*, {keep.format(last='w.last')}, CASE WHEN {keep.format(last='w.last')} THEN {last.format(last='w.last')} ELSE w.last END FROM w JOIN r ON {same} AND r.n = w.n + 1)"""


THIN = {"keep": f"r.ts_ns - {{last}} >= {12 * HOUR}", "last": "r.ts_ns", "first": "0::BIGINT"}


def bins(source: str, filled: bool) -> str:
    rows = f"""e AS (SELECT *, min(ts_ns) OVER (PARTITION BY episode) AS t0 FROM {source}),
f AS (SELECT *, (ts_ns - t0) // {DAY} AS b FROM e),
g AS (SELECT episode, min(t0) AS t0, unnest(range(0, max(b) + 1)) AS b FROM f GROUP BY episode),
h AS (
  SELECT g.episode, g.b, g.t0,
    (SELECT arg_max(f.seq, (f.ts_ns, f.seq)) FROM f WHERE f.episode = g.episode AND f.topic = 'view' AND f.b <= g.b) AS state,
    (SELECT string_agg(f.seq::VARCHAR, ',' ORDER BY f.ts_ns, f.seq) FROM f WHERE f.episode = g.episode AND f.topic IN ('click', 'purchase') AND f.b = g.b) AS actions
  FROM g)"""
    return f"""{rows}
SELECT episode, b::INTEGER AS bin_idx, t0 + b * {DAY} AS timestamp_ns, state::VARCHAR AS state, coalesce(actions, '') AS actions FROM h{' WHERE actions IS NOT NULL' if filled else ''}"""


MOUSE = """mo AS (
  SELECT seq, ts_ns, topic, cents - 2500 AS dx, seq % 4500 - 2250 AS dy, seq % 4096 AS flags, seq % 256 AS vk, CASE WHEN seq % 2 = 0 THEN 'press' ELSE 'release' END AS act,
    CASE WHEN seq % 5 = 0 THEN seq % 17 - 8 ELSE 0 END AS notch FROM ev),
mq AS (SELECT *, ts_ns // 10000000 AS tick, greatest(-1999, least(1999, dx)) AS cx, greatest(-1999, least(1999, dy)) AS cy,
    (greatest(-2000, least(1999, dx)) + 4000) % 4000 AS ux, (greatest(-2000, least(1999, dy)) + 4000) % 4000 AS uy, lower(printf('%03x', flags)) AS hx FROM mo)"""


def compact_axis(v: str) -> str:
    return f"CASE WHEN {v} < 0 THEN '<SIGN_MINUS>' ELSE '<SIGN_PLUS>' END || '<' || array_to_string(string_split(printf('%04d', abs({v})), ''), '><') || '>'"


CODES = f"""co AS (
  SELECT *, '<' || array_to_string(string_split(printf('%03d', tick % 1000), ''), '><') || '>' AS tc,
    '<' || ((tick % 1600) // 100) || '><' || ((tick % 100) // 10) || '><' || (tick % 10) || '>' AS ti FROM mq),
cd AS (
  SELECT seq, '<EVENT_START><KEYBOARD>' || tc || '<VK_' || vk || '><' || act || '><EVENT_END>' AS kc, '<EVENT_START><KEYBOARD>' || ti || '<' || vk || '><' || act || '><EVENT_END>' AS ki,
    '<EVENT_START><SCREEN>' || tc || '<fake_image_placeholder><EVENT_END>' AS sc, '<EVENT_START><SCREEN>' || ti || '<fake_image_placeholder><EVENT_END>' AS si,
    '<EVENT_START><MOUSE>' || tc || {compact_axis('cx')} || {compact_axis('cy')} || '<MB_' || hx[1] || '><MB_' || hx[2] || '><MB_' || hx[3] || '>'
      || CASE WHEN notch <> 0 THEN CASE WHEN notch < 0 THEN '<SIGN_MINUS>' ELSE '<SIGN_PLUS>' END || '<' || abs(notch) || '>' ELSE '' END || '<EVENT_END>' AS mc,
    '<EVENT_START><MOUSE>' || ti || '<' || (ux // 2000) || '><' || (uy // 2000) || '><' || (ux % 2000 // 100) || '><' || (uy % 2000 // 100) || '><' || (ux % 100 // 10) || '><' || (uy % 100 // 10)
      || '><' || (ux % 10) || '><' || (uy % 10) || '><' || hx[1] || '><' || hx[2] || '><' || hx[3] || '>'
      || CASE WHEN notch <> 0 THEN '<' || ((notch + 20) % 20 // 10) || '><' || ((notch + 20) % 10) || '>' ELSE '' END || '<EVENT_END>' AS mi
  FROM co)"""

KEYS = "ke AS (SELECT *, seq % 3 AS key, topic = 'view' AS p FROM ev WHERE topic IN ('view', 'click'))"
CLICKS = f"""{KEYS},
kl AS (SELECT *, lag(p) OVER o AS was, lag(ts_ns) OVER o AS was_ns FROM ke WINDOW o AS (PARTITION BY episode, key ORDER BY ts_ns, p))"""


def clicks(least: int) -> str:
    return f"ck AS (SELECT episode, key, was_ns AS start_ns, greatest(ts_ns, was_ns + {least}) AS end_ns FROM kl WHERE NOT p AND was)"


def srt(v: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {v} // 3600000, {v} // 60000 % 60, {v} // 1000 % 60, {v} % 1000)"


W = f"WITH {EV}"
R = f"WITH RECURSIVE {EV}"

ORACLE: dict[str, str] = {
    "active_bins": f"{W}, {activity('i', ALL, DAY)},\nx AS (SELECT ev.* FROM ev JOIN i ON ev.episode = i.episode AND ev.ts_ns >= i.start_ns AND ev.ts_ns < i.end_ns),\n{bins('x', False)}",
    "scan_topics_range": f"{W} SELECT episode, seq, ts_ns, topic FROM ev WHERE topic IN ('click', 'purchase') AND ts_ns >= 1704412800000000000 AND ts_ns < 1704412800000000000 + {7 * DAY}",
    "first_rows": f"{W} SELECT episode, seq, ts_ns, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d %H:%M:%S.%g') AS utc FROM ev WHERE topic <> 'view' ORDER BY ts_ns, episode, seq LIMIT 100",
    "log_summary": f"""{W} SELECT episode, count(*) AS messages, count(DISTINCT topic) AS topics, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, 0::INTEGER AS is_total, max(ts_ns) - min(ts_ns) AS duration_ns FROM ev GROUP BY episode
UNION ALL SELECT NULL, count(*), count(DISTINCT topic), min(ts_ns), max(ts_ns), 1, max(ts_ns) - min(ts_ns) FROM ev""",
    "channel_counts": f"{W} SELECT episode, topic, count(*) AS messages, true AS consistent FROM ev GROUP BY episode, topic",
    "activity_intervals": f"{W}, {activity('i', ALL, DAY)} SELECT * FROM i",
    "interval_intersect": f"{W}, {TWO}, {pairwise('o', 'a', 'b')} SELECT * FROM o",
    "interval_union": f"{W}, {TWO}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b), {merged('o', 'u')} SELECT * FROM o",
    "interval_subtract": f"{W}, {TWO}, {minus('o', 'a', 'b')} SELECT * FROM o",
    "interval_totals": f"""{W}, {activity('i', ALL, DAY)}, t AS (SELECT episode, count(*) AS n, sum(end_ns - start_ns)::BIGINT AS total_ns FROM i GROUP BY episode)
SELECT episode, n, total_ns, CASE WHEN total_ns // 1000000000 < 60 THEN (total_ns // 1000000000) || '.00 s' WHEN total_ns // 1000000000 < 3600 THEN printf('%d.%02d min', (total_ns // 1000000000 * 100 + 30) // 60 // 100, (total_ns // 1000000000 * 100 + 30) // 60 % 100)
  ELSE printf('%d.%02d h', (total_ns // 1000000000 * 100 + 1800) // 3600 // 100, (total_ns // 1000000000 * 100 + 1800) // 3600 % 100) END AS duration FROM t""",
    "inactivity_filter": f"{W}, {INACTIVE} SELECT * FROM o",
    "toggle_intervals": f"""{W}, s AS (SELECT episode, ts_ns, row_number() OVER (PARTITION BY episode ORDER BY ts_ns, seq) AS n FROM ev WHERE topic = 'signup')
SELECT a.episode, a.ts_ns AS start_ns, b.ts_ns AS end_ns FROM s a JOIN s b ON a.episode = b.episode AND a.n % 2 = 1 AND b.n = a.n + 1 AND a.ts_ns < b.ts_ns""",
    "composed_extractor": f"""{W}, {activity('v', "'view'", 48 * HOUR)}, s AS (SELECT episode, ts_ns, row_number() OVER (PARTITION BY episode ORDER BY ts_ns, seq) AS n FROM ev WHERE topic = 'signup'),
tg AS (SELECT a.episode, a.ts_ns AS start_ns, b.ts_ns AS end_ns FROM s a JOIN s b ON a.episode = b.episode AND a.n % 2 = 1 AND b.n = a.n + 1 AND a.ts_ns < b.ts_ns),
un AS (SELECT * FROM v UNION ALL SELECT * FROM tg), {merged('um', 'un')}, {activity('e', "'error'", 12 * HOUR)}, {minus('d', 'um', 'e')},
p AS (SELECT episode, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns FROM ev WHERE topic = 'purchase' GROUP BY episode HAVING min(ts_ns) < max(ts_ns)), {pairwise('o', 'd', 'p')} SELECT * FROM o""",
    "events_in_intervals": f"{W}, {activity('i', ALL, 12 * HOUR)} SELECT ev.episode, ev.seq, i.start_ns, i.end_ns FROM ev JOIN i ON ev.episode = i.episode AND ts_ns >= start_ns AND ts_ns < end_ns",
    "thin_events": f"{R}, {thinned('ev', 'episode, topic', **THIN)} SELECT episode, topic, seq, ts_ns FROM w WHERE keep",
    "grid_sample": f"{R}, {thinned('ev', 'episode', 'r.ts_ns >= {last}', '{last} + ' + str(DAY), '1704067200000000000')} SELECT episode, seq, ts_ns FROM w WHERE keep",
    "aggregate_deltas": f"""{R}, m AS (SELECT * FROM ev WHERE topic = 'click'), {thinned('m', 'episode', **THIN)},
g AS (SELECT *, coalesce(sum(keep::INTEGER) OVER (PARTITION BY episode ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM w),
s AS (SELECT episode, g, sum(cents)::BIGINT AS cents FROM g GROUP BY episode, g)
SELECT g.episode, g.seq, g.topic, s.cents FROM g JOIN s ON g.episode = s.episode AND g.g = s.g WHERE g.keep UNION ALL SELECT episode, seq, topic, cents FROM ev WHERE topic <> 'click'""",
    "dedupe_press": f"""{W}, k AS (SELECT *, seq % 3 AS key, lag(topic) OVER (PARTITION BY episode, seq % 3 ORDER BY ts_ns, seq) AS was FROM ev)
SELECT episode, key, seq, topic FROM k WHERE NOT (topic = 'view' AND coalesce(was, '') = 'view')""",
    "resampled_stage": f"""{R}, {activity('i', ALL, DAY)}, x AS (SELECT ev.*, i.start_ns FROM ev JOIN i ON ev.episode = i.episode AND ts_ns >= start_ns AND ts_ns < end_ns WHERE topic IN ('view', 'click', 'error')),
v AS (SELECT * FROM x WHERE topic = 'view'), {thinned('v', 'episode, start_ns', f'r.ts_ns - {{last}} >= {6 * HOUR}', 'r.ts_ns', '0::BIGINT')}
SELECT episode, seq, topic, ts_ns FROM w WHERE keep UNION ALL SELECT episode, seq, topic, ts_ns FROM x WHERE topic <> 'view'""",
    "time_bins": f"{W}, {bins('ev', False)}",
    "time_bins_filled": f"{W}, {bins('ev', True)}",
    "sanitize_locf": f"""{W}, m AS (SELECT *, last_value(CASE WHEN topic = 'error' THEN cents > 2000 END IGNORE NULLS) OVER (PARTITION BY episode ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) AS m FROM ev)
SELECT episode, seq, topic FROM m WHERE m""",
    "mode_title": "SELECT source, count(*) AS n FROM documents WHERE trim(source) <> '' GROUP BY source ORDER BY n DESC, min(doc_id) LIMIT 1",
    "title_filter": "SELECT p_partkey, contains(lower(p_name), 'a') AS part_of, p_brand = 'Brand#1' AS exact FROM part",
    "rename_field": f"""{W} SELECT seq, '{{"key":"' || json_extract_string(payload, '$.k') || '"}}' AS payload FROM ev""",
    "evolve_step": f"{W} SELECT seq, CASE topic WHEN 'click' THEN 'mouse/click' WHEN 'view' THEN 'screen/view' ELSE topic END AS topic, regexp_replace(topic, '^p', 'P.') AS prefixed FROM ev",
    "encode_compact": f"{W}, {MOUSE}, {CODES} SELECT seq, kc AS keyboard, mc AS mouse, sc AS screen FROM cd",
    "encode_interleaved": f"{W}, {MOUSE}, {CODES} SELECT seq, ki AS keyboard, mi AS mouse, si AS screen FROM cd",
    "decode_roundtrip_compact": f"""{W}, {MOUSE} SELECT seq, vk::INTEGER AS vk, act AS event_type, tick % 1000 * 10000000 AS ts_ns, cx::INTEGER AS dx, cy::INTEGER AS dy, flags::INTEGER AS flags, (notch * 120)::INTEGER AS data FROM mq""",
    "decode_roundtrip_interleaved": f"""{W}, {MOUSE} SELECT seq, vk::INTEGER AS vk, act AS event_type, tick % 1600 * 10000000 AS ts_ns, greatest(-2000, least(1999, dx))::INTEGER AS dx, greatest(-2000, least(1999, dy))::INTEGER AS dy,
  flags::INTEGER AS flags, (notch * 120)::INTEGER AS data FROM mq""",
    "encode_json": f"{W} SELECT seq, episode, topic, CASE WHEN topic = 'view' THEN '<fake_image_placeholder>' ELSE payload END AS payload FROM ev",
    "tokenize": f"""{W}, {MOUSE}, {CODES}, vo AS (
  SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (
    SELECT unnest(['<EVENT_START>', '<EVENT_END>', '<KEYBOARD>', '<MOUSE>', '<SCREEN>', '<press>', '<release>', '<SIGN_PLUS>', '<SIGN_MINUS>']) AS token
    UNION ALL SELECT '<VK_' || range || '>' FROM range(256) UNION ALL SELECT '<MB_' || printf('%x', range) || '>' FROM range(16) UNION ALL SELECT '<' || range || '>' FROM range(10))),
tx AS (SELECT seq, kc AS text FROM cd UNION ALL SELECT seq, mc FROM cd),
tk AS (SELECT seq, text, unnest(regexp_extract_all(text, '<[^>]*>')) AS token, unnest(range(len(regexp_extract_all(text, '<[^>]*>')))) AS i FROM tx)
SELECT seq, text, string_agg(id::VARCHAR, ',' ORDER BY i) AS ids, count(*)::INTEGER AS n, true AS same FROM tk JOIN vo USING (token) GROUP BY seq, text""",
    "unwrap_time": f"""{W}, t AS (SELECT episode, seq, ts_ns // {HOUR} % 100 AS t FROM ev), f AS (SELECT *, coalesce((t < lag(t) OVER (PARTITION BY episode ORDER BY seq))::INTEGER, 0) AS fell FROM t)
SELECT episode, seq, (t + 100 * sum(fell) OVER (PARTITION BY episode ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS t FROM f""",
    "pack_sequences": """WITH RECURSIVE c AS (
  SELECT conv_id AS episode, length(coalesce(text, ''))::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE length(coalesce(text, '')) <= 1200),
w AS (
  SELECT episode, n, k, n AS used, 0 AS seq_no FROM c WHERE k = 1
  UNION ALL SELECT c.episode, c.n, c.k, CASE WHEN w.used + c.n > 1200 THEN c.n ELSE w.used + c.n END, CASE WHEN w.used + c.n > 1200 THEN w.seq_no + 1 ELSE w.seq_no END FROM w JOIN c ON c.episode = w.episode AND c.k = w.k + 1)
SELECT episode, seq_no::INTEGER AS seq_no, count(*) AS turns, sum(n)::BIGINT AS chars FROM w GROUP BY episode, seq_no""",
    "packed_tokens": f"""{R}, c AS (SELECT episode, seq, (seq % 7 + 1)::BIGINT AS n, row_number() OVER (PARTITION BY episode ORDER BY ts_ns, seq) AS k FROM ev),
w AS (
  SELECT episode, n, k, n AS used, 0 AS seq_no FROM c WHERE k = 1
  UNION ALL SELECT c.episode, c.n, c.k, CASE WHEN w.used + c.n > 16 THEN c.n ELSE w.used + c.n END, CASE WHEN w.used + c.n > 16 THEN w.seq_no + 1 ELSE w.seq_no END FROM w JOIN c ON c.episode = w.episode AND c.k = w.k + 1)
SELECT episode, seq_no::INTEGER AS seq_no, array_to_string(flatten(list(range(1, n + 1) ORDER BY k)) || list_transform(range(16 - sum(n)::BIGINT), lambda x: 0), ',') AS ids, sum(n)::INTEGER AS used, count(*)::INTEGER AS n_events
FROM w GROUP BY episode, seq_no""",
    "skip_and_shift": f"""{W}, f AS (SELECT episode, min(ts_ns) AS t FROM ev WHERE topic <> 'click' GROUP BY episode),
k AS (SELECT ev.*, row_number() OVER (PARTITION BY ev.episode ORDER BY ev.ts_ns, seq) AS i FROM ev LEFT JOIN f ON ev.episode = f.episode WHERE topic <> 'click' OR f.t IS NULL OR ev.ts_ns >= f.t + {6 * HOUR}),
s AS (SELECT episode, seq, i, ts_ns + CASE WHEN topic = 'click' THEN {HOUR} ELSE 0 END AS ts_ns FROM k)
SELECT episode, seq, ts_ns, row_number() OVER (PARTITION BY episode ORDER BY ts_ns, i)::INTEGER AS place FROM s""",
    "collate_labels": "SELECT doc_id, array_to_string(list_transform(range(10), lambda i: CASE WHEN (doc_id + i) % 5 IN (0, 3) THEN -100 ELSE (doc_id + i) % 5 END), ',') AS labels, 1::INTEGER AS max_images FROM documents",
    "embed_mean": "SELECT label, place::INTEGER AS place, round(avg(x), 5) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS place FROM embeddings) GROUP BY label, place",
    "asof_forward": f"""{W}, q AS (SELECT * FROM ev WHERE topic = 'click'), f AS (SELECT episode, ts_ns, min(seq) AS seq FROM ev WHERE topic = 'view' GROUP BY episode, ts_ns)
SELECT q.seq, f.seq AS frame FROM q ASOF LEFT JOIN f ON q.episode = f.episode AND q.ts_ns <= f.ts_ns""",
    "asof_backward": f"""{W}, q AS (SELECT * FROM ev WHERE topic = 'click'), f AS (SELECT episode, ts_ns, max(seq) AS seq FROM ev WHERE topic = 'view' GROUP BY episode, ts_ns)
SELECT q.seq, f.seq AS frame FROM q ASOF LEFT JOIN f ON q.episode = f.episode AND q.ts_ns >= f.ts_ns""",
    "holds": f"""{W}, {KEYS}, h AS (SELECT *, count(*) FILTER (WHERE NOT p) OVER (PARTITION BY episode, key ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hold FROM ke),
g AS (SELECT episode, key, hold, min(ts_ns) FILTER (WHERE p) AS s, max(ts_ns) FILTER (WHERE NOT p) AS e FROM h GROUP BY episode, key, hold)
SELECT episode, key, s AS start_ns, greatest(coalesce(e, s), s + {HOUR}) AS end_ns FROM g WHERE s IS NOT NULL""",
    "click_pairs": f"{W}, {CLICKS}, {clicks(HOUR)} SELECT * FROM ck",
    "srt_cues": f"""{W}, {CLICKS}, {clicks(HOUR)}, n AS (SELECT episode, (start_ns - 1704067200000000000) // 1000000 AS s, (end_ns - 1704067200000000000) // 1000000 AS e, 'key ' || key AS t,
  row_number() OVER (PARTITION BY episode ORDER BY start_ns, end_ns, 'key ' || key) AS cue FROM ck)
SELECT episode, cue::INTEGER AS cue, cue || chr(10) || {srt('s')} || ' --> ' || {srt('e')} || chr(10) || t AS body FROM n""",
    "active_labels": f"""{W}, {CLICKS}, {clicks(6 * HOUR)}, t AS (SELECT episode, start_ns AS t FROM ck UNION SELECT episode, end_ns FROM ck),
c AS (SELECT episode, t, lead(t) OVER (PARTITION BY episode ORDER BY t) AS u FROM t)
SELECT c.episode, c.t AS start_ns, c.u AS end_ns, string_agg(DISTINCT ck.key::VARCHAR, ',' ORDER BY ck.key::VARCHAR) AS labels FROM c JOIN ck ON c.episode = ck.episode AND ck.start_ns <= c.t AND c.u <= ck.end_ns GROUP BY c.episode, c.t, c.u""",
    "state_diff": f"""{W}, d AS (SELECT DISTINCT episode, ts_ns // {DAY} AS day, topic FROM ev), k AS (SELECT episode, day, lag(day) OVER (PARTITION BY episode ORDER BY day) AS was, lead(day) OVER (PARTITION BY episode ORDER BY day) AS nxt FROM (SELECT DISTINCT episode, day FROM d))
SELECT d.episode, d.day, 'press' AS change, d.topic AS member FROM d JOIN k USING (episode, day) WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.episode = d.episode AND x.day = k.was AND x.topic = d.topic)
UNION ALL SELECT d.episode, k.nxt, 'release', d.topic FROM d JOIN k USING (episode, day) WHERE k.nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d x WHERE x.episode = d.episode AND x.day = k.nxt AND x.topic = d.topic)""",
    "cursor_clamped": f"""{R}, r AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY ts_ns, seq) AS n, CASE WHEN topic = 'click' THEN cents ELSE -cents END AS d FROM ev),
w AS (
  SELECT episode, seq, n, greatest(0, least(7999, CASE WHEN topic = 'signup' THEN cents ELSE 4000 + d END))::BIGINT AS x FROM r WHERE n = 1
  UNION ALL SELECT r.episode, r.seq, r.n, greatest(0, least(7999, CASE WHEN r.topic = 'signup' THEN r.cents ELSE w.x + r.d END))::BIGINT FROM w JOIN r ON r.episode = w.episode AND r.n = w.n + 1)
SELECT episode, seq, x FROM w""",
    "heartbeats": f"{W}, s AS (SELECT episode, seq, ts_ns // {6 * HOUR} AS s FROM ev), k AS (SELECT *, lag(s) OVER (PARTITION BY episode ORDER BY s, seq) AS was FROM s) SELECT episode, seq FROM k WHERE was IS NULL OR was <> s",
    "rolling_metric": f"""{W} SELECT seq, round(avg(cents) OVER o, 6) AS rolling_mean, round(coalesce((count(*) OVER o - 1) * 1e9 / nullif(ts_ns - min(ts_ns) OVER o, 0), 0.0) * 1e6, 6) AS rolling_rate
FROM ev WINDOW o AS (PARTITION BY episode ORDER BY ts_ns, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "velocity": f"""{W} SELECT seq, CASE WHEN count(*) OVER o >= 2 THEN sum(cents) OVER o END::BIGINT AS vx, CASE WHEN count(*) OVER o >= 2 THEN sum(seq) OVER o END::BIGINT AS vy
FROM ev WINDOW o AS (PARTITION BY episode ORDER BY ts_ns RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW)""",
    "ema_metric": f"""{R}, r AS (SELECT episode, cents, row_number() OVER (PARTITION BY episode ORDER BY ts_ns, seq) AS n FROM ev),
w AS (SELECT episode, n, cents::DOUBLE AS e FROM r WHERE n = 1 UNION ALL SELECT r.episode, r.n, w.e * 0.9::DOUBLE + r.cents * (1 - 0.9::DOUBLE) FROM w JOIN r ON r.episode = w.episode AND r.n = w.n + 1)
SELECT episode, round(arg_max(e, n), 4) AS ema FROM w GROUP BY episode""",
    "reset_flags": f"""{W}, p AS (SELECT episode, seq, ts_ns, cents % 50 AS x, seq % 40 AS y FROM ev),
d AS (SELECT *, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy, (ts_ns - lag(ts_ns) OVER o) / 1e9 AS dt, row_number() OVER o AS n, count(*) OVER (PARTITION BY episode) AS total FROM p WINDOW o AS (PARTITION BY episode ORDER BY ts_ns, seq)),
e AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist FROM d),
m AS (SELECT a.episode, a.n, min(b.n) AS other FROM e a JOIN e b ON a.episode = b.episode AND b.n BETWEEN a.n + 1 AND a.n + 3 AND abs(a.dx + b.dx) <= 10 AND abs(a.dy + b.dy) <= 10 AND a.dist > 3 AND b.dist > 3 WHERE a.n + 3 <= a.total GROUP BY a.episode, a.n),
h AS (SELECT episode, n FROM m UNION SELECT episode, other FROM m)
SELECT e.seq, coalesce(e.dt <= 60.0 OR CASE WHEN e.dt > 0 THEN e.dist / e.dt > 0.02 ELSE e.dt IS NOT NULL END, false) OR h.n IS NOT NULL AS is_reset FROM e LEFT JOIN h ON e.episode = h.episode AND e.n = h.n""",
    "screen_centre": f"""{W}, c AS (SELECT (round_even((cents % 100) / 10.0, 0) * 10)::BIGINT AS cx, (round_even((seq % 60) / 10.0, 0) * 10)::BIGINT AS cy, ts_ns, seq FROM ev)
SELECT cx, cy FROM c GROUP BY cx, cy ORDER BY count(*) DESC, min((ts_ns, seq)) LIMIT 1""",
    "gop_segments": f"""{W}, g AS (SELECT *, count(*) FILTER (WHERE topic = 'view') OVER (PARTITION BY episode ORDER BY ts_ns, seq ROWS UNBOUNDED PRECEDING) - 1 AS gop FROM ev), m AS (SELECT episode, max(gop) AS top FROM g GROUP BY episode)
SELECT g.episode, gop, count(*) AS n, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, string_agg(upper(topic[1]), '' ORDER BY ts_ns, seq) AS kinds FROM g JOIN m USING (episode) WHERE gop >= 0 AND gop < top GROUP BY g.episode, gop""",
    "key_gaps": f"""{W}, g AS (SELECT episode, ts_ns - lag(ts_ns) OVER (PARTITION BY episode ORDER BY ts_ns, seq) AS gap FROM ev WHERE topic = 'view')
SELECT episode, count(*) AS n, min(gap) AS min_gap, max(gap) AS max_gap, round(avg(gap) / 1e6, 3) AS mean_gap, round(quantile_cont(gap, 0.5) / 1e6, 3) AS median_gap, max(gap) - min(gap) < 3e9 AS consistent FROM g WHERE gap IS NOT NULL GROUP BY episode""",
    "interval_stats": f"{W} SELECT topic, round(avg(cents), 4) AS mean, quantile_cont(cents, 0.5) AS median, quantile_cont(cents, 0.25) AS q1, quantile_cont(cents, 0.75) AS q3, max(cents) AS max, min(cents) AS min FROM ev GROUP BY topic",
    "latency_summary": f"{W} SELECT round(avg(cents), 4) AS mean, round(stddev_pop(cents), 4) AS std, round(quantile_cont(cents, 0.95), 4) AS p95, round(quantile_cont(cents, 0.99), 4) AS p99, round(count(*) / 30.0, 4) AS throughput FROM ev",
    "frame_shares": f"{W} SELECT topic, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM ev), 6) AS percent FROM ev GROUP BY topic",
    "quality_verdict": f"{W} SELECT topic, CASE WHEN avg((cents > 1000)::INTEGER) >= 0.6 THEN 'PASS' WHEN avg((cents > 1000)::INTEGER) >= 0.5 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM ev GROUP BY topic",
    "vfr_flag": """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 4 = 0 OR floor(l_quantity) = 0 THEN true ELSE abs(floor(l_quantity) / (l_partkey % 4) - floor(l_quantity) / 2) > 0.01 END AS vfr FROM lineitem""",
    "verify_counts": f"""{W} SELECT episode, max(ts_ns) - min(ts_ns) AS duration_ns, count(*) FILTER (WHERE topic IN ('view', 'click')) AS messages,
  max(ts_ns) - min(ts_ns) > {20 * DAY} AND count(*) FILTER (WHERE topic IN ('view', 'click')) > 30 AS valid FROM ev GROUP BY episode""",
    "compare_logs": f"""{W} SELECT episode, CASE WHEN episode % 5 = 0 AND count(*) FILTER (WHERE topic = 'error') > 0 THEN 'message count' WHEN episode % 7 = 0 AND count(*) FILTER (WHERE topic = 'view') > 0 THEN 'topics' ELSE 'ok' END AS reason
FROM ev GROUP BY episode""",
    "button_events": f"""{W}, f AS (SELECT seq, seq % 64 AS f FROM ev)
SELECT seq, CASE WHEN f & 1 <> 0 THEN 'left' WHEN f & 4 <> 0 THEN 'right' ELSE 'middle' END AS button, true AS pressed FROM f WHERE f & 21 <> 0
UNION ALL SELECT seq, CASE WHEN f & 2 <> 0 THEN 'left' WHEN f & 8 <> 0 THEN 'right' ELSE 'middle' END, false FROM f WHERE f & 42 <> 0""",
    "key_labels": f"{W} SELECT seq, coalesce(n_name, '?' || seq % 30) AS label FROM ev LEFT JOIN nation ON n_nationkey = seq % 30",
    "catalog_search": "SELECT DISTINCT p_partkey, p_type AS name FROM part WHERE regexp_matches(p_type, '(?i)s.*m')",
    "media_paths": """SELECT p_partkey, '/data/' || CASE WHEN p_partkey % 2 = 0 THEN replace(lower(p_brand), '#', '_') || '/' ELSE replace(lower(p_brand), '#', '_') || '/' END || 'video.mkv' AS path, '/root/a/b.mcap' AS episode FROM part""",
    "text_formats": f"""WITH s AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT * (o_orderkey % 1000) AS b FROM orders)
SELECT o_orderkey, CASE WHEN b >= 1024 * 1024 * 1024 THEN printf('%.2f GiB', b / 1073741824.0) WHEN b >= 1024 * 1024 THEN printf('%.2f MiB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.2f KiB', b / 1024.0) ELSE b || ' B' END AS size, {srt('b')} AS at FROM s""",
    "action_vectors": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT vec_id, CASE WHEN e[1] > 0.05 THEN 'w' ELSE '' END || CASE WHEN e[2] > 0.05 THEN 'a' ELSE '' END || CASE WHEN e[3] > 0.05 THEN 's' ELSE '' END || CASE WHEN e[4] > 0.05 THEN 'd' ELSE '' END AS keys,
  e[5] > 0.05 AS left, e[6] > 0.05 AS right, CASE WHEN list_max(e[7:11]) > 0.05 THEN ([-10.0, -1.0, 0.0, 1.0, 10.0])[list_position(e[7:11], list_max(e[7:11]))]::DOUBLE ELSE 0.0::DOUBLE END AS dx,
  CASE WHEN list_max(e[12:14]) > 0.05 THEN ([-5.0, 0.0, 5.0])[list_position(e[12:14], list_max(e[12:14]))]::DOUBLE ELSE 0.0::DOUBLE END AS dy FROM v""",
}
