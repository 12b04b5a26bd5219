"""DuckDB SQL for the queries of the catalogue, written from the definitions, not from the plans."""

from __future__ import annotations

import json

from .functions.stats import norm_cdf_sql, norm_ppf_sql, sidak_z_sql

HOUR, DAY = 3_600_000, 86_400_000
MID = 1_704_067_200_000 + 15 * DAY
END = MID + 15 * DAY
TICK, WINDOW = 6 * HOUR, DAY
ALERT_WINDOW = 9 * HOUR
RESETS = (MID - 5 * DAY, MID + 4 * DAY)
WRITES = (("observe:*", 1000), ("observe:a", 2000), ("observe:a#fine", 250), ("observe:b#fine", 500), ("observe:a", 3000))
#: Writes of the delta: scope, row and the time from which it is in force.
DELTAS = (("schema:*", {"baseline_delta": 0.05}, None), ("schema:test_result:v1", {"baseline_delta": 0.02}, MID), ("schema:test_result:v1", {"note": "default"}, MID + 5 * DAY), ("schema:test_result:v1", {"baseline_delta": 0.2}, MID + 9 * DAY))
SPAN = (MID + 5_400_000, END - 6_000_000)
#: Versions of an area dictionary: version, since, tag, first and last bit.
TAGS = (
    ("v1", 0, "auth.login", 0, 15), ("v1", 0, "auth.session", 16, 31), ("v1", 0, "payment", 32, 63), ("v1", 0, "ui", 64, 127),
    ("v2", MID, "auth.login", 0, 23), ("v2", MID, "payment.charge.card", 32, 47), ("v2", MID, "payment.refund", 44, 63), ("v2", MID, "ui.forms", 64, 127), ("v2", MID, "db.users", 128, 200),
    ("v3", MID + 7 * DAY, "core", 0, 255),
)
LOOKUPS = (("a", "fine"), ("a", "coarse"), ("a", None), ("b", "fine"), ("b", None), ("c", "fine"))

E = "SELECT (epoch_us(ts) // 1000) AS ts_ms, value, event_type, (user_id % 4)::VARCHAR AS bucket, 1.0::DOUBLE AS weight, event_id AS seq FROM events"
P = E.replace("value,", "CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END::DOUBLE AS value,", 1)
TIGHT = E.replace("value,", "CASE WHEN event_id % 50 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS value,", 1)
T = """SELECT (epoch_us(ts) // 1000) AS ts_ms, 'agent-' || substr('ABCD', (user_id % 4 + 1)::INT, 1) AS agent_id, event_id AS seq,
  list_distinct([(user_id * 37) % 256, (event_id * 11) % 256, (user_id + event_id) % 256]) AS areas, 'commit-' || (event_id // 100) AS commit_hash,
  CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'flaky' ELSE 'pass' END AS result FROM events"""
DICTIONARY = "(VALUES (0, 'auth', 0, 31, 32), (1, 'payment', 32, 63, 32), (2, 'ui', 64, 127, 48), (3, 'utils', 128, 255, 32)) AS dict(position, domain, lo, hi, required)"


def grid(ts: str, w: int, origin: str = "0") -> str:
    return f"({origin} + floor(({ts} - {origin})::DOUBLE / {w})::BIGINT * {w})"


def windows(source: str, w: int, label: str | None = None, origin: str = "0", where: str = "TRUE") -> str:
    """Windows of a source, mixed and per label."""
    sets = "GROUPING SETS ((window_start), (window_start, label))" if label else "window_start"
    shown = "CASE WHEN grouping(label) = 0 THEN label END" if label else "NULL::VARCHAR"
    return f"""SELECT {shown} AS group_label, window_start, window_start + {w} AS window_end, count(*) AS count,
      sum(weight * value) / sum(weight) AS mean, sum(weight * value * value) AS sum_sq, sum(weight) AS sum_w, sum(weight * weight) AS sum_w2,
      min(value) AS min_v, max(value) AS max_v, count(*) >= 3 AS valid
    FROM (SELECT *, {grid('ts_ms', w, origin)} AS window_start, {label or 'NULL'} AS label FROM ({source}) s WHERE {where}) GROUP BY {sets}"""


def shown(windows_sql: str, digits: int = 7) -> str:
    return f"""SELECT group_label, window_start, window_end, count, round(mean, {digits}) AS mean, round(sum_sq, 4) AS sum_sq, round(sum_w, 4) AS sum_w,
      round(min_v, 4) AS min_v, round(max_v, 4) AS max_v, valid FROM ({windows_sql})"""


def decayed(source: str, tau: int) -> str:
    return f"SELECT * REPLACE (exp(-((SELECT max((epoch_us(ts) // 1000)) FROM events) - ts_ms) / {float(tau)}) AS weight) FROM ({source})"


THINNED = f"""WITH e AS ({E}), fresh AS (SELECT * FROM e WHERE ts_ms >= (SELECT max(ts_ms) FROM e) - {5 * DAY}),
  aged AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM e WHERE ts_ms < (SELECT max(ts_ms) FROM e) - {5 * DAY}),
  kept AS (SELECT * FROM aged WHERE i % 3 = 0)
  SELECT * FROM fresh UNION ALL SELECT * EXCLUDE (i) REPLACE (3.0 AS weight) FROM kept WHERE ts_ms >= (SELECT max(ts_ms) FROM kept) - {15 * DAY}"""


def sides(source: str, label: str | None, w: int = DAY) -> str:
    """CTEs obs, ref and pool (one row per unit of the reference)."""
    return f"""obs AS ({windows(source, w, label, where=f'ts_ms BETWEEN {MID} AND {END}')}),
    ref AS ({windows(source, w, label, where=f'ts_ms BETWEEN {2 * MID - END} AND {MID}')}),
    pool0 AS (SELECT coalesce(group_label, '') AS unit, sum(sum_w) AS ref_w, sum(sum_w2) AS ref_w2, sum(mean * sum_w) / sum(sum_w) AS ref_mean,
      sum(sum_sq) AS ref_sq, sum(count)::BIGINT AS ref_count, count(*) AS ref_windows FROM ref GROUP BY 1),
    pool AS (SELECT *, ref_w * ref_w / ref_w2 AS ref_n, CASE WHEN ref_w * ref_w / ref_w2 >= 2 AND ref_w > ref_w2 / ref_w
      THEN greatest((ref_sq - ref_w * ref_mean * ref_mean) / (ref_w - ref_w2 / ref_w), 0) END AS ref_var FROM pool0)"""


def scores(source: str, label: str | None, z: float) -> str:
    """CTEs up to scored: every scorable window of the units with its gate."""
    pick = "group_label IS NOT NULL" if label else "group_label IS NULL"
    good = "WHERE ref_n >= 3 AND ref_var > 0" if label else ""
    return f"""{sides(source, label)},
    lat0 AS (SELECT coalesce(group_label, '') AS unit, sum(sum_w) AS w, sum(sum_sq) / sum(sum_w) AS sq, sum(mean * sum_w) / sum(sum_w) AS m, min(min_v) AS lo, max(max_v) AS hi
      FROM (SELECT * FROM obs UNION ALL SELECT * FROM ref) GROUP BY 1),
    lat AS (SELECT unit, CASE WHEN abs(sq - (lo * lo + (hi * hi - lo * lo) * ((m - lo) / nullif(hi - lo, 0)))) <=
      1e-9 * greatest(1, abs(lo * lo + (hi * hi - lo * lo) * ((m - lo) / nullif(hi - lo, 0)))) THEN hi - lo END AS step FROM lat0),
    s0 AS (SELECT o.*, pool.* EXCLUDE (unit), coalesce(group_label, '') AS unit, o.sum_w * o.sum_w / o.sum_w2 AS n_eff
      FROM (SELECT * FROM obs WHERE {pick} AND count >= 3) o LEFT JOIN pool ON coalesce(group_label, '') = pool.unit {good}),
    s1 AS (SELECT s0.*, step, sqrt(ref_var * (1 / n_eff + 1 / ref_n)) AS se, count(*) OVER () AS family_n FROM s0 LEFT JOIN lat USING (unit)),
    s2 AS (SELECT *, (mean - ref_mean) / nullif(se, 0) AS raw_z,
      sign(mean - ref_mean) * greatest(abs(mean - ref_mean) - coalesce(0.5 * step / n_eff, 0), 0) / nullif(se, 0) AS gate_z, {sidak_z_sql(str(float(z)), 'family_n')} AS threshold FROM s1),
    scored AS (SELECT *, CASE WHEN gate_z >= threshold THEN 'spike' WHEN gate_z <= -threshold THEN 'dip' END AS tag FROM s2)"""


SCORED = "SELECT unit, window_start, round(n_eff, 4) AS n_eff, round(step, 4) AS step, round(raw_z, 4) AS raw_z, round(gate_z, 4) AS gate_z, family_n, round(threshold, 4) AS threshold, tag FROM scored"
STEPS = """d AS (SELECT o.*, ref_mean, ref_var, ref_n, CASE WHEN (mean - ref_mean) / coalesce(nullif(ref_mean, 0), 1) >= 0.02 THEN 1
      WHEN (mean - ref_mean) / coalesce(nullif(ref_mean, 0), 1) <= -0.02 THEN -1 ELSE 0 END AS dir FROM obs o, pool WHERE group_label IS NULL AND unit = ''),
    isl AS (SELECT *, row_number() OVER (ORDER BY window_start) - row_number() OVER (PARTITION BY dir ORDER BY window_start) AS g FROM d),
    runs AS (SELECT dir, min(window_start) AS region_start, max(window_start) AS region_end, count(*) AS n, sum(sum_w) AS w, sum(sum_w2) AS w2, sum(mean * sum_w) AS wv,
      any_value(ref_mean) AS rm, any_value(ref_var) AS rv, any_value(ref_n) AS rn FROM isl WHERE dir <> 0 GROUP BY dir, g HAVING count(*) >= 2),
    steps AS (SELECT CASE WHEN dir > 0 THEN 'step_up' ELSE 'step_down' END AS shape_tag, NULL::VARCHAR AS group_label, region_start, region_end,
      abs(wv / w - rm) / sqrt(rv * (1 / (w * w / w2) + 1 / rn)) AS magnitude FROM runs)"""
TILE = "shape_tag, group_label, region_start, region_end, round(magnitude, 4) AS magnitude"
SPIKES = "SELECT tag AS shape_tag, group_label, window_start AS region_start, window_end AS region_end, abs(raw_z) AS magnitude FROM scored WHERE tag IS NOT NULL"
AGENTS = f"""SELECT tick AS tick_ts, agent_id, avg((result = 'pass')::INT) AS pass_rate, avg((result = 'flaky')::INT) AS flaky_rate, count(*) AS event_count
    FROM ({T}) t JOIN (SELECT unnest(range({MID - 16 * DAY}, {END + 3 * DAY}, {TICK})) AS tick) ON ts_ms BETWEEN tick - {WINDOW} AND tick GROUP BY ALL"""


def spine(window: int) -> str:
    """Every tick from the first to the last that sees an event."""
    return f"""SELECT unnest(generate_series((ceil(min(ts_ms) / {float(TICK)}) * {TICK})::BIGINT, (max(ts_ms) + {window}) // {TICK} * {TICK}, {TICK})) AS tick_ts FROM ({T})"""


def bits_at(window: int) -> str:
    """Bits of every tick; a tick that sees none has one row without a bit."""
    return f"""SELECT tick_ts, bit FROM ({spine(window)}) LEFT JOIN (SELECT ts_ms, unnest(areas) AS bit FROM ({T})) ON ts_ms BETWEEN tick_ts - {window} AND tick_ts"""


def domains_at(window: int) -> str:
    return f"""SELECT tick_ts, dict.domain, count(DISTINCT CASE WHEN bit BETWEEN lo AND hi THEN bit END) AS covered_bits, required::BIGINT AS required_bits,
      greatest(required - count(DISTINCT CASE WHEN bit BETWEEN lo AND hi THEN bit END), 0)::BIGINT AS gap
    FROM ({bits_at(window)}), {DICTIONARY} GROUP BY tick_ts, dict.domain, required"""


def fold(delta: float | str = 0.10, resets: tuple[int, ...] = ()) -> str:
    """Recursive CTE f: the rule state after every tick of an agent. ``delta`` may be an expression of {ts}, the tick's time."""
    delta_at = lambda ts: str(delta).replace("{ts}", ts)
    fresh = " OR ".join(f"(coalesce(f.tick_ts, 0) <= {r} AND a.tick_ts > {r})" for r in resets) or "FALSE"
    old = lambda name, reset: f"CASE WHEN {fresh} THEN {reset} ELSE f.{name} END AS {name}"
    kept = ", ".join(old(n, r) for n, r in (("low", "0"), ("rer", "FALSE"), ("dips", "0"), ("act", "FALSE"), ("since", "NULL"), ("replayed", "FALSE")))
    below = "coalesce(pass_rate < th, FALSE)"
    dip = f"({below} AND pass_rate >= 0.40)"
    return f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY tick_ts) AS i FROM ({AGENTS})),
    f AS (
      SELECT agent_id, 0::BIGINT AS i, NULL::BIGINT AS tick_ts, NULL::DOUBLE AS b, 0 AS n, NULL::DOUBLE AS th, 0 AS low, FALSE AS rer, FALSE AS ar,
             0 AS dips, FALSE AS act, NULL::BIGINT AS since, FALSE AS replayed, FALSE AS rc, NULL::BIGINT AS dip_start
      FROM (SELECT DISTINCT agent_id FROM a)
      UNION ALL
      SELECT agent_id, i, tick_ts, b, n, th,
        CASE WHEN th IS NULL THEN low WHEN {below} THEN low + 1 ELSE 0 END,
        CASE WHEN th IS NULL THEN rer ELSE {below} AND (rer OR low + 1 >= 2) END,
        th IS NOT NULL AND {below} AND low + 1 >= 2 AND NOT rer,
        CASE WHEN th IS NULL THEN dips WHEN {dip} THEN dips + 1 ELSE 0 END,
        CASE WHEN th IS NULL THEN act WHEN {dip} THEN (CASE WHEN dips + 1 BETWEEN 2 AND 7 THEN TRUE WHEN dips + 1 > 7 THEN FALSE ELSE act END) ELSE FALSE END,
        CASE WHEN th IS NULL THEN since WHEN {dip} THEN (CASE WHEN dips = 0 THEN tick_ts ELSE since END) END,
        replayed OR (th IS NOT NULL AND NOT {below} AND act),
        th IS NOT NULL AND NOT {below} AND act AND NOT replayed,
        CASE WHEN th IS NOT NULL AND NOT {below} AND act AND NOT replayed THEN coalesce(since, tick_ts) END
      FROM (SELECT *, CASE WHEN n >= 10 THEN greatest(b - {delta_at('tick_ts')}, 0) END AS th FROM (
        SELECT a.agent_id, a.i, a.tick_ts, a.pass_rate, {kept},
          f.n + (a.event_count >= 3)::INT AS n,
          CASE WHEN a.event_count < 3 THEN f.b WHEN f.b IS NULL THEN a.pass_rate WHEN f.n < 10 OR a.pass_rate >= f.b - {delta_at('a.tick_ts')} THEN 0.05 * a.pass_rate + 0.95 * f.b ELSE f.b END AS b
        FROM f JOIN a ON a.agent_id = f.agent_id AND a.i = f.i + 1))
    )"""


def trial_sql(burst: str, shown: str = "") -> str:
    rate = f"SELECT count(*) AS trials, sum(blind::INT)::BIGINT AS blind, round(avg(CASE WHEN NOT blind THEN (z >= {sidak_z_sql('2.0', 'windows')})::INT END), 6) AS rate FROM t"
    return f"""WITH r AS (SELECT id // 2000 AS trial_id, id % 2000 AS i, (id // 1000) % 2 = 1 AS is_obs FROM (SELECT unnest(range(1000000)) AS id)),
    h AS (SELECT *, md5(trial_id || ':' || i) AS d FROM r),
    e AS (SELECT trial_id, is_obs, floor(('0x' || substr(d, 1, 8))::BIGINT / 4294967296.0 * 10000)::BIGINT + CASE WHEN is_obs THEN 10000 ELSE 0 END AS ts_ms, ('0x' || substr(d, 9, 8))::BIGINT / 4294967296.0 AS u FROM h),
    v AS (SELECT trial_id, is_obs, ts_ms // 1000 AS w, CASE WHEN u < {burst} THEN 1.0 ELSE 0.0 END AS v FROM e),
    win AS (SELECT trial_id, is_obs, w, count(*) AS n, sum(v) AS v FROM v GROUP BY ALL),
    pool AS (SELECT trial_id, sum(n) AS rn, sum(v) / sum(n) AS rm, greatest((sum(v) - sum(n) * (sum(v) / sum(n)) ** 2) / (sum(n) - 1), 0) AS rv FROM win WHERE NOT is_obs GROUP BY 1),
    z AS (SELECT trial_id, greatest(abs(v / n - rm) - 0.5 / n, 0) / nullif(sqrt(rv * (1.0 / n + 1.0 / rn)), 0) AS z, rv FROM win JOIN pool USING (trial_id) WHERE is_obs AND n >= 3),
    t AS (SELECT trial_id, count(*) AS windows, max(z) AS z, NOT bool_or(rv > 0) AS blind FROM z GROUP BY 1)
    {shown or rate}"""


DELTA_AT = f"(CASE WHEN {{ts}} < {MID} THEN 0.05 WHEN {{ts}} < {MID + 5 * DAY} THEN 0.02 WHEN {{ts}} < {MID + 9 * DAY} THEN 0.10 ELSE 0.2 END)"
SLOT = "(ceil(ts_ms / {0}.0) * {0})::BIGINT"


def rolling(key: str, result: str, slot: int, window: int) -> str:
    """Rate of a result over the slots of the last window, at every slot of a key."""
    frame = f"(PARTITION BY key ORDER BY tick_ts RANGE BETWEEN {window - slot} PRECEDING AND CURRENT ROW)"
    return f"""SELECT tick_ts, key, sum(n) OVER w AS n, sum(hits) OVER w AS hits, sum(hits) OVER w / sum(n) OVER w AS rate
      FROM (SELECT {SLOT.format(slot)} AS tick_ts, {key} AS key, count(*) AS n, sum((result = '{result}')::INT) AS hits FROM (SELECT *, agent_id || '::test_' || lpad((seq % 50)::VARCHAR, 3, '0') AS test_id FROM ({T})) GROUP BY 1, 2)
      WINDOW w AS {frame}"""


def risen(rates: str, above: float, kind: str) -> str:
    return f"""SELECT tick_ts, '{kind}' AS type, key AS subject, round(rate, 4) AS rate FROM (SELECT *, rate > {above} AS bad, lag(rate > {above}, 1, FALSE) OVER (PARTITION BY key ORDER BY tick_ts) AS was FROM ({rates})) WHERE bad AND NOT was"""


def vectors() -> dict[str, str]:
    """Coverage as vectors, rolling rules and the versioned dictionary."""
    passing = f"SELECT *, unnest(areas) AS bit FROM ({T}) WHERE result = 'pass'"
    target = "bit BETWEEN 0 AND 31 OR bit BETWEEN 32 AND 63 OR bit BETWEEN 64 AND 111 OR bit BETWEEN 128 AND 159"
    day = f"(SELECT DISTINCT {SLOT.format(HOUR)} AS tick_ts FROM ({T}))"
    recent = lambda a, b: f"count(DISTINCT bit) FILTER (slot > tick_ts - {a} AND slot <= tick_ts - {b} AND bit BETWEEN lo AND hi)"
    dictionary = ", ".join(f"('{v}', {since}, '{tag}', {lo}, {hi})" for v, since, tag, lo, hi in TAGS)
    return {
        "coverage_cumulative": f"""WITH first AS (SELECT bit, min({SLOT.format(TICK)}) AS seen FROM ({passing}) GROUP BY 1),
          grid AS (SELECT tick_ts, bit, coalesce(seen <= tick_ts, FALSE) AS have, {target} AS want FROM (SELECT DISTINCT {SLOT.format(TICK)} AS tick_ts FROM ({T})), (SELECT unnest(range(256)) AS bit) b LEFT JOIN first USING (bit))
          SELECT tick_ts, count(*) FILTER (have) AS covered, count(*) FILTER (want AND NOT have) AS missing, count(*) FILTER (have AND NOT want) AS beyond,
            coalesce(string_agg(bit::VARCHAR, ',' ORDER BY bit) FILTER (want <> have), '') AS gap_vec FROM grid GROUP BY 1""",
        "coverage_weights": f"""SELECT (ts_ms // {DAY}) * {DAY} AS window_start, bit, bool_or(result = 'pass') AS covered, max((seq * 13) % 101 / 100.0)::DOUBLE AS weight, count(*) AS tests
          FROM (SELECT *, unnest(areas) AS bit FROM ({T})) GROUP BY 1, 2""",
        "coverage_contributions": f"""WITH p AS ({passing}), f AS (SELECT bit, min_by(commit_hash, (ts_ms, seq)) AS commit_hash FROM p GROUP BY 1)
          SELECT commit_hash, count(DISTINCT bit) AS new_bits, max((seq * 13) % 101 / 100.0)::DOUBLE AS new_weight FROM f JOIN p USING (bit, commit_hash) GROUP BY 1""",
        "coverage_delta_24h": f"""SELECT tick_ts, domain, {recent(DAY, 0)} AS covered, ({recent(DAY, 0)} - {recent(2 * DAY, DAY)})::BIGINT AS delta
          FROM {day} t JOIN (SELECT {SLOT.format(HOUR)} AS slot, bit FROM ({passing}) UNION ALL SELECT {SLOT.format(HOUR)}, NULL FROM ({T})) e ON slot <= tick_ts AND slot > tick_ts - {2 * DAY}, {DICTIONARY} GROUP BY tick_ts, domain""",
        "flaky_quarantine": risen(rolling("test_id", "flaky", 60_000, HOUR), 0.30, "quarantineApprove"),
        "agent_regressions_7d": risen(rolling("agent_id", "fail", HOUR, 7 * DAY), 0.15, "rerouteSchema"),
        "tag_rollup": f"""WITH d(version, since, tag, lo, hi) AS (VALUES {dictionary}), v AS (SELECT DISTINCT version, since FROM d),
          e AS (SELECT t.*, (SELECT max_by(version, since) FROM v WHERE since <= ts_ms) AS version FROM ({T}) t),
          hit AS (SELECT DISTINCT seq, result, e.version, unnest(list_transform(range(1, len(string_split(tag, '.')) + 1), lambda n: array_to_string(string_split(tag, '.')[1:n], '.'))) AS tag
            FROM (SELECT *, unnest(areas) AS bit FROM e) e JOIN d ON d.version = e.version AND bit BETWEEN lo AND hi)
          SELECT version, tag, count(*) AS events, sum((result = 'pass')::INT)::BIGINT AS passes FROM hit GROUP BY 1, 2""",
    }


def streams() -> dict[str, str]:
    """What streams over the table end with; their last ticks wait for the watermark."""
    until = f"(SELECT max(ts_ms) FROM ({T})) - {HOUR}"
    ticks = f"SELECT DISTINCT agent_id, unnest(generate_series((ceil(ts_ms / {float(HOUR)}) * {HOUR})::BIGINT, (ts_ms + {HOUR}) // {HOUR} * {HOUR}, {HOUR})) AS tick_ts FROM ({T})"
    silent = lambda end: f"""SELECT tick_ts + {HOUR} AS tick_ts, 'blind' AS type, agent_id AS subject FROM (SELECT *, lead(tick_ts, 1, {end} + 1) OVER (PARTITION BY agent_id ORDER BY tick_ts) AS nx FROM ({{0}}))
      WHERE tick_ts + {HOUR} < nx AND tick_ts + {HOUR} <= {end}"""  # noqa: E731
    return {
        "agent_blindness": silent("(SELECT max(tick_ts) FROM t)").format("SELECT * FROM t").join((f"WITH t AS ({ticks}) ", "")),
        "stream_decisions": f"""{fold(DELTA_AT)} SELECT * FROM (SELECT tick_ts, 'rerouteSchema' AS type, agent_id AS subject FROM f WHERE ar UNION ALL SELECT tick_ts, 'replayRequest', agent_id FROM f WHERE rc) WHERE tick_ts < {until}""",
        "stream_corrected_windows": shown(windows(E, DAY, "event_type"), 10) + " WHERE group_label IS NOT NULL",
        "replay_from_summary": shown(windows(E, DAY, "event_type", where=f"ts_ms BETWEEN {SPAN[0]} AND {SPAN[1]}"), 10),
        "brain_delta_as_of": f"{fold(DELTA_AT)} SELECT tick_ts, 'rerouteSchema' AS type, agent_id AS subject FROM f WHERE ar",
    }


def queries() -> dict[str, str]:
    by_type, by_two = "event_type", "event_type || '|' || bucket"
    spans = (END - DAY - 1) // DAY * DAY
    live = f"""obs AS ({windows(E, DAY, where=f'ts_ms BETWEEN {spans - 5 * DAY} AND {spans - 1}')}), ref AS ({windows(E, DAY, where=f'ts_ms BETWEEN {spans - 10 * DAY} AND {spans - 5 * DAY - 1}')})"""
    live_scores = scores(E, None, 0.8)
    live_scores = live + live_scores[live_scores.index(",\n    pool0") :]
    fine = windows(decayed(E, 432_000_000), 6 * HOUR, by_type)
    coarse = f"""SELECT group_label, {grid('window_start', DAY)} AS window_start, {grid('window_start', DAY)} + {DAY} AS window_end, sum(count)::BIGINT AS count,
      sum(mean * sum_w) / sum(sum_w) AS mean, sum(sum_sq) AS sum_sq, sum(sum_w) AS sum_w, sum(sum_w2) AS sum_w2, min(min_v) AS min_v, max(max_v) AS max_v, sum(count) >= 3 AS valid FROM ({fine}) GROUP BY 1, 2, 3"""
    agent_label = f"""agent_id || '|' || (SELECT max_by(domain, n * 10 - position) FROM (SELECT domain, position, len(list_filter(areas, lambda b: b BETWEEN lo AND hi)) AS n FROM {DICTIONARY}))"""
    observed = f"SELECT ts_ms, CASE result WHEN 'pass' THEN 1.0 WHEN 'flaky' THEN 0.5 ELSE 0.0 END::DOUBLE AS value, 1.0::DOUBLE AS weight, {agent_label} AS who FROM ({T}) t"
    even, odd = (windows(f"SELECT * FROM ({E.replace('event_id AS seq', 'event_id AS seq, user_id')}) WHERE user_id % 2 = {k}", DAY) for k in (0, 1))
    base_pick = """pick AS (SELECT window_start AS region_start, window_end AS region_end FROM obs, pool WHERE group_label IS NULL AND unit = ''
      ORDER BY NOT valid, abs(mean - ref_mean), window_start LIMIT 1)"""
    tails = """best AS (SELECT unit, max(max_v) AS hi, min(min_v) AS lo, max_by(struct_pack(n_eff, se, step, ref_mean, threshold), struct_pack(a := n_eff, b := -window_start)) AS b FROM scored WHERE ref_var > 0 AND se > 0 GROUP BY unit),
      t AS (SELECT unit, 'spike' AS direction, sign(hi - b.ref_mean) * greatest(abs(hi - b.ref_mean) - coalesce(0.5 * b.step / b.n_eff, 0), 0) / b.se AS z, b.threshold AS th FROM best
      UNION ALL SELECT unit, 'dip', -sign(lo - b.ref_mean) * greatest(abs(lo - b.ref_mean) - coalesce(0.5 * b.step / b.n_eff, 0), 0) / b.se, b.threshold FROM best)"""
    looks = ", ".join(f"('{s}', {'NULL' if v is None else repr(v)})" for s, v in LOOKUPS)
    writes = ", ".join(f"({i}, '{s}', {w})" for i, (s, w) in enumerate(WRITES))
    row = lambda scope: f"(SELECT max_by(w, i) FROM writes WHERE s = {scope})"
    found = vectors() | streams() | {
        "lens_tumbling": shown(windows(E, DAY)),
        "lens_epoch_origin": shown(windows(E, 6 * HOUR, origin=str(3 * HOUR))),
        "lens_first_event": shown(windows(E, DAY, origin="(SELECT min((epoch_us(ts) // 1000)) FROM events)")),
        "lens_group_by": shown(windows(E, DAY, by_type)),
        "lens_group_by_multi": shown(windows(E, DAY, by_two)),
        "lens_unkeyed": shown(windows(E, DAY, "event_type || '|(none)'")),
        "lens_downsample": shown(windows(E, DAY)),
        "lens_decay_step": shown(windows(E, DAY, where=f"ts_ms >= (SELECT max((epoch_us(ts) // 1000)) FROM events) - {10 * DAY}")),
        "lens_decay_exp": shown(windows(decayed(E, 432_000_000), DAY)),
        "lens_decay_exp_grouped": shown(coarse),
        "lens_weighted_kish": f"SELECT window_start, round(sum_w, 4) AS sum_w, round(sum_w2, 4) AS sum_w2, round(sum_w * sum_w / sum_w2, 4) AS n_eff FROM ({windows(decayed(E, 432_000_000), DAY)})",
        "retention_segment": f"SELECT seq, ts_ms, round(value, 2) AS value FROM ({E}) WHERE ts_ms BETWEEN {MID} AND {END}",
        "retention_thinned": f"SELECT seq, ts_ms, weight::DOUBLE AS weight FROM ({THINNED})",
        "replay_thinned": shown(windows(THINNED, DAY)),
        "retention_resized": f"SELECT seq, ts_ms, weight::DOUBLE AS weight FROM ({E}) WHERE ts_ms >= (SELECT max(epoch_us(ts) // 1000) FROM events) - {3 * DAY}",
        "retention_sizes": f"SELECT count(*) FILTER (weight = 1) AS size, count(*) FILTER (weight = 3) AS reference_size FROM ({THINNED})",
        "pool_reference": f"WITH {sides(E, by_type)} SELECT unit, round(ref_w, 4) AS ref_w, round(ref_n, 4) AS ref_n, round(ref_mean, 4) AS ref_mean, round(ref_var, 4) AS ref_var, ref_count, ref_windows FROM pool",
        "reference_usable": f"WITH {sides(P, by_type)} SELECT unit, coalesce(ref_n >= 3 AND ref_var > 0, FALSE) AS usable FROM pool",
        "unscored_groups": f"WITH {sides(P, by_type)} SELECT DISTINCT group_label FROM obs WHERE group_label IS NOT NULL AND group_label NOT IN (SELECT unit FROM pool WHERE ref_n >= 3 AND ref_var > 0)",
        "sidak_threshold": f"SELECT n, round({sidak_z_sql('2.0', 'n')}, 4) AS z FROM (SELECT unnest(range(1, 61)) AS n)",
        "family_alpha": f"SELECT n, round(2 * (1 - {norm_cdf_sql('(n / 20.0)')}), 4) AS alpha, round({norm_cdf_sql('(n / 20.0 - 1.5)')}, 4) AS cdf, round({norm_ppf_sql('(n / 61.0)')}, 4) AS ppf FROM (SELECT unnest(range(1, 61)) AS n)",
        "curate_spike_dip": f"WITH {scores(E, None, 0.8)} {SCORED}",
        "curate_spike_dip_lattice": f"WITH {scores(P, None, 0.8)} {SCORED}",
        "curate_grouped": f"WITH {scores(E, by_type, 0.8)} {SCORED}",
        "curate_steps": f"WITH {sides(E, None)}, {STEPS} SELECT {TILE} FROM steps",
        "curate_gaps": f"""WITH {sides(E, by_two, HOUR)}, n AS (SELECT o.*, lead(window_start) OVER (PARTITION BY group_label ORDER BY window_start) AS nx
            FROM obs o JOIN pool ON group_label = unit WHERE ref_n >= 3 AND ref_var > 0)
          SELECT 'gap' AS shape_tag, group_label, window_end AS region_start, nx AS region_end, NULL::DOUBLE AS magnitude FROM n WHERE nx - window_end >= {2 * HOUR}""",
        "curate_divergence": f"""WITH a AS ({even}), b AS ({odd}), p AS (SELECT a.window_start AS region_start, a.window_end AS region_end, abs(a.mean - b.mean) AS d FROM a JOIN b USING (window_start)),
          z AS (SELECT *, (d - avg(d) OVER ()) / nullif(stddev_pop(d) OVER (), 0) AS magnitude FROM p) SELECT 'divergence' AS shape_tag, NULL::VARCHAR AS group_label, region_start, region_end, round(magnitude, 4) AS magnitude FROM z WHERE magnitude >= 0.5""",
        "curate_baseline": f"WITH {scores(E, None, 0.8)}, {base_pick} SELECT 'baseline' AS shape_tag, NULL::VARCHAR AS group_label, region_start, region_end, NULL::DOUBLE AS magnitude FROM pick WHERE region_start NOT IN (SELECT window_start FROM scored WHERE tag IS NOT NULL)",
        "unreachable_tails": f"WITH {scores(TIGHT, by_type, 2.0)}, {tails} SELECT unit, direction, round(z, 4) AS attainable_z, round(th, 4) AS required_z FROM t WHERE z < th",
        "curate_top_tiles": f"""WITH {scores(E, None, 0.8)}, {STEPS}, {base_pick},
          pairs AS (SELECT o.window_start, o.window_end, abs(o.mean - r.mean) AS d FROM obs o JOIN ref r USING (window_start)),
          gaps AS (SELECT window_end AS s, lead(window_start) OVER (ORDER BY window_start) AS e FROM obs),
          found AS (SELECT * FROM ({SPIKES}) UNION ALL SELECT * FROM steps
            UNION ALL SELECT 'gap', NULL, s, e, NULL FROM gaps WHERE e - s >= {2 * DAY}
            UNION ALL SELECT 'divergence', NULL, window_start, window_end, z FROM (SELECT *, (d - avg(d) OVER ()) / nullif(stddev_pop(d) OVER (), 0) AS z FROM pairs) WHERE z >= 0.5),
          every AS (SELECT * FROM found UNION ALL SELECT 'baseline', NULL, region_start, region_end, NULL FROM pick WHERE region_start NOT IN (SELECT region_start FROM found))
          SELECT {TILE} FROM (SELECT * FROM every ORDER BY coalesce(magnitude, 0) DESC,
            CASE shape_tag WHEN 'spike' THEN 0 WHEN 'dip' THEN 0 WHEN 'step_up' THEN 1 WHEN 'step_down' THEN 1 WHEN 'divergence' THEN 2 WHEN 'gap' THEN 3 ELSE 4 END, region_start LIMIT 12)""",
        "tile_text": f"""WITH {scores(E, by_type, 0.1)} SELECT tag AS shape_tag, window_start AS region_start, tag || ' in ' || group_label AS label,
          printf('mean %s the reference by %.1f standard errors', CASE WHEN tag = 'spike' THEN 'above' ELSE 'below' END, abs(raw_z)) AS description FROM scored WHERE tag IS NOT NULL""",
        "package_header": f"""WITH {scores(E, by_type, 2.0)}, {tails} SELECT (SELECT count(*) FROM obs WHERE group_label IS NULL) AS window_count, (SELECT sum(count)::BIGINT FROM obs WHERE group_label IS NULL) AS event_count,
          (SELECT max(window_end) - min(window_start) FROM obs WHERE group_label IS NULL) AS span_ms, round(ref_mean, 4) AS mean, round(sqrt(ref_var), 4) AS std_dev, coalesce(ref_n >= 3 AND ref_var > 0, FALSE) AS reference_usable,
          (SELECT count(*) FROM scored) AS family_n, (SELECT count(DISTINCT group_label) FROM obs WHERE group_label IS NOT NULL AND group_label NOT IN (SELECT unit FROM pool WHERE ref_n >= 3 AND ref_var > 0)) AS unscored_groups,
          coalesce((SELECT string_agg(DISTINCT group_label, ',' ORDER BY group_label) FROM obs WHERE group_label IS NOT NULL AND group_label NOT IN (SELECT unit FROM pool WHERE ref_n >= 3 AND ref_var > 0)), '') AS unscored_labels,
          coalesce((SELECT string_agg(unit || ':' || direction, ',' ORDER BY unit || ':' || direction) FROM t WHERE z < th), '') AS unreachable,
          2.0::DOUBLE AS base_z, round({sidak_z_sql('2.0', '(SELECT count(*) FROM scored)')}, 4) AS effective_z FROM pool WHERE unit = ''""",
        "live_spans_curated": f"WITH {live_scores} {SCORED}",
        "domain_rollup": f"SELECT domain, (SELECT count(*) FROM (SELECT unnest(areas) AS bit FROM ({T})) WHERE bit BETWEEN lo AND hi) AS occurrences FROM {DICTIONARY}",
        "domain_coverage": f"SELECT domain, covered, required::BIGINT AS required, greatest(required - covered, 0)::BIGINT AS gap FROM (SELECT *, (SELECT count(DISTINCT bit) FROM (SELECT unnest(areas) AS bit FROM ({T})) WHERE bit BETWEEN lo AND hi) AS covered FROM {DICTIONARY})",
        "coverage_gaps": f"""SELECT commit_hash, domain, covered, required::BIGINT AS required, (required - covered)::BIGINT AS gap FROM (
            SELECT commit_hash, domain, required, count(DISTINCT CASE WHEN bit BETWEEN lo AND hi THEN bit END) AS covered
            FROM (SELECT commit_hash, unnest(areas) AS bit FROM ({T})), {DICTIONARY} GROUP BY ALL) WHERE covered < required""",
        "primary_domain": f"SELECT split_part(who, '|', 2) AS domain, count(*) AS n FROM ({observed}) GROUP BY 1",
        "observed_tests": shown(windows(observed, DAY, "who")),
        "observed_agent": shown(windows(f"SELECT * FROM ({observed}) WHERE who LIKE 'agent-A|%'", DAY)),
        "tick_agent_stats": f"SELECT tick_ts, agent_id, round(pass_rate, 4) AS pass_rate, round(flaky_rate, 4) AS flaky_rate, event_count FROM ({AGENTS})",
        "tick_domain_stats": domains_at(WINDOW),
        "tick_touched_bits": f"SELECT tick_ts, count(DISTINCT bit) AS touched FROM ({bits_at(WINDOW)}) GROUP BY 1",
        "snapshot_frames": f"""SELECT tick_ts, coalesce(agents, 0) AS agents, coalesce(events, 0)::BIGINT AS events, gap, touched
          FROM (SELECT tick_ts, sum(gap)::BIGINT AS gap FROM ({domains_at(WINDOW)}) GROUP BY 1) JOIN (SELECT tick_ts, count(DISTINCT bit) AS touched FROM ({bits_at(WINDOW)}) GROUP BY 1) USING (tick_ts)
          LEFT JOIN (SELECT tick_ts, count(*) AS agents, sum(event_count) AS events FROM ({AGENTS}) GROUP BY 1) USING (tick_ts)""",
        "parallel_views": " UNION ALL ".join(f"SELECT '{v}' AS view, * FROM ({shown(windows(E, w, by))})" for v, w, by in (("fine", 6 * HOUR, None), ("by_type", DAY, by_type), ("coarse", 2 * DAY, None))),
        "brain_baseline_ewma": f"{fold()} SELECT tick_ts, agent_id, round(b, 4) AS baseline, n AS observations, round(th, 4) AS threshold FROM f WHERE i > 0",
        "brain_ar": f"{fold()} SELECT tick_ts, 'rerouteSchema' AS type, agent_id AS subject FROM f WHERE ar",
        "brain_rc": f"{fold()} SELECT tick_ts, 'replayRequest' AS type, agent_id AS subject, dip_start - 5000 AS from_ts, tick_ts + 5000 AS to_ts, 'observe:test_result:v1#fine' AS scope, 1000::BIGINT AS window_ms, 'agentId' AS group_by FROM f WHERE rc",
        "brain_cg": f"""WITH s AS (SELECT *, sum((gap <= 4)::INT) OVER (PARTITION BY domain ORDER BY tick_ts) AS run FROM ({domains_at(ALERT_WINDOW)})),
          p AS (SELECT *, row_number() OVER (PARTITION BY domain, run ORDER BY tick_ts) AS place FROM s WHERE gap > 4) SELECT tick_ts, 'schemaUpdate' AS type, domain AS subject, gap FROM p WHERE place = 5""",
        "brain_decisions": f"""{fold()}, s AS (SELECT *, sum((gap <= 4)::INT) OVER (PARTITION BY domain ORDER BY tick_ts) AS run FROM ({domains_at(ALERT_WINDOW)})),
          p AS (SELECT *, row_number() OVER (PARTITION BY domain, run ORDER BY tick_ts) AS place FROM s WHERE gap > 4)
          SELECT tick_ts, 'rerouteSchema' AS type, agent_id AS subject FROM f WHERE ar UNION ALL SELECT tick_ts, 'replayRequest', agent_id FROM f WHERE rc
          UNION ALL SELECT tick_ts, 'schemaUpdate', domain FROM p WHERE place = 5""",
        "brain_reset": f"{fold(resets=RESETS)} SELECT tick_ts, 'rerouteSchema' AS type, agent_id AS subject FROM f WHERE ar",
        "brain_shadow": f"SELECT * FROM (SELECT 'primary' AS source, 'rerouteSchema' AS type, count(*) AS n FROM ({fold()} SELECT * FROM f WHERE ar) UNION ALL SELECT 'shadow', 'rerouteSchema', count(*) FROM ({fold(0.05)} SELECT * FROM f WHERE ar)) WHERE n > 0",
        "late_arrival_equivalence": shown(windows(E, DAY)),
        "registry_resolution": f"WITH writes(i, s, w) AS (VALUES {writes}), looks(schema, view) AS (VALUES {looks}) SELECT schema, view, coalesce({row("'observe:' || schema || '#' || view")}, {row("'observe:' || schema")}, {row("'observe:*'")})::BIGINT AS window_ms FROM looks",
        "calibration_false_alarm": trial_sql("0.95"),
        "calibration_quiet_trials": trial_sql("0.95", "SELECT trial_id FROM t WHERE NOT blind AND z >= " + sidak_z_sql("2.0", "windows")),
        "calibration_power": trial_sql("CASE WHEN is_obs AND ts_ms >= 18000 THEN 0.90 ELSE 0.95 END"),
    }
    top = found["curate_top_tiles"].replace(TILE, TILE.split(", round(")[0] + ", magnitude")
    hourly = found["curate_gaps"]
    texts = """replace(shape_tag, '_', ' ') || CASE WHEN group_label IS NOT NULL THEN ' in ' || group_label ELSE '' END AS label, CASE shape_tag
        WHEN 'spike' THEN printf('mean above the reference by %.1f standard errors', magnitude) WHEN 'dip' THEN printf('mean below the reference by %.1f standard errors', magnitude)
        WHEN 'step_up' THEN printf('a run of windows above the reference, %.1f standard errors', magnitude) WHEN 'step_down' THEN printf('a run of windows below the reference, %.1f standard errors', magnitude)
        WHEN 'divergence' THEN printf('observation and reference differ more than usual, %.3f deviations', magnitude)
        WHEN 'gap' THEN printf('no events for %.1f s', (region_end - region_start) / 1000.0) ELSE 'a quiet window near the reference mean' END AS description"""
    found["tile_text_shapes"] = f"SELECT shape_tag, region_start, {texts} FROM (SELECT * FROM ({top}) UNION ALL SELECT * FROM ({hourly}))"
    params = [json.dumps(row, sort_keys=True) for _, row, _ in DELTAS]
    times = [-(2**53) if at is None else at for _, _, at in DELTAS]
    writes = ", ".join(f"({i + 1}, {at}, '{p}')" for i, (at, p) in enumerate(zip(times, params, strict=True)))
    found["snapshot_writes"] = f"""SELECT tick_ts, touched, (SELECT count(*) FROM w WHERE at_ms <= tick_ts) AS writes, (SELECT max_by(params, seq) FROM w WHERE at_ms <= tick_ts) AS last_write
      FROM ({found["tick_touched_bits"]}), (SELECT 1)"""
    found["snapshot_writes"] = f"WITH w(seq, at_ms, params) AS (VALUES {writes}) " + found["snapshot_writes"]
    return found
