"""What the registered queries say, as SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from tidemark.operators.report import HISTORY_PATTERNS, TEMPORAL_MOTION, UTILITY
from tidemark.operators.text import ADVICE, NOTHING
from tidemark.operators.verdict import CRITICAL, METRICS, REVIEW

_FRAMES = """
fr AS (SELECT user_id ep, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 fi, epoch_us(ts) / 1e6 t, value v,
              CAST(json_extract_string(props, '$.k') AS DOUBLE) k, event_id FROM events)"""
_STEPS = (
    _FRAMES
    + """,
s1 AS (SELECT *, v - lag(v) OVER w d1, k - lag(k) OVER w dk, t - lag(t) OVER w dt FROM fr WINDOW w AS (PARTITION BY ep ORDER BY fi)),
s2 AS (SELECT *, d1 - lag(d1) OVER w d2, abs(d1) motion, abs(d1 - lag(d1) OVER w) jump, sqrt(d1 * d1 + dk * dk) sn,
              d1 / (CASE WHEN dt = 0 THEN 1e-9 ELSE dt END) v1, dk / (CASE WHEN dt = 0 THEN 1e-9 ELSE dt END) v2 FROM s1 WINDOW w AS (PARTITION BY ep ORDER BY fi)),
s3 AS (SELECT *, sqrt(v1 * v1 + v2 * v2) speed, v1 - lag(v1) OVER w a1, v2 - lag(v2) OVER w a2 FROM s2 WINDOW w AS (PARTITION BY ep ORDER BY fi)),
st AS (SELECT *, sqrt(a1 * a1 + a2 * a2) chg FROM s3)"""
)
_ROBUST = (
    _STEPS
    + """,
jm AS (SELECT ep, median(jump) med FROM st GROUP BY ep),
jd AS (SELECT st.ep, any_value(med) med, median(abs(jump - med)) mad FROM st JOIN jm ON st.ep = jm.ep GROUP BY st.ep),
jz AS (SELECT st.*, med, mad, CASE WHEN jump IS NULL THEN NULL WHEN mad = 0 THEN 0.0 ELSE 0.6745e0 * (jump - med) / mad END z FROM st JOIN jd ON st.ep = jd.ep),
aj AS (SELECT ep, count(*) frames, count(*) FILTER (abs(z) > 5) sc, quantile_cont(jump, 0.95) p95, quantile_cont(jump, 0.99) p99, max(jump) mx FROM jz GROUP BY ep)"""
)
_IDLE = (
    _STEPS
    + """,
bins AS (SELECT unnest(range(30)) i),
m AS (SELECT ep, fi, motion m FROM st WHERE motion IS NOT NULL),
mx AS (SELECT ep, count(*) n, max(m) mx, median(m) med FROM m GROUP BY ep),
md AS (SELECT m.ep, median(abs(m.m - mx.med)) mad FROM m JOIN mx ON m.ep = mx.ep GROUP BY m.ep),
h AS (SELECT mx.ep, b.i, mx.n, mx.mx, sum(CASE WHEN m.m >= b.i * (mx.mx / 30) AND (b.i = 29 OR m.m < (b.i + 1) * (mx.mx / 30)) THEN 1 ELSE 0 END) c
      FROM mx JOIN m ON m.ep = mx.ep CROSS JOIN bins b WHERE mx.n >= 10 AND mx.mx > 1e-6 GROUP BY mx.ep, b.i, mx.n, mx.mx),
hc AS (SELECT *, c * 1.0e0 / n f, sum(c) OVER (PARTITION BY ep ORDER BY i) * 1.0e0 / n cum FROM h),
v0 AS (SELECT ep, min(i) i0 FROM hc WHERE cum >= 0.1e0 AND f < 0.01e0 GROUP BY ep),
j0 AS (SELECT hc.ep, v0.i0, min(hc.i) j FROM hc JOIN v0 ON hc.ep = v0.ep WHERE hc.i > v0.i0 AND hc.f > 0.02e0 GROUP BY hc.ep, v0.i0),
cand AS (SELECT hc.ep, hc.i, hc.mx, row_number() OVER (PARTITION BY hc.ep ORDER BY hc.c, hc.i) rn FROM hc JOIN j0 ON hc.ep = j0.ep WHERE hc.i >= j0.i0 AND hc.i < j0.j AND hc.f < 0.01e0),
bt AS (SELECT ep, (i + 1) * (mx / 30) t FROM cand WHERE rn = 1),
th AS (SELECT mx.ep, mx.n, greatest(coalesce(bt.t, 3.0e0 * md.mad), 1e-6) thr,
              CASE WHEN bt.t IS NOT NULL THEN 'bimodal_gap' WHEN 3.0e0 * md.mad < 1e-6 THEN 'floor' ELSE 'mad' END AS "method"
       FROM mx JOIN md ON mx.ep = md.ep LEFT JOIN bt ON mx.ep = bt.ep),
im AS (SELECT m.ep, fi, m.m < thr idle, thr, "method", row_number() OVER (PARTITION BY m.ep ORDER BY fi) - 1 step FROM m JOIN th ON m.ep = th.ep),
ir AS (SELECT ep, any_value("method") AS "method", any_value(thr) thr, count(*) FILTER (idle) * 1.0e0 / count(*) idle_ratio FROM im GROUP BY ep)"""
)
_RUNS = (
    _IDLE
    + """,
il AS (SELECT *, sum(CAST(idle AS INT)) OVER (PARTITION BY ep ORDER BY fi) island, lag(idle, 1, true) OVER (PARTITION BY ep ORDER BY fi) was FROM im),
rn AS (SELECT ep, min(fi) AS start, count(*) + 1 frames FROM il WHERE NOT idle GROUP BY ep, island),
wn AS (SELECT *, sum(CAST(NOT idle AS INT)) OVER (PARTITION BY ep ORDER BY fi ROWS 3 PRECEDING) = 4 AND step >= 3 w5,
              sum(CAST(NOT idle AS INT)) OVER (PARTITION BY ep ORDER BY fi ROWS 8 PRECEDING) = 9 AND step >= 8 w10,
              sum(CAST(NOT idle AS INT)) OVER (PARTITION BY ep ORDER BY fi ROWS 18 PRECEDING) = 19 AND step >= 18 w20 FROM il),
t1 AS (SELECT ep, 1 - sum(CAST(NOT idle AS INT)) * 1.0e0 / count(*) idle_total,
              CAST(CASE WHEN min(step) FILTER (NOT idle) > 0 THEN min(step) FILTER (NOT idle) + 1 WHEN min(step) FILTER (NOT idle) = 0 THEN 0 ELSE count(*) + 1 END AS BIGINT) idle_prefix,
              count(*) FILTER (NOT idle AND was) transitions,
              CASE WHEN count(*) + 1 < 5 THEN 0.0 ELSE count(*) FILTER (w5) * 1.0e0 / (count(*) - 3) END valid_5,
              CASE WHEN count(*) + 1 < 10 THEN 0.0 ELSE count(*) FILTER (w10) * 1.0e0 / (count(*) - 8) END valid_10,
              CASE WHEN count(*) + 1 < 20 THEN 0.0 ELSE count(*) FILTER (w20) * 1.0e0 / (count(*) - 18) END valid_20 FROM wn GROUP BY ep),
ts AS (SELECT t1.*, coalesce(p50, 0.0) run_p50, coalesce(p90, 0.0) run_p90, coalesce(mx, 0) run_max
       FROM t1 LEFT JOIN (SELECT ep, quantile_cont(frames, 0.5) p50, quantile_cont(frames, 0.9) p90, max(frames) mx FROM rn GROUP BY ep) r ON t1.ep = r.ep)"""
)
_AUDIT = (
    _ROBUST
    + ","
    + _IDLE.removeprefix(_STEPS).lstrip(",")
    + """,
cm AS (SELECT ep, median(chg) med FROM st GROUP BY ep),
cd AS (SELECT st.ep, any_value(med) med, median(abs(chg - med)) mad FROM st JOIN cm ON st.ep = cm.ep GROUP BY st.ep),
ve AS (SELECT st.ep, quantile_cont(speed, 0.5) velocity_p50, quantile_cont(speed, 0.95) velocity_p95, quantile_cont(speed, 0.99) velocity_p99, max(speed) velocity_max,
              count(*) FILTER (mad > 0 AND abs(0.6745e0 * (chg - med) / nullif(mad, 0)) > 5) acc_spikes FROM st JOIN cd ON st.ep = cd.ep GROUP BY st.ep),
tr AS (SELECT ep, count(*) frames, max_by(t, fi) - min_by(t, fi) duration, coalesce(sum(sn), 0.0) path_length, max_by(v, fi) end_v,
              quantile_cont(sn / (CASE WHEN dt <= 0 THEN 1e-9 ELSE dt END), 0.95) pace_p95, quantile_cont(abs(dt * 1000), 0.5) dt_p50,
              count(*) FILTER (dt < 0) backward, greatest(1 - count(*) FILTER (dt = 0) * 1.0e0 / count(*), 0.0) time_score FROM st GROUP BY ep),
e0 AS (SELECT ep, v, k, min(v) OVER p lv, max(v) OVER p hv, min(k) OVER p lk, max(k) OVER p hk FROM fr WINDOW p AS (PARTITION BY ep)),
e1 AS (SELECT ep, v, k, lv - CASE WHEN lv = hv THEN 0.5e0 ELSE 0 END lv, hv + CASE WHEN lv = hv THEN 0.5e0 ELSE 0 END hv, lk - CASE WHEN lk = hk THEN 0.5e0 ELSE 0 END lk, hk + CASE WHEN lk = hk THEN 0.5e0 ELSE 0 END hk FROM e0),
oc AS (SELECT ep, count(DISTINCT 10 * (@V) + @K) occupied FROM e1 GROUP BY ep),
sc AS (SELECT tr.*, oc.occupied / 100.0e0 occupancy_rate, aj.sc spike_count, CASE WHEN aj.frames >= 3 THEN 'pass' ELSE 'na' END jump_status, aj.p95 jump_p95, ir."method", ir.thr, ir.idle_ratio, 1 - ir.idle_ratio effective_motion_ratio,
              ve.velocity_p50, ve.velocity_p95, ve.velocity_p99, ve.velocity_max, ve.acc_spikes,
              CASE WHEN 1 - idle_ratio < 0.1 THEN 40 WHEN 1 - idle_ratio < 0.2 THEN 30 WHEN 1 - idle_ratio < 0.3 THEN 20 WHEN 1 - idle_ratio < 0.5 THEN 10 ELSE 0 END idle_points,
              CASE WHEN aj.sc > 100 THEN 30 WHEN aj.sc > 50 THEN 20 WHEN aj.sc > 20 THEN 10 ELSE 0 END spike_points
       FROM tr LEFT JOIN oc ON tr.ep = oc.ep LEFT JOIN aj ON tr.ep = aj.ep LEFT JOIN ir ON tr.ep = ir.ep LEFT JOIN ve ON tr.ep = ve.ep),
au AS (SELECT *, idle_points + spike_points severity, backward > 0 hard_fail,
              CASE WHEN backward > 0 THEN 'EXCLUDE' WHEN idle_points + spike_points >= 20 THEN 'REVIEW' ELSE 'PASS' END verdict FROM sc)"""
)
# The bin of v and of k: how many of the nine inner edges lie at or below.
_PLACE = {"@V": " + ".join(f"CAST(v - lv >= {i} * ((hv - lv) / 10) AS INT)" for i in range(1, 10)), "@K": " + ".join(f"CAST(k - lk >= {i} * ((hk - lk) / 10) AS INT)" for i in range(1, 10))}


def _coarse(x: str) -> str:
    """The bin among five."""
    return " + ".join(f"CAST({x} - l{x} >= {i} * ((h{x} - l{x}) / 5) AS INT)" for i in range(1, 5))


_AUDIT = _AUDIT.replace("@V", _PLACE["@V"]).replace("@K", _PLACE["@K"])
# The metrics with the frames they need; two of them need a side table.
_NEEDS = """(VALUES ('missing_dropout', 0), ('invalid_values', 0), ('schema_consistency', 0), ('timestamp_validity', 0), ('joint_limit', NULL), ('sensor_synchronization', NULL), ('sampling_jitter', 2),
                ('velocity_acceleration', 3), ('action_discontinuity', 3), ('temporal_sufficiency', 2), ('idle_ratio', 2), ('distribution', 1), ('coverage', 1)) nd(metric, need)"""
_STATUS = """CASE WHEN need IS NULL OR frames < need THEN 'na' WHEN metric = 'timestamp_validity' AND backward > 0 THEN 'exclude' WHEN metric = 'action_discontinuity' AND spike_points > 0 THEN 'review'
                  WHEN metric = 'idle_ratio' AND idle_points > 0 THEN 'review' ELSE 'pass' END"""
_LISTED = """ep, metric, CASE WHEN status = 'na' THEN 'not_available' ELSE 'available' END availability, status, status = 'pass' passed, status IN ('review', 'exclude') has_finding,
             CASE WHEN status = 'na' THEN 0.0e0 WHEN metric = 'timestamp_validity' THEN CASE WHEN status = 'pass' THEN CAST(time_score AS DOUBLE) ELSE 0.0e0 END WHEN metric = 'joint_limit' AND status = 'review' THEN 0.0e0 ELSE 1.0e0 END score"""
_RESULTS = _AUDIT + f""",
re AS (SELECT *, {_STATUS} status FROM au, {_NEEDS}),
rs AS (SELECT {_LISTED} FROM re)"""
_PATTERNS = (
    _AUDIT
    + """,
q0 AS (SELECT ep, coalesce(duration, 0) dur, coalesce(1 - effective_motion_ratio, 0) low, coalesce(spike_count, 0) spk, coalesce(path_length, 0) pth FROM au),
pc AS (SELECT ep, dur * low s, 0 o, 'STUCK_LIKE' pattern FROM q0 WHERE dur > 0 AND low > 0.5 AND spk < 5
       UNION ALL SELECT ep, low * 10, 1, 'FROZEN_LIKE' FROM q0 WHERE low > 0.8 AND spk < 2
       UNION ALL SELECT ep, spk, 2, 'JITTERY_LIKE' FROM q0 WHERE spk > 10
       UNION ALL SELECT ep, dur + pth / 100, 3, 'INEFFICIENT' FROM q0 WHERE dur > 0 AND pth > 0 AND low < 0.3),
pa AS (SELECT * FROM pc UNION ALL SELECT ep, dur * 0.1e0, 4, 'UNUSUAL' FROM q0 WHERE dur > 0 AND ep NOT IN (SELECT ep FROM pc)),
pt AS (SELECT ep, pattern, row_number() OVER (PARTITION BY ep ORDER BY s DESC, o) - 1 place FROM pa),
ph AS (SELECT ep, CASE WHEN effective_motion_ratio < 0.3 AND spike_count > 20 THEN 'Stuck' WHEN effective_motion_ratio < 0.3 THEN 'Frozen' WHEN spike_count > 20 THEN 'Jittery'
                       WHEN effective_motion_ratio < 0.5 THEN 'Inefficient' ELSE 'Unusual' END pattern FROM au)"""
)
_SCORES = (
    _AUDIT
    + """,
so AS (SELECT ep, unnest(['duration', 'spike_count', 'effective_motion_ratio', 'velocity_p95', 'path_length', 'velocity_max']) metric,
              unnest([duration, coalesce(CAST(spike_count AS DOUBLE), 0), coalesce(effective_motion_ratio, 0), coalesce(velocity_p95, 0), coalesce(path_length, 0), coalesce(velocity_max, 0)]) x FROM au),
sm AS (SELECT metric, median(x) med FROM so GROUP BY metric),
pr AS (SELECT so.metric, count(*) n, any_value(med) AS "median", median(abs(x - med)) mad, quantile_cont(x, 0.05) p05, quantile_cont(x, 0.25) p25, quantile_cont(x, 0.75) p75, quantile_cont(x, 0.95) p95
       FROM so JOIN sm ON so.metric = sm.metric GROUP BY so.metric),
zz AS (SELECT ep, so.metric, x, pr.*, (CASE WHEN so.metric = 'effective_motion_ratio' THEN -1 ELSE 1 END) * (CASE WHEN mad = 0 THEN 0.0 ELSE 0.6745e0 * (x - "median") / mad END) z FROM so JOIN pr ON so.metric = pr.metric),
zr AS (SELECT ep, metric, z, CASE WHEN mad = 0 THEN 0.5 WHEN x <= p05 THEN 0.05 WHEN x < p25 THEN 0.05 + (x - p05) / nullif(p25 - p05, 0) * 0.2 WHEN x < "median" THEN 0.25 + (x - p25) / nullif("median" - p25, 0) * 0.25
                WHEN x < p75 THEN 0.5 + (x - "median") / nullif(p75 - "median", 0) * 0.25 WHEN x < p95 THEN 0.75 + (x - p75) / nullif(p95 - p75, 0) * 0.2 ELSE 0.95 END rk FROM zz)"""
)
_DECIDED = (
    _AUDIT
    + """,
de AS (SELECT ep, verdict, CASE WHEN ep % 4 <> 0 THEN NULL WHEN ep % 3 = 0 THEN 'REMOVE' WHEN ep % 3 = 1 THEN 'KEEP' ELSE 'UNCERTAIN' END u FROM au),
ex AS (SELECT ep, CASE WHEN u = 'REMOVE' THEN false WHEN u IN ('KEEP', 'UNCERTAIN') THEN true ELSE verdict <> 'EXCLUDE' END kept,
              CASE WHEN u = 'REMOVE' THEN 'by_user' WHEN u = 'KEEP' THEN 'kept_by_user' WHEN u = 'UNCERTAIN' THEN 'uncertain' WHEN verdict = 'EXCLUDE' THEN 'by_verdict' ELSE 'kept' END reason FROM de),
la AS (SELECT ep, verdict, CASE WHEN ep % 5 = 0 THEN 'REMOVE' WHEN ep % 5 = 1 THEN 'REVIEW' ELSE 'KEEP' END label FROM au),
ri AS (SELECT ep, verdict, hard_fail, round(least(coalesce(spike_count, 0) / 25e0, 20.0) + greatest((0.5e0 - coalesce(effective_motion_ratio, 1)) * 20, 0.0) + least(coalesce(acc_spikes, 0) / 10e0, 10.0), 6) risk FROM au)"""
)
_VECTORS = """
ve AS (SELECT label ep, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 fi, embedding FROM embeddings),
lg AS (SELECT ep, fi, j, CAST(embedding[j + 1] AS DOUBLE) x FROM ve, (SELECT unnest(range(64)) j)),
l1 AS (SELECT *, x - lag(x) OVER (PARTITION BY ep, j ORDER BY fi) d1 FROM lg),
l2 AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY ep, j ORDER BY fi) d2 FROM l1)"""
_CELLS = (
    _VECTORS
    + """,
r1 AS (SELECT ep, fi, j, x, min(x) OVER (PARTITION BY ep, j) lo, max(x) OVER (PARTITION BY ep, j) hi FROM lg WHERE j < 3),
bn AS (SELECT unnest(range(10)) i),
cb AS (SELECT ep, fi, j, max(i) b FROM r1, bn WHERE x - lo >= i * ((hi - lo) / 10) GROUP BY ep, fi, j),
cl AS (SELECT ep, b0, b1, b2, count(*) n FROM (SELECT ep, fi, max(b) FILTER (j = 0) b0, max(b) FILTER (j = 1) b1, max(b) FILTER (j = 2) b2 FROM cb GROUP BY ep, fi) GROUP BY ALL)"""
)
_STREAMS = """
sr AS (SELECT user_id ep, event_type stream, epoch_us(ts) / 1e6 t FROM events),
sz AS (SELECT ep, stream, count(*) n FROM sr GROUP BY ALL),
pp AS (SELECT a.ep, a.stream one, b.stream two, CASE WHEN a.n > b.n THEN b.stream ELSE a.stream END base FROM sz a JOIN sz b ON a.ep = b.ep AND a.stream < b.stream),
sd AS (SELECT pp.*, unnest([one, two]) stream FROM pp),
ro AS (SELECT sd.*, t, sd.stream = base q, CASE WHEN sd.stream <> base THEN t END o FROM sr JOIN sd ON sr.ep = sd.ep AND sr.stream = sd.stream),
wi AS (SELECT *, max(o) OVER (PARTITION BY ep, one, two ORDER BY t RANGE UNBOUNDED PRECEDING) bk, min(o) OVER (PARTITION BY ep, one, two ORDER BY t RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ah FROM ro),
of AS (SELECT ep, one, two, ((CASE WHEN bk IS NULL THEN ah WHEN ah IS NULL OR t - bk <= ah - t THEN bk ELSE ah END) - t) * 1000 o FROM wi WHERE q),
sp AS (SELECT ep, one, two, count(*) n, quantile_cont(abs(o), 0.5) p50, quantile_cont(abs(o), 0.95) p95, quantile_cont(abs(o), 0.99) p99, max(abs(o)) offset_max, avg(o) offset_mean, stddev_pop(o) offset_std, median(o) signed_median FROM of GROUP BY ALL)"""


def _quantiles(cte: str, table: str, *columns: str) -> str:
    return f"WITH {cte} " + _quantile_rows(table, (0.05, 0.5, 0.95), *columns)


def _quantile_rows(table: str, shares: tuple[float, ...], *columns: str) -> str:
    parts = lambda c: ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {x}) p{round(100 * x):02d}" for x in shares)
    return " UNION ALL ".join(f"SELECT '{c}' metric, count({c}) available, {parts(c)} FROM {table}" for c in columns)


_DIMS = """
qd AS (SELECT round_even(100 * ((3 * count(*) + count(*) FILTER (backward = 0)) * 1.0e0 / (4 * count(*))), 1) integrity, round_even(50 + 50 * (count(*) FILTER (backward = 0) * 1.0e0 / count(*)), 1) temporal,
              round_even(100 * median(effective_motion_ratio), 1) motion, round_even(greatest(100 * (1 - least(quantile_cont(duration, 0.95) / quantile_cont(duration, 0.5) - 1, 1.0)), 0.0), 1) consistency FROM au)"""
_FULL = (
    _AUDIT
    + ","
    + _STREAMS
    + """,
sy AS (SELECT ep, count(*) pairs FROM sp GROUP BY ep),
vi AS (SELECT ep, count(*) FILTER (v < 0 OR v > 400) + count(*) FILTER (k < 0 OR k > 98.5e0) violations FROM fr GROUP BY ep),
fa AS (SELECT c_custkey ep, coalesce(au.frames, 0) frames, coalesce(severity, 0) severity, coalesce(backward, 0) backward, time_score, coalesce(spike_points, 0) spike_points, coalesce(idle_points, 0) idle_points,
              pairs, violations, coalesce(backward, 0) > 0 OR coalesce(violations, 0) > 0 hard_fail, spike_count, acc_spikes, idle_ratio, occupancy_rate
       FROM customer LEFT JOIN au ON c_custkey = au.ep LEFT JOIN vi ON c_custkey = vi.ep LEFT JOIN sy ON c_custkey = sy.ep),
fv AS (SELECT *, CASE WHEN frames = 0 OR hard_fail THEN 'EXCLUDE' WHEN severity >= 20 THEN 'REVIEW' ELSE 'PASS' END verdict FROM fa),
"""
    + f"""
fe AS (SELECT *, CASE metric WHEN 'joint_limit' THEN CASE WHEN violations IS NULL THEN 'na' WHEN violations > 0 THEN 'review' ELSE 'pass' END WHEN 'sensor_synchronization' THEN CASE WHEN pairs > 0 THEN 'pass' ELSE 'na' END
                      ELSE {_STATUS} END status FROM (SELECT * REPLACE (coalesce(time_score, 1.0e0) AS time_score) FROM fv) q, {_NEEDS}),
fs AS (SELECT {_LISTED} FROM fe UNION ALL SELECT ep, '_zero_frame_guard', 'available', 'fail', false, true, 0.0e0 FROM fv WHERE frames = 0)"""
)


def _observed(table: str, integrity: dict[str, str], sync: str, occupancy: bool = False) -> str:
    """The ranked findings over ``table``: which rows fail an integrity metric, and which have sensor offsets."""
    rows = [f"SELECT {i} place, '{k}' observation, CASE WHEN count(*) FILTER ({bad}) > 0 THEN 0 END l, count(*) FILTER ({bad}) episodes, count(*) n FROM {table}" for i, (k, bad) in enumerate(integrity.items())]
    rows.append(f"SELECT 5, 'sensor_synchronization', CASE WHEN count(*) FILTER ({sync}) > 0 THEN 1 ELSE 3 END, count(*) FILTER ({sync}), count(*) FROM {table}")
    rows.append(f"SELECT 6, 'action_discontinuity', CASE WHEN count(*) FILTER (spike_count > 0) = 0 THEN NULL WHEN count(*) FILTER (spike_count > 0) * 1.0e0 / count(*) < 0.1e0 THEN 1 ELSE 0 END, count(*) FILTER (spike_count > 0), count(*) FROM {table}")
    rows.append(f"SELECT 7, 'velocity_acceleration', CASE WHEN count(*) FILTER (acc_spikes > 0) > 0 THEN 2 END, count(*) FILTER (acc_spikes > 0), count(*) FROM {table}")
    if occupancy:
        rows.append(f"SELECT 8, 'state_space_occupancy', CASE WHEN median(occupancy_rate) < 0.1e0 THEN 1 ELSE 2 END, count(occupancy_rate), count(*) FROM {table}")
    rows.append(f"SELECT 9, 'idle_ratio', CASE WHEN median(idle_ratio) > 0.3e0 THEN 1 END, count(idle_ratio), count(*) FROM {table}")
    union = " UNION ALL ".join(rows)
    return f"SELECT row_number() OVER (ORDER BY l, -episodes, place) AS rank, observation, list_extract(['high', 'medium', 'low', 'info'], l + 1) significance, episodes, episodes * 1.0e0 / n ratio FROM ({union}) o WHERE l IS NOT NULL ORDER BY 1 LIMIT 5"


_JOINTS = f"WITH {_VECTORS}, a AS (SELECT ep, j, median(abs(d2)) med FROM l2 GROUP BY ALL), b AS (SELECT l2.ep, l2.j, any_value(med) med, median(abs(abs(d2) - med)) mad FROM l2 JOIN a ON l2.ep = a.ep AND l2.j = a.j GROUP BY ALL) SELECT l2.ep, l2.j joint, count(*) FILTER (mad > 0 AND abs(0.6745e0 * (abs(d2) - med)) > 5 * mad) spikes FROM l2 JOIN b ON l2.ep = b.ep AND l2.j = b.j GROUP BY ALL"

_EVIDENCE = "CASE WHEN bool_or(availability = 'available' AND NOT passed AND metric IN ('missing_dropout', 'invalid_values', 'schema_consistency', 'timestamp_validity', 'joint_limit')) THEN 'HARD_FAIL' WHEN bool_or(status = 'review' AND metric IN ('action_discontinuity', 'idle_ratio')) THEN 'RISK_SIGNAL' WHEN bool_or(availability = 'not_available') THEN 'UNVERIFIABLE' ELSE 'NO_FINDING' END"

# The deviation of an episode from its available results; what of it the table of episodes shows.
_OFF = "d AS (SELECT ep, coalesce(100 * (1 - avg(CAST(score AS DOUBLE)) FILTER (availability = 'available')), 0.0e0) d FROM rs GROUP BY ep)"
_BAD = "availability = 'available' AND NOT passed"
_SHOWN = f"""si AS (SELECT ep, coalesce(string_agg(upper(replace(metric, '_', '-')), ', ') FILTER ({_BAD} AND metric = 'timestamp_validity'), '') hard, count(*) FILTER ({_BAD}) n,
                      coalesce(list(upper(replace(metric, '_', '-')) ORDER BY list_position({list(METRICS)}, metric)) FILTER ({_BAD}), []) issues, bool_or({_BAD} AND metric IN {REVIEW}) other FROM rs GROUP BY ep),
sh AS (SELECT si.*, CASE WHEN coalesce(effective_motion_ratio, 1) < 0.3 AND coalesce(spike_count, 0) > 20 THEN 'Stuck-like (risk signal)' WHEN coalesce(effective_motion_ratio, 1) < 0.3 THEN 'Frozen-like (risk signal)'
                         WHEN coalesce(spike_count, 0) > 20 THEN 'Jitter-like (risk signal)' WHEN other THEN 'Unusual-like (risk signal)' END label FROM si JOIN au ON si.ep = au.ep)"""

ORACLES: dict[str, str] = {
    "frames_canonical": f"WITH {_FRAMES} SELECT ep, CAST(fi AS INT) fi, t, v, k FROM fr",
    "frame_deltas": f"WITH {_STEPS} SELECT ep, CAST(fi AS INT) fi, d1 FROM st",
    "second_diff": f"WITH {_STEPS} SELECT ep, CAST(fi AS INT) fi, d2 FROM st",
    "motion_norm": f"WITH {_STEPS} SELECT ep, CAST(fi AS INT) fi, sn FROM st",
    "dt_percentiles": f"WITH {_STEPS} SELECT ep, quantile_cont(abs(dt * 1000), 0.5) dt_p50, quantile_cont(abs(dt * 1000), 0.95) dt_p95, quantile_cont(abs(dt * 1000), 0.99) dt_p99, max(abs(dt * 1000)) dt_max FROM st WHERE dt IS NOT NULL GROUP BY ep",
    "sampling_jitter": f"WITH {_STEPS} SELECT ep, round(avg(dt * 1000), 3) dt_mean, round(CASE WHEN avg(dt * 1000) > 0 THEN stddev_pop(dt * 1000) / avg(dt * 1000) ELSE 0 END, 9) cv FROM st WHERE dt IS NOT NULL GROUP BY ep",
    "mad_per_episode": f"WITH {_ROBUST} SELECT ep, med, mad FROM jd",
    "robust_z": f"WITH {_ROBUST} SELECT ep, CAST(fi AS INT) fi, round(z, 9) z FROM jz",
    "action_spikes": f"WITH {_ROBUST} SELECT ep, CASE WHEN frames >= 3 THEN sc END spike_count FROM aj",
    "action_discontinuity": f"WITH {_ROBUST} SELECT ep, CASE WHEN frames >= 3 THEN 'pass' ELSE 'na' END status, CASE WHEN frames >= 3 THEN sc END spike_count, CASE WHEN frames >= 3 THEN sc * 1.0e0 / (frames - 2) END spike_rate, p95 jump_p95, p99 jump_p99, mx jump_max FROM aj",
    "joint_spikes": _JOINTS,
    "motion_histogram": f"WITH {_IDLE} SELECT ep, CAST(i AS INT) AS bin, CAST(c AS BIGINT) n FROM h WHERE c > 0 UNION ALL SELECT m.ep, CAST(max(i) AS INT), 1 FROM m JOIN mx ON m.ep = mx.ep CROSS JOIN bins WHERE mx.n < 10 AND mx.mx > 1e-6 AND m.m >= i * (mx.mx / 30) GROUP BY m.ep, m.fi",
    "idle_threshold": f'WITH {_IDLE} SELECT ep, n, "method", thr FROM th',
    "idle_mask": f"WITH {_IDLE} SELECT ep, CAST(fi AS INT) fi, idle FROM im",
    "idle_ratio": f'WITH {_IDLE} SELECT ep, "method", thr, idle_ratio FROM ir',
    "active_runs": f"WITH {_RUNS} SELECT ep, CAST(start AS INT) AS start, frames FROM rn",
    "temporal_sufficiency": f"WITH {_RUNS} SELECT ep, idle_total, idle_prefix, transitions, valid_5, valid_10, valid_20, run_p50, run_p90, run_max FROM ts",
    "temporal_sufficiency_dataset": _quantiles(_RUNS, "ts", "idle_total", "idle_prefix", "transitions", "run_p50", "run_max"),
    "timestamp_validity": "WITH d AS (SELECT l_suppkey ep, epoch_us(l_shipdate) / 1e6 t FROM lineitem), g AS (SELECT ep, t - lag(t) OVER (PARTITION BY ep ORDER BY t) dt FROM d) SELECT ep, count(*) frames, count(*) FILTER (dt < 0) backward, count(*) FILTER (dt = 0) duplicates, 'pass' status, greatest(1 - count(*) FILTER (dt = 0) * 1.0e0 / count(*), 0.0) score FROM g GROUP BY ep",
    "velocity_stats": f"WITH {_AUDIT} SELECT ep, CASE WHEN frames >= 3 THEN 'pass' ELSE 'na' END status, velocity_p50, velocity_p95, velocity_p99, velocity_max, acc_spikes FROM au",
    "trajectory_stats": f"WITH {_AUDIT} SELECT ep, frames, duration, round(path_length, 6) path_length, end_v, round(pace_p95, 6) velocity_p95 FROM au",
    "coverage": f"WITH {_CELLS}, f AS (SELECT ep, sum(n) t FROM cl GROUP BY ep) SELECT cl.ep, CAST(sum(n) AS BIGINT) frames, count(*) occupied, count(*) / 1000.0e0 occupancy_rate, count(*) FILTER (n < 0.1e0 * t / 1000) + 1000 - count(*) underrepresented FROM cl JOIN f ON cl.ep = f.ep GROUP BY cl.ep",
    "underrepresented_cells": f"WITH {_CELLS}, f AS (SELECT ep, sum(n) t FROM cl GROUP BY ep), g AS (SELECT ep, t, CAST(c // 100 AS INT) b0, CAST(c // 10 % 10 AS INT) b1, CAST(c % 10 AS INT) b2 FROM f, (SELECT unnest(range(1000)) c)) SELECT g.ep, g.b0, g.b1, g.b2, coalesce(n, 0) n FROM g LEFT JOIN cl ON g.ep = cl.ep AND g.b0 = cl.b0 AND g.b1 = cl.b1 AND g.b2 = cl.b2 WHERE coalesce(n, 0) < 0.1e0 * t / 1000",
    "missing_frames": f"WITH {_FRAMES}, k AS (SELECT ep, fi FROM fr WHERE event_id % 7 <> 0) SELECT ep, count(*) frames, count(*) - count(DISTINCT CASE WHEN fi < c THEN fi END) missing FROM (SELECT *, count(*) OVER (PARTITION BY ep) c FROM k) GROUP BY ep",
    "invalid_values": f"WITH {_FRAMES} SELECT ep, CAST(3 * count(*) AS BIGINT) cells, CAST(2 * count(*) FILTER (event_id % 97 = 0) AS BIGINT) nan_cells, CAST(2 * count(*) FILTER (event_id % 97 <> 0 AND event_id % 89 = 0) AS BIGINT) inf_cells, CASE WHEN bool_or(event_id % 97 = 0 OR event_id % 89 = 0) THEN 'exclude' ELSE 'pass' END status FROM fr GROUP BY ep",
    "joint_limit": f"WITH {_VECTORS} SELECT ep, CAST(j AS INT) joint, count(*) FILTER ((j = 0 AND abs(x) > 0.1) OR (j = 1 AND abs(x) > 0.05) OR (j = 2 AND (x < 0 OR x > 0.2))) violations FROM lg WHERE j < 3 GROUP BY ALL",
    "action_dim_stats": "WITH l AS (SELECT l_suppkey ep, unnest([0, 1, 2]) dim, unnest([CAST(l_quantity AS DOUBLE), CAST(l_discount AS DOUBLE), CAST(l_tax AS DOUBLE)]) x FROM lineitem) SELECT ep, dim, round(avg(x), 6) mean, round(stddev_pop(x), 6) std, quantile_cont(x, 0.05) p05, quantile_cont(x, 0.5) p50, quantile_cont(x, 0.95) p95, min(x) lo, max(x) hi FROM l GROUP BY ALL",
    "sensor_sync_pairs": f"WITH {_STREAMS} SELECT ep, one, two, n, round(p50, 3) p50, round(p95, 3) p95, round(p99, 3) p99, round(offset_max, 3) offset_max, round(offset_mean, 3) offset_mean, round(offset_std, 3) offset_std, round(signed_median, 3) signed_median FROM sp",
    "sensor_sync": f"WITH {_STREAMS} SELECT ep, count(*) pairs, round(max(p95), 3) worst_p95, round(max(offset_max), 3) worst_max FROM sp GROUP BY ep",
    "episode_verdict": f"WITH {_AUDIT} SELECT ep, frames, spike_count, effective_motion_ratio, severity, verdict FROM au",
    "behavior_severity": f"WITH {_AUDIT} SELECT severity, count(*) episodes FROM au GROUP BY severity",
    "verdict_counts": f"WITH {_AUDIT} SELECT v verdict, count(au.ep) episodes FROM (SELECT unnest(['PASS', 'REVIEW', 'EXCLUDE']) v) LEFT JOIN au ON v = verdict GROUP BY v",
    "episode_audit": f"WITH {_RESULTS} SELECT * FROM rs",
    "zero_frame_guard": f"WITH {_AUDIT} SELECT c_custkey ep, coalesce(frames, 0) frames, coalesce(verdict, 'EXCLUDE') verdict FROM customer LEFT JOIN au ON c_custkey = ep",
    "integrity_summary": f"WITH {_RESULTS} SELECT metric, count(*) FILTER (availability = 'available') available, count(*) FILTER (availability = 'available' AND passed) passed, count(*) FILTER (availability = 'available' AND NOT passed) failed, count(*) FILTER (availability <> 'available') na, coalesce(count(*) FILTER (availability = 'available' AND passed) * 1.0e0 / nullif(count(*) FILTER (availability = 'available'), 0), 0.0) pass_rate FROM rs GROUP BY metric",
    "score_distribution": f"WITH {_RESULTS}, d AS (SELECT metric, CAST(score AS DOUBLE) s FROM rs) SELECT metric, min(s) lo, quantile_cont(s, 0.05) p05, quantile_cont(s, 0.5) p50, quantile_cont(s, 0.95) p95, max(s) hi FROM d GROUP BY metric",
    "failing_metrics": f"WITH {_RESULTS} SELECT metric, count(*) episodes FROM rs WHERE availability = 'available' AND NOT passed GROUP BY metric",
    "issue_codes": f"WITH {_RESULTS} SELECT ep, metric, CASE metric WHEN 'timestamp_validity' THEN 'INT-04' WHEN 'action_discontinuity' THEN 'MOT-01' WHEN 'idle_ratio' THEN 'MOT-03' END code FROM rs WHERE availability = 'available' AND NOT passed",
    "evidence_summary": f"WITH {_RESULTS}, hr AS (SELECT ep, bool_or(availability = 'available' AND NOT passed AND metric = 'timestamp_validity') h, bool_or(status = 'review' AND metric IN ('action_discontinuity', 'idle_ratio')) r FROM rs GROUP BY ep) SELECT 'HARD_FAIL' evidence, CAST(NULL AS VARCHAR) metric, count(*) FILTER (h) episodes FROM hr UNION ALL SELECT 'RISK_SIGNAL', NULL, count(*) FILTER (r) FROM hr UNION ALL SELECT 'UNVERIFIABLE', metric, count(*) FROM rs WHERE availability = 'not_available' GROUP BY metric",
    "deviation_stats": f"WITH {_RESULTS}, d AS (SELECT ep, 100 * (1 - avg(CAST(score AS DOUBLE))) d FROM rs WHERE availability = 'available' GROUP BY ep) SELECT round(avg(d), 6) mean_deviation, round(median(d), 6) median_deviation FROM d",
    "temporal_motion_summary": f"WITH {_AUDIT} {_RUNS.removeprefix(_IDLE)}, tm AS (SELECT au.*, ts.* EXCLUDE (ep), idle_prefix * 1.0e0 / frames idle_prefix_ratio, CAST(NULL AS DOUBLE) worst_p95 FROM au LEFT JOIN ts ON au.ep = ts.ep), qq AS (" + _quantile_rows("tm", (0.05, 0.5, 0.95, 0.99), *TEMPORAL_MOTION) + ") SELECT qq.*, CASE WHEN metric = 'spike_count' THEN t.total END total, CASE WHEN metric = 'spike_count' THEN t.touched END touched FROM qq, (SELECT CAST(sum(spike_count) AS BIGINT) total, count(*) FILTER (spike_count > 0) touched FROM au) t",
    "utility_summary": _quantiles(_AUDIT, "au", *UTILITY),
    "audit_summary": f"WITH {_AUDIT} SELECT count(*) episodes, count(*) FILTER (verdict = 'PASS') passed, count(*) FILTER (verdict = 'REVIEW') review, count(*) FILTER (verdict = 'EXCLUDE') excluded, count(*) FILTER (verdict = 'PASS') * 1.0e0 / count(*) pass_rate FROM au",
    "pattern_type": f"WITH {_PATTERNS} SELECT ep, pattern, place FROM pt",
    "pattern_distribution": f"WITH {_PATTERNS} SELECT p pattern, count(pt.ep) episodes FROM (SELECT unnest(['STUCK_LIKE', 'FROZEN_LIKE', 'JITTERY_LIKE', 'INEFFICIENT', 'UNUSUAL']) p) LEFT JOIN pt ON p = pattern AND place = 0 GROUP BY p",
    "pattern_type_history": f"WITH {_PATTERNS} SELECT ep, pattern FROM ph",
    "pattern_counts": f"WITH {_PATTERNS} SELECT pattern, count(*) episodes FROM ph GROUP BY pattern",
    "deviation_heuristic": f"WITH {_AUDIT} SELECT ep, coalesce(spike_count, 0) spikes, coalesce(1 - effective_motion_ratio, 0) low_motion, round(duration + coalesce(spike_count, 0) + coalesce(1 - effective_motion_ratio, 0), 2) deviation FROM au",
    "quality_dimensions": f"WITH {_AUDIT}, {_DIMS} SELECT integrity, temporal, motion, consistency FROM qd",
    "dataset_health": f"WITH {_AUDIT}, {_DIMS}, q AS (SELECT count(*) n, count(*) FILTER (verdict = 'PASS') passes, count(*) FILTER (verdict = 'REVIEW') review, count(*) FILTER (verdict = 'EXCLUDE') excluded, count(*) FILTER (backward = 0) ok FROM au), z AS (SELECT *, CAST(round_even(0.4e0 * integrity + 0.2e0 * temporal + 0.2e0 * motion + 0.2e0 * consistency, 0) AS BIGINT) health, excluded * 1.0e0 / n x, review * 1.0e0 / n r FROM qd, q) SELECT n, passes, review, excluded, integrity, temporal, motion, consistency, health, CASE WHEN health >= 90 THEN 'Excellent' WHEN health >= 75 THEN 'Good' WHEN health >= 60 THEN 'Fair' ELSE 'Poor' END grade, CASE WHEN x < 0.05e0 AND r < 0.15e0 THEN 'Ready' WHEN x < 0.1e0 AND r < 0.3e0 THEN 'Conditionally Ready' ELSE 'Not Ready' END readiness, (3 * n + ok) // 5 integrity_passed, n - (3 * n + ok) // 5 integrity_failed, CAST(floor(least(100.0e0, health + least(20.0e0, 30 * x))) AS BIGINT) after_cleanup FROM z",
    "top_observations": f"WITH {_AUDIT} " + _observed("au", {"timestamp_validity": "backward > 0"}, "false"),
    "episode_report": f"WITH {_RESULTS}, {_PATTERNS.removeprefix(_AUDIT).lstrip(',')}, e AS (SELECT ep, {_EVIDENCE} evidence, coalesce(string_agg(CASE metric WHEN 'timestamp_validity' THEN 'INT-04' WHEN 'action_discontinuity' THEN 'MOT-01' WHEN 'idle_ratio' THEN 'MOT-03' END, ',' ORDER BY CASE metric WHEN 'timestamp_validity' THEN 1 WHEN 'action_discontinuity' THEN 2 ELSE 3 END) FILTER (availability = 'available' AND NOT passed), '') issues, coalesce(string_agg('INT-04', ',') FILTER (metric = 'timestamp_validity' AND NOT passed), '') hard_fail_issues, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (status = 'review'), '') risk_signals, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (availability = 'not_available'), '') unverifiable FROM rs GROUP BY ep), md2 AS (SELECT median(duration) median_duration, median(spike_count) median_spikes, median(velocity_p95) median_velocity FROM au) SELECT au.ep, verdict, severity, frames, duration, spike_count, effective_motion_ratio, velocity_p95, path_length, e.* EXCLUDE (ep), p0.pattern, p1.pattern second_pattern, 1 - coalesce(effective_motion_ratio, 1.0e0) low_motion, duration + coalesce(spike_count, 0) + (1 - coalesce(effective_motion_ratio, 1.0e0)) deviation, md2.* FROM au LEFT JOIN e ON au.ep = e.ep LEFT JOIN pt p0 ON au.ep = p0.ep AND p0.place = 0 LEFT JOIN pt p1 ON au.ep = p1.ep AND p1.place = 1 CROSS JOIN md2",
    "episode_table": f"WITH {_RESULTS}, {_OFF} SELECT au.ep, verdict, CASE verdict WHEN 'EXCLUDE' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END AS \"class\", round(d, 6) deviation, round(greatest(d, CAST(severity AS DOUBLE)), 6) issue_severity FROM au JOIN d ON au.ep = d.ep",
    "issue_stats": f"WITH {_AUDIT}, f AS (SELECT 'action_discontinuity' metric, spike_points p FROM au UNION ALL SELECT 'idle_ratio', idle_points FROM au) SELECT metric, CASE WHEN p >= 20 THEN 'medium' ELSE 'low' END AS level, count(*) episodes FROM f WHERE p > 0 GROUP BY ALL",
    "anonymize": "SELECT DISTINCT user_id ep, 'redacted:' || substr(sha256('/data/' || user_id), 1, 16) path FROM events",
    "spike_regions": f"WITH {_ROBUST}, f AS (SELECT ep, fi, z, count(*) OVER (PARTITION BY ep) n FROM jz) SELECT ep, CAST(fi AS INT) fi, CAST(greatest(fi - greatest(1, n // 100), 0) AS BIGINT) AS start, CAST(least(fi + greatest(1, n // 100), n - 1) AS BIGINT) AS \"end\" FROM f WHERE abs(z) > 5",
    "episode_lookup": f"WITH {_FRAMES} SELECT ep, CAST(fi AS INT) fi, v FROM fr WHERE ep = 7",
    "portable_metrics": f"WITH {_AUDIT} SELECT ep, duration, CAST(spike_count AS DOUBLE) spike_count, effective_motion_ratio FROM au",
    "platform_metrics": f"WITH {_AUDIT} SELECT ep, velocity_p95, velocity_max, round(path_length, 6) path_length FROM au",
    "reference_profile": f"WITH {_SCORES} SELECT metric, n, \"median\", mad, p05, p25, p75, p95 FROM pr",
    "bad_z": f"WITH {_SCORES} SELECT ep, metric, round(z, 9) + 0 z FROM zr",
    "percentile_rank": f"WITH {_SCORES} SELECT ep, metric, round(rk, 9) AS rank FROM zr",
    "rms_score": f"WITH {_SCORES} SELECT ep, round(sqrt(avg(z * z) FILTER (metric IN ('duration', 'spike_count', 'effective_motion_ratio'))), 6) portable_score, round(sqrt(avg(z * z) FILTER (metric IN ('velocity_p95', 'path_length', 'velocity_max'))), 6) platform_score, round(sqrt(avg(z * z)), 6) combined_rms FROM zr GROUP BY ep",
    "pca_covariance": f"WITH {_SCORES} SELECT a.metric one, b.metric two, round(covar_pop(a.z, b.z), 6) cov FROM zr a JOIN zr b ON a.ep = b.ep GROUP BY ALL",
    "export_decisions": f"WITH {_DECIDED} SELECT ep, kept, reason FROM ex",
    "export_report": f"WITH {_DECIDED} SELECT reason, count(*) episodes, count(*) FILTER (kept) kept FROM ex GROUP BY reason",
    "export_frames": f"WITH {_DECIDED} SELECT fr.ep, CAST(fi AS INT) fi FROM fr JOIN ex ON fr.ep = ex.ep WHERE kept",
    "risk_score": f"WITH {_DECIDED} SELECT ep, verdict, risk FROM ri",
    "stable_sample": "SELECT ep, sha256('salt:a1:' || ep) AS \"key\" FROM (SELECT DISTINCT user_id ep FROM events) ORDER BY 2 LIMIT 20",
    "blind_sample": f"WITH {_DECIDED}, p AS (SELECT *, 'd' || ep % 3 dataset FROM ri), k AS (SELECT *, row_number() OVER (PARTITION BY dataset, hard_fail ORDER BY ep) h, row_number() OVER (PARTITION BY dataset, hard_fail ORDER BY risk DESC, ep DESC) t, row_number() OVER (PARTITION BY dataset, hard_fail ORDER BY risk, ep) l FROM p), f AS (SELECT *, CASE WHEN hard_fail AND h = 1 THEN 0 WHEN NOT hard_fail AND t = 1 THEN 1 WHEN NOT hard_fail AND l = 1 THEN 2 ELSE 3 END c FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY c, sha256(dataset || ':/r/' || dataset || ':' || ep)) n FROM f) SELECT dataset, ep, printf('S%04d', row_number() OVER (ORDER BY dataset, ep)) sample_id FROM r WHERE n <= 6",
    "qc_normalise": f"WITH {_DECIDED} SELECT ep, label FROM la",
    "qc_confusion": f"WITH {_DECIDED} SELECT l.label, v verdict, count(ep) FILTER (verdict = v AND la.label = l.label) n FROM (SELECT unnest(['KEEP', 'REVIEW', 'REMOVE']) label) l, (SELECT unnest(['PASS', 'REVIEW', 'EXCLUDE']) v), la GROUP BY l.label, v",
    "qc_metrics": f"WITH {_DECIDED}, b AS (SELECT *, verdict <> 'PASS' f, label <> 'KEEP' bad, ep % 7 sec FROM la), c AS (SELECT count(*) samples, count(*) FILTER (bad AND f) tp, count(*) FILTER (NOT bad AND f) fp, count(*) FILTER (bad AND NOT f) fn, count(*) FILTER (NOT bad AND NOT f) tn, count(*) FILTER ((label, verdict) IN (('KEEP', 'PASS'), ('REVIEW', 'REVIEW'), ('REMOVE', 'EXCLUDE'))) ag, count(*) FILTER (NOT bad) k, count(*) FILTER (NOT bad AND verdict = 'REVIEW') kr, count(*) FILTER (label = 'REMOVE') rm, count(*) FILTER (label = 'REMOVE' AND verdict = 'EXCLUDE') hf, count(*) timed, CAST(sum(sec) AS DOUBLE) ts, avg(sec) ms FROM b) SELECT samples, tp, fp, fn, tn, round(ag * 1.0e0 / nullif(samples, 0), 6) agreement, round(tp * 1.0e0 / nullif(tp + fp, 0), 6) AS \"precision\", round(tp * 1.0e0 / nullif(tp + fn, 0), 6) recall, round(kr * 1.0e0 / nullif(k, 0), 6) kept_to_review_rate, round(hf * 1.0e0 / nullif(rm, 0), 6) exclude_overlap, hf hard_fail_overlap, timed, ts total_seconds, round(ms, 3) mean_seconds FROM c",
}

# Interpolated percentiles and quotients differ between engines in the last bits: rounded alike on both sides.
_TABLE = ORACLES["episode_table"]
_RMS = ORACLES["rms_score"]
ORACLES |= {
    "idle_prefix": f"WITH {_RUNS} SELECT ep, idle_prefix FROM ts",
    "idle_transitions": f"WITH {_RUNS} SELECT ep, transitions FROM ts",
    "valid_windows": f"WITH {_RUNS} SELECT ep, valid_5, valid_10, valid_20 FROM ts",
    "dt_stats": f"WITH {_STEPS} SELECT ep, quantile_cont(abs(dt * 1000), 0.5) dt_p50, quantile_cont(abs(dt * 1000), 0.95) dt_p95, quantile_cont(abs(dt * 1000), 0.99) dt_p99, max(abs(dt * 1000)) dt_max, avg(dt * 1000) dt_mean, stddev_pop(dt * 1000) dt_std, CASE WHEN avg(dt * 1000) > 0 THEN stddev_pop(dt * 1000) / avg(dt * 1000) ELSE 0.0 END cv FROM st WHERE dt IS NOT NULL GROUP BY ep",
    "dataset_info": "SELECT count(DISTINCT user_id) episodes, count(*) frames FROM events",
    "schema_consistency": "SELECT user_id ep, count(*) frames, CAST(bool_or(event_id % 101 = 0) AS INT) short, CASE WHEN bool_or(event_id % 101 = 0) THEN 'exclude' ELSE 'pass' END status FROM events GROUP BY user_id",
    "integrity_pass_rate": f"WITH {_AUDIT} SELECT round(count(*) FILTER (NOT hard_fail) * 1.0e0 / count(*), 4) integrity_pass_rate FROM au",
    "episode_integrity": f"WITH {_RESULTS} SELECT ep, NOT bool_or(b) passed, coalesce(string_agg(CASE metric WHEN 'invalid_values' THEN 'INT-02' ELSE 'INT-04' END, ',' ORDER BY metric) FILTER (b), '') codes FROM (SELECT *, availability = 'available' AND NOT passed AND metric IN ('invalid_values', 'timestamp_validity') b FROM rs) q GROUP BY ep",
    "reference_medians": f"WITH {_AUDIT} SELECT median(duration) duration, median(spike_count) spikes, median(velocity_p95) velocity_p95 FROM au",
    "validation_records": f"SELECT ep, verdict, frames FROM ({ORACLES['zero_frame_guard']}) q WHERE frames > 0",
    "episode_csv": f"WITH {_AUDIT} SELECT ep, frames, duration, verdict, spike_count, idle_ratio, issue_severity FROM au JOIN ({_TABLE}) t USING (ep, verdict)",
    "review_queue": f"SELECT ep, verdict, issue_severity FROM ({_TABLE}) t WHERE verdict <> 'PASS'",
    "removal_list": f"SELECT ep, reason, issue_severity FROM (SELECT *, CASE WHEN ep % 4 = 0 THEN CASE ep % 3 WHEN 0 THEN 'by_user' END WHEN verdict = 'REVIEW' THEN 'by_review' WHEN verdict = 'EXCLUDE' THEN 'by_verdict' END reason FROM ({_TABLE}) t) q WHERE reason IS NOT NULL ORDER BY issue_severity DESC, ep LIMIT 20",
    "audit_trend": f"WITH {_AUDIT}, sn AS (SELECT ep % 5 run, round(count(*) FILTER (verdict = 'PASS') * 1.0e0 / count(*), 4) v FROM au GROUP BY ep % 5) SELECT 'a1' AS name, run, v AS value, round(v - lag(v) OVER (ORDER BY run), 4) AS change FROM sn",
    "history_merged": f"WITH {_PATTERNS} SELECT CAST(au.ep % 5 AS VARCHAR) run, count(*) episodes, count(*) FILTER (verdict = 'PASS') passes, count(*) FILTER (verdict = 'REVIEW') review, count(*) FILTER (verdict = 'EXCLUDE') excluded, CAST(coalesce(sum(spike_count), 0) AS BIGINT) total_spikes, "
    + ", ".join(f"count(*) FILTER (ph.pattern = '{p}') n_{p.lower()}" for p in HISTORY_PATTERNS)
    + " FROM au JOIN ph ON au.ep = ph.ep GROUP BY au.ep % 5",
    "score_summary": " UNION ALL ".join(f"SELECT '{c}' score, median({c}) median, quantile_cont({c}, 0.95) p95, avg({c}) mean, max({c}) largest FROM ({_RMS}) q" for c in ("portable_score", "platform_score", "combined_rms")),
}

ORACLES |= {
    "sensor_offsets_bucketed": f"WITH {_STREAMS} SELECT ep, one, two, n, round(offset_max, 3) offset_max, round(offset_mean, 3) offset_mean FROM sp",
    "coverage_two_dims": f"WITH {_AUDIT}, cn AS (SELECT ep, 10 * (@V) + @K c, count(*) n FROM e1 GROUP BY ALL), ct AS (SELECT ep, sum(n) t FROM cn GROUP BY ep) SELECT cn.ep, CAST(sum(n) AS BIGINT) frames, count(*) occupied, count(*) / 100.0e0 occupancy_rate, count(*) FILTER (n < 0.1e0 * t / 100) + 100 - count(*) underrepresented FROM cn JOIN ct ON cn.ep = ct.ep GROUP BY cn.ep".replace("@V", _PLACE["@V"]).replace("@K", _PLACE["@K"]),
    "export_custom": f"WITH {_DECIDED}, i AS (SELECT ep FROM au UNION SELECT unnest(range(0, 400, 2))), j AS (SELECT i.ep, de.u, coalesce(de.verdict, 'PASS') v FROM i LEFT JOIN de ON i.ep = de.ep) SELECT ep, CASE WHEN u = 'REMOVE' THEN false WHEN u IN ('KEEP', 'UNCERTAIN') THEN true ELSE v <> 'REVIEW' END kept, CASE WHEN u = 'REMOVE' THEN 'by_user' WHEN u = 'KEEP' THEN 'kept_by_user' WHEN u = 'UNCERTAIN' THEN 'uncertain' WHEN v = 'REVIEW' THEN 'by_review' ELSE 'kept' END reason FROM j",
    "affected_joints": f"SELECT ep, coalesce(string_agg(joint, ',' ORDER BY joint) FILTER (spikes > 0), '') joints FROM ({_JOINTS}) q GROUP BY ep",
    "missing_dropout": f"WITH {_FRAMES}, k AS (SELECT ep, fi FROM fr WHERE event_id % 7 <> 0), m AS (SELECT ep, count(*) frames, count(*) - count(DISTINCT CASE WHEN fi < c THEN fi END) missing FROM (SELECT *, count(*) OVER (PARTITION BY ep) c FROM k) GROUP BY ep) SELECT ep, frames, missing, CAST(0 AS BIGINT) dropout, CASE WHEN missing > 0 THEN 'review' ELSE 'pass' END status FROM m",
    "corrupt_verdict": f"WITH {_AUDIT}, b AS (SELECT ep, bool_or(event_id % 97 = 0 OR event_id % 89 = 0) bad FROM fr GROUP BY ep) SELECT au.ep, CASE WHEN bad THEN 'exclude' WHEN frames < 3 THEN 'na' ELSE 'pass' END jump_status, CASE WHEN frames < 2 THEN 'na' WHEN bad THEN 'exclude' ELSE 'pass' END idle_status, CASE WHEN bad THEN 'exclude' WHEN frames < 3 THEN 'na' ELSE 'pass' END velocity_status, CASE WHEN bad THEN 'na' ELSE 'pass' END coverage_status, bad OR hard_fail hard_fail, CASE WHEN bad THEN 'EXCLUDE' ELSE verdict END verdict FROM au JOIN b ON au.ep = b.ep",
    "episode_audit_full": f"WITH {_FULL} SELECT * FROM fs",
    "episode_verdict_full": f"WITH {_FULL} SELECT ep, frames, severity, hard_fail, verdict FROM fv",
    "top_observations_full": f"WITH {_FULL} " + _observed("fv", {"missing_dropout": "false", "invalid_values": "false", "schema_consistency": "false", "timestamp_validity": "backward > 0", "joint_limit": "violations > 0"}, "pairs > 0", True),
    "evidence_level": f"WITH {_RESULTS} SELECT ep, {_EVIDENCE} evidence FROM rs GROUP BY ep",
    "approx_percentile": f"WITH {_SCORES} SELECT ep, round(max(greatest(rk, 1 - rk)), 9) percentile FROM zr WHERE metric IN ('duration', 'spike_count', 'effective_motion_ratio') GROUP BY ep",
    "reference_injection": f"WITH {_RESULTS}, {_SCORES.removeprefix(_AUDIT).lstrip(',')} SELECT rs.ep, rs.metric, round(CASE WHEN zr.metric = 'effective_motion_ratio' THEN -z ELSE z END, 9) + 0 z, round(rk, 9) percentile FROM rs LEFT JOIN zr ON rs.ep = zr.ep AND rs.metric = CASE zr.metric WHEN 'duration' THEN 'distribution' WHEN 'spike_count' THEN 'action_discontinuity' WHEN 'effective_motion_ratio' THEN 'idle_ratio' END",
    "dataset_health_ui": f"WITH {_AUDIT}, q AS (SELECT count(*) n, 100 * count(*) FILTER (NOT hard_fail) * 1.0e0 / count(*) integrity, 70 * count(*) FILTER (backward = 0) * 1.0e0 / count(*) + 25.5e0 temporal, coalesce(avg(100 * effective_motion_ratio), 90.0e0) / 2 + coalesce(avg(greatest(100 - 2 * spike_count, 0)) FILTER (jump_status <> 'na'), 95.0e0) / 2 motion, count(*) FILTER (verdict = 'PASS') * 1.0e0 / count(*) p, count(*) FILTER (verdict = 'REVIEW') * 1.0e0 / count(*) r, count(*) FILTER (verdict = 'EXCLUDE') * 1.0e0 / count(*) x FROM au), z AS (SELECT *, 100 * p + 50 * r consistency, 0.4e0 * integrity + 0.2e0 * temporal + 0.2e0 * motion + 0.2e0 * (100 * p + 50 * r) health FROM q) SELECT n, integrity, temporal, motion, consistency, health, CASE WHEN health >= 90 THEN 'Excellent' WHEN health >= 75 THEN 'Good' WHEN health >= 60 THEN 'Fair' ELSE 'Poor' END grade, CASE WHEN x < 0.05e0 AND r < 0.15e0 THEN 'Ready' WHEN x < 0.1e0 AND r < 0.3e0 THEN 'Conditionally Ready' ELSE 'Not Ready' END readiness, CASE WHEN x < 1 THEN least(60 * (p + 0.7e0 * r) / (1 - x) + 0.4e0 * integrity, 100.0e0) ELSE health END after_cleanup FROM z",
    "hero_metrics": f"WITH {_AUDIT}, b AS (SELECT CAST(coalesce(sum(spike_count), 0) AS BIGINT) total_spikes, count(*) FILTER (spike_count > 0) spiky_episodes FROM au), a AS (SELECT count(worst_p95) sync_episodes, median(worst_p95) sync_median FROM ({ORACLES['sensor_sync']}) s), c AS (SELECT median(occupancy_rate) occupancy_median FROM ({ORACLES['coverage']}) o) SELECT *, CASE WHEN sync_median IS NULL THEN 'na' WHEN sync_median < 5 THEN 'excellent' WHEN sync_median < 20 THEN 'acceptable' WHEN sync_median < 50 THEN 'needs_check' ELSE 'severe' END sync_band, CASE WHEN occupancy_median > 0.5e0 THEN 'good' WHEN occupancy_median > 0.2e0 THEN 'moderate' ELSE 'low' END occupancy_band FROM a, b, c",
    "episode_diagnosis": f"WITH {_PATTERNS}, ad AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', '{w}', '{n}')" for k, (w, n) in ADVICE.items())
    + f") v(pattern, why, \"next\")) SELECT au.ep, 'Episode ' || concat_ws(', ', CASE WHEN duration > 0 THEN printf('duration = %.2fs', duration) END, CASE WHEN coalesce(spike_count, 0) > 0 THEN printf('%d action spikes', spike_count) END, 'effective motion = ' || CAST(CAST(round_even(100 * (1 - (1 - coalesce(effective_motion_ratio, 1.0e0))), 0) AS BIGINT) AS VARCHAR) || '%') || '.' AS what, coalesce(why, '{NOTHING[0]}') why, coalesce(\"next\", '{NOTHING[1]}') AS \"next\" FROM au LEFT JOIN pt ON au.ep = pt.ep AND place = 0 LEFT JOIN ad ON pt.pattern = ad.pattern",
    "feature_keys": "SELECT DISTINCT n AS name, CASE WHEN starts_with(n, 'observation.') THEN 'modality' WHEN n = 'action' OR starts_with(n, 'action.') THEN 'action' END kind, regexp_replace(n, '^(observation|action)\\.', '') AS label FROM (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'observation.' WHEN 1 THEN 'action.' ELSE 'other.' END || l_returnflag n FROM lineitem) q",
}
ORACLES |= {
    "episode_ranks": f"WITH {_RESULTS}, {_OFF}, k AS (SELECT ep, round(d, 2) deviation FROM d) SELECT au.ep, verdict, deviation, row_number() OVER (ORDER BY CASE verdict WHEN 'EXCLUDE' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END, deviation DESC, au.ep) AS rank FROM au JOIN k ON au.ep = k.ep",
    "episode_overview": f"WITH {_RESULTS}, {_OFF}, {_SHOWN} SELECT au.ep, frames, CASE WHEN hard = '' THEN 'PASS' ELSE 'FAIL' END integrity_check, CASE hard WHEN '' THEN '—' ELSE hard END integrity_issues, verdict, round(d, 2) deviation, coalesce(label, '—') pattern, CASE n WHEN 0 THEN 'None' ELSE array_to_string(issues[1:3], ', ') END top_issues, n issue_count FROM au JOIN d ON au.ep = d.ep JOIN sh ON au.ep = sh.ep",
    "episode_export": f"WITH {_RESULTS}, {_OFF}, {_SHOWN} SELECT au.ep episode_id, frames num_frames, CASE WHEN hard = '' THEN 'PASS' ELSE 'FAIL' END integrity_check, verdict behavior_verdict, round(greatest(round(d, 2), CAST(severity AS DOUBLE)), 2) issue_severity_score, coalesce(label, '') pattern_type, n + CAST(label IS NOT NULL AS BIGINT) issue_count, concat_ws('; ', nullif(array_to_string(issues, '; '), ''), 'PATTERN_' || upper(label)) top_issues, '' user_decision, '' user_notes FROM au JOIN d ON au.ep = d.ep JOIN sh ON au.ep = sh.ep",
    "issue_counts": f"WITH {_FULL}, c AS (SELECT ep, bool_or({_BAD} AND metric IN {CRITICAL}) h, bool_or({_BAD} AND metric IN {REVIEW}) r, count(*) FILTER (availability = 'not_available') u FROM fs GROUP BY ep) SELECT count(*) FILTER (h) critical, count(*) FILTER (r OR severity > 0) warning, count(*) FILTER (r OR severity > 0) risk_signal, CAST(sum(u) AS BIGINT) unverifiable, CAST(0 AS BIGINT) info FROM c JOIN fv ON c.ep = fv.ep",
    "top_issues": f"WITH {_FULL}, i AS (SELECT metric FROM fs WHERE {_BAD} UNION ALL SELECT 'action_discontinuity' FROM fv WHERE spike_points > 0 UNION ALL SELECT 'idle_ratio' FROM fv WHERE idle_points > 0), c AS (SELECT metric, count(*) episodes FROM i GROUP BY metric) SELECT metric, upper(replace(metric, '_', '-')) code, episodes, CASE WHEN metric IN {CRITICAL} THEN 'critical' WHEN metric IN {REVIEW} THEN 'warning' ELSE 'info' END severity, CASE WHEN metric IN {CRITICAL} THEN 'HARD_FAIL' WHEN metric IN {REVIEW} THEN 'RISK_SIGNAL' ELSE 'UNVERIFIABLE' END evidence, CASE metric WHEN 'action_discontinuity' THEN 'Jitter-like (risk signal)' WHEN 'idle_ratio' THEN 'Stuck/Frozen-like (risk signal)' WHEN 'velocity_acceleration' THEN 'Jitter-like (risk signal)' END pattern FROM c ORDER BY episodes DESC, coalesce(list_position({list(METRICS)}, metric), 14), metric LIMIT 10",
    "listed_episodes": f"WITH {_FULL} SELECT verdict, CAST(ep // 100 AS BIGINT) part, string_agg(CAST(ep AS VARCHAR), ',' ORDER BY ep) episodes FROM fv WHERE verdict <> 'PASS' GROUP BY ALL",
    "legacy_aggregates": f"WITH {_FULL}, w AS (SELECT ep, max(p95) p FROM sp GROUP BY ep) SELECT (SELECT quantile_cont(dt_p50, 0.5) FROM au) median, (SELECT quantile_cont(dt_p50, 0.95) FROM au) p95, (SELECT quantile_cont(dt_p50, 0.99) FROM au) p99, (SELECT quantile_cont(p, 0.95) FROM w) sync_p95, (SELECT max(p) FROM w) sync_max, CAST(sum(violations) AS BIGINT) total_joint_violations, CAST(sum(spike_count) AS BIGINT) total_discontinuity_spikes, count(*) FILTER (spike_count > 0) discontinuity_affected_episodes, quantile_cont(idle_ratio, 0.95) idle_p95 FROM fv",
    "measured_with_parameters": "WITH " + _AUDIT + ", jw AS (SELECT ep, count(*) FILTER (abs(z) > 8) wide FROM jz GROUP BY ep), og AS (SELECT ep, count(DISTINCT 5 * (@V) + @K) occupied FROM e1 GROUP BY ep) SELECT au.ep, CASE WHEN au.ep % 2 = 1 AND spike_count IS NOT NULL THEN wide ELSE spike_count END spike_count, idle_ratio, CASE WHEN au.ep % 2 = 1 THEN occupied / 25.0e0 ELSE occupancy_rate END occupancy_rate, \"method\" FROM au JOIN jw ON au.ep = jw.ep JOIN og ON au.ep = og.ep".replace("@V", _coarse("v")).replace("@K", _coarse("k")),
    "episode_verdict_blocks": ORACLES["episode_verdict"],
    "episode_documents": f"SELECT ep, hard_fail_issues = '' passed, CASE verdict WHEN 'PASS' THEN 'LIKELY_USABLE' WHEN 'REVIEW' THEN 'NEEDS_REVIEW' ELSE 'RECOMMENDED_EXCLUDE' END behavior_verdict, evidence evidence_level, issues, hard_fail_issues, risk_signals, unverifiable unverifiable_metrics, pattern, second_pattern, why FROM ({ORACLES['episode_report']}) r JOIN ({ORACLES['episode_diagnosis']}) d USING (ep)",
    "dataset_document": "SELECT 'events' dataset_id, n total_episodes, health dhi, readiness training_readiness, CAST(NULL AS BIGINT) backward_episodes, " + ", ".join(f"(SELECT max(episodes) FILTER ({w}) FROM ({ORACLES[k]}) e) {c}" for c, k, w in [("hard_fail_episodes", "evidence_summary", "evidence = 'HARD_FAIL'"), ("risk_signal_episodes", "evidence_summary", "evidence = 'RISK_SIGNAL'"), ("unverifiable_limits", "evidence_summary", "metric = 'joint_limit'"), *[(p.lower(), "pattern_distribution", f"pattern = '{p}'") for p in ("STUCK_LIKE", "FROZEN_LIKE", "JITTERY_LIKE", "INEFFICIENT", "UNUSUAL")]]) + f", after_cleanup estimated_post_cleanup_quality FROM ({ORACLES['dataset_health']}) h",
}
ROUNDED: dict[str, tuple[str, ...]] = {
    "legacy_aggregates": ("median", "p95", "p99", "sync_p95", "sync_max", "idle_p95"),
    "dt_percentiles": ("dt_p50", "dt_p95", "dt_p99", "dt_max"),
    "mad_per_episode": ("med", "mad"),
    "action_discontinuity": ("spike_rate", "jump_p95", "jump_p99", "jump_max"),
    "idle_threshold": ("thr",),
    "idle_ratio": ("thr", "idle_ratio"),
    "temporal_sufficiency": ("idle_total", "valid_5", "valid_10", "valid_20", "run_p50", "run_p90"),
    "temporal_sufficiency_dataset": ("p05", "p50", "p95"),
    "velocity_stats": ("velocity_p50", "velocity_p95", "velocity_p99", "velocity_max"),
    "action_dim_stats": ("p05", "p50", "p95"),
    "temporal_motion_summary": ("p05", "p50", "p95", "p99"),
    "utility_summary": ("p05", "p50", "p95"),
    "quality_dimensions": ("integrity", "temporal", "motion", "consistency"),
    "dataset_health_ui": ("integrity", "temporal", "motion", "consistency", "health", "after_cleanup"),
    "hero_metrics": ("sync_median", "occupancy_median"),
    "episode_report": ("duration", "effective_motion_ratio", "velocity_p95", "path_length", "low_motion", "deviation", "median_duration", "median_velocity"),
    "top_observations_full": ("ratio",),
    "percentile_rank": ("rank",),
    "approx_percentile": ("percentile",),
    "dataset_health": ("integrity", "temporal", "motion", "consistency"),
    "episode_verdict": ("effective_motion_ratio",),
    "episode_verdict_blocks": ("effective_motion_ratio",),
    "measured_with_parameters": ("idle_ratio",),
    "deviation_heuristic": ("low_motion",),
    "portable_metrics": ("duration", "effective_motion_ratio"),
    "platform_metrics": ("velocity_p95", "velocity_max"),
    "reference_profile": ("median", "mad", "p05", "p25", "p75", "p95"),
    "top_observations": ("ratio",),
    "valid_windows": ("valid_5", "valid_10", "valid_20"),
    "dt_stats": ("dt_p50", "dt_p95", "dt_p99", "dt_max", "dt_mean", "dt_std", "cv"),
    "reference_medians": ("duration", "velocity_p95"),
    "episode_csv": ("duration", "idle_ratio", "issue_severity"),
    "score_summary": ("median", "p95", "mean", "largest"),
    "score_distribution": ("p05", "p50", "p95"),
}
ORACLES |= {f"{k}_refined": ORACLES[k] for k in ("utility_summary", "reference_profile")}
ROUNDED |= {f"{k}_refined": ROUNDED[k] for k in ("utility_summary", "reference_profile")}
ORACLES |= {k: "SELECT * REPLACE (" + ", ".join(f'round("{c}", 6) AS "{c}"' for c in v) + f") FROM ({ORACLES[k]}) q" for k, v in ROUNDED.items()}
