"""The registered queries as DuckDB SQL over the same tables, written independently of the library.

``chain`` derives everything from a list of events keyed by ``aid``; with one key per attempt it
gives the batch results, with one key per event prefix the progressive ones.
"""

from __future__ import annotations

EPOCH = 1704067200000000
WEEK = 7 * 86400000000

EVENTS = f"""
src AS (
  SELECT event_id, user_id, event_type AS src, epoch_us(ts) - {EPOCH} AS us,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 4 AS co
  FROM events),
ev AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || CAST(CASE WHEN co = 1 THEN 0 ELSE us // {WEEK} END AS VARCHAR) AS attempt_id,
    CASE WHEN src = 'view' OR (src = 'click' AND k % 10 < 7) THEN 'question_view'
         WHEN src = 'click' THEN 'question_answer'
         WHEN src = 'purchase' THEN 'clipboard'
         WHEN src = 'error' THEN 'visibility_change'
         WHEN k % 10 < 8 THEN 'idle_state'
         WHEN k % 10 = 8 THEN 'exam_started' ELSE 'exam_submitted' END AS event_type,
    CASE WHEN src = 'view' THEN 'enter'
         WHEN src = 'click' AND k % 10 < 7 THEN 'leave'
         WHEN src = 'purchase' THEN CASE WHEN co <> 1 AND k % 2 = 0 THEN 'paste' ELSE 'copy' END END AS action,
    CASE WHEN src = 'error' THEN CASE WHEN k % 10 < (CASE co WHEN 0 THEN 8 WHEN 1 THEN 3 ELSE 4 END) THEN 'hidden' ELSE 'visible' END
         WHEN src = 'signup' AND k % 10 < 8 THEN CASE WHEN k % 2 = 0 THEN 'idle' ELSE 'active' END END AS state,
    'q' || CAST(k % 5 + 1 AS VARCHAR) AS question_id,
    us // (CASE WHEN co = 0 THEN 14400 ELSE 3600 END) AS t,
    event_id AS seq, event_id AS arrival, us + {EPOCH} AS received_us, k,
    'candidate_' || CAST(user_id AS VARCHAR) AS candidate_id,
    CASE WHEN user_id % 7 <> 0 THEN 'Candidate ' || CAST(user_id AS VARCHAR) END AS candidate_name,
    CASE WHEN user_id % 7 <> 0 THEN 'c' || CAST(user_id AS VARCHAR) || '@example.org' END AS candidate_email,
    'assessment_' || CAST(user_id % 3 AS VARCHAR) AS assessment_id,
    'Assessment ' || CAST(user_id % 3 AS VARCHAR) AS assessment_name,
    CASE co WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS expected_label,
    user_id % 10 = 0 AS is_edge_case,
    'profile_' || CAST(user_id % 10 AS VARCHAR) AS profile
  FROM src)"""

ISO = "replace(CAST(make_timestamp({us}) AS VARCHAR), ' ', 'T') || 'Z'"

RAW = f""",
raw AS (
  SELECT arrival AS id, attempt_id,
    CASE WHEN k = 96 AND attempt_id LIKE '1%' THEN attempt_id || '-other' WHEN k % 3 = 0 THEN attempt_id END AS event_attempt_id,
    candidate_id, candidate_name, candidate_email, assessment_id, assessment_name,
    CASE WHEN k <> 97 THEN event_type END AS event_type, action, state, question_id,
    CASE WHEN k = 98 THEN 'not a time' WHEN k <> 99 THEN {ISO.format(us=f"t + {EPOCH}")} END AS occurred_at,
    CASE WHEN k % 4 <> 0 THEN CAST(seq AS VARCHAR) END AS client_seq,
    {ISO.format(us="received_us")} AS received_at, received_us, t, k, arrival
  FROM ev)"""

W = "PARTITION BY aid ORDER BY t, seq, arrival"
BEFORE = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
AFTER = f"({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
QBEFORE = "(PARTITION BY aid, question_id ORDER BY t, seq, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def chain(source: str, min_questions: int = 4, extended: bool = False, predictions: str | None = None) -> str:
    """CTEs from ``source`` (aid, event columns) to ``result``; first CTE is ``fl``."""
    ratio = "hidden_us_sum / nullif(t_max - t_min, 0)" if extended else "0.0"
    fast = "fast_n / nullif(questions_seen, 0)" if extended else "0.0"
    gaps = "seq_gaps" if extended else "0"
    submit = "submits > 0" if extended else "true"
    ml_from = f"LEFT JOIN ({predictions}) ml USING (aid)" if predictions else ""
    ml_risk = "coalesce(ml.ml_risk, 'LOW')" if predictions else "'LOW'"
    ml_conf = "coalesce(ml.ml_confidence, 0.0)" if predictions else "0.0"
    return f"""
fl AS (
  SELECT *, event_type = 'clipboard' AND action IS NOT DISTINCT FROM 'paste' AS is_paste,
    event_type = 'visibility_change' AND state = 'hidden' AS is_hidden,
    event_type = 'visibility_change' AND state = 'visible' AS is_visible,
    event_type = 'idle_state' AND state = 'idle' AS is_idle,
    event_type = 'idle_state' AND state = 'active' AS is_active,
    event_type = 'question_view' AND action = 'enter' AS is_enter,
    event_type = 'question_view' AND action = 'leave' AS is_leave,
    event_type = 'question_answer' AS is_answer
  FROM ({source})),
qv AS (
  SELECT aid, arrival, t - p AS dur FROM (
    SELECT aid, arrival, t, action, lag(action) OVER (PARTITION BY aid ORDER BY t, seq, arrival) AS pa,
           lag(t) OVER (PARTITION BY aid ORDER BY t, seq, arrival) AS p
    FROM fl WHERE is_enter OR is_leave) WHERE action = 'leave' AND pa = 'enter' AND t > p),
idl AS (
  SELECT aid, arrival, t - p AS dur FROM (
    SELECT aid, arrival, t, state, lag(state) OVER (PARTITION BY aid ORDER BY t, seq, arrival) AS ps,
           lag(t) OVER (PARTITION BY aid ORDER BY t, seq, arrival) AS p
    FROM fl WHERE is_idle OR is_active) WHERE state = 'active' AND ps = 'idle'),
hid AS (
  SELECT aid, arrival, t - p AS dur FROM (
    SELECT aid, arrival, t, state, lag(state) OVER (PARTITION BY aid ORDER BY t, seq, arrival) AS ps,
           lag(t) OVER (PARTITION BY aid ORDER BY t, seq, arrival) AS p
    FROM fl WHERE is_hidden OR is_visible) WHERE state = 'visible' AND ps = 'hidden'),
mk AS (
  SELECT f.*, qv.dur AS question_us, idl.dur AS idle_us, hid.dur AS hidden_us
  FROM (SELECT *,
      last_value(CASE WHEN is_hidden THEN t END IGNORE NULLS) OVER {BEFORE} AS last_hidden,
      last_value(CASE WHEN is_active THEN t END IGNORE NULLS) OVER {BEFORE} AS last_active,
      last_value(CASE WHEN is_answer THEN t END IGNORE NULLS) OVER {BEFORE} AS prev_answer,
      last_value(CASE WHEN is_enter THEN CAST(substr(question_id, 2) AS BIGINT) END IGNORE NULLS) OVER {BEFORE} AS prev_qnum,
      last_value(CASE WHEN seq > 0 THEN seq END IGNORE NULLS) OVER {BEFORE} AS prev_seq,
      first_value(CASE WHEN is_leave THEN t END IGNORE NULLS) OVER {AFTER} AS next_leave,
      first_value(CASE WHEN is_answer THEN t END IGNORE NULLS) OVER {AFTER} AS next_answer,
      last_value(CASE WHEN is_enter THEN t END IGNORE NULLS) OVER {QBEFORE} AS last_enter
    FROM fl) f
  LEFT JOIN qv USING (aid, arrival) LEFT JOIN idl USING (aid, arrival) LEFT JOIN hid USING (aid, arrival)),
cand AS (
  SELECT *, is_paste AND t - last_hidden <= 30000000 AND last_hidden - last_active <= 45000000 AND next_leave - t <= 30000000 AS is_seq,
    is_leave AND t - last_enter <= 10000000 AND t - last_active <= 35000000 AS is_quick FROM mk),
ft0 AS (
  SELECT aid, count(*) FILTER (is_paste) AS paste_count, count(*) FILTER (is_hidden) AS tab_hidden_count,
    count(idle_us) AS idle_spike_count,
    coalesce(CAST(sum(question_us) AS BIGINT) / count(question_us) / 1000000, 0.0) AS time_per_question_mean_s,
    count(question_us) AS questions_seen, (max(t) - min(t)) / 1000000 AS attempt_duration_s,
    count(*) AS event_count, max(t) AS t_max, min(t) AS t_min,
    count(*) FILTER (is_seq) AS suspicious_sequence_count,
    count(*) FILTER (is_quick) AS quick_n,
    min(t - last_enter) FILTER (is_quick) AS quick_1,
    (list_sort(list(t - last_enter) FILTER (is_quick)))[2] AS quick_2,
    coalesce(CAST(sum(hidden_us) AS BIGINT), 0) AS hidden_us_sum, coalesce(CAST(sum(idle_us) AS BIGINT), 0) AS idle_us_sum,
    count(*) FILTER (question_us <= 10000000) AS fast_n,
    coalesce(quantile_cont(question_us, 0.1) / 1000000, 0.0) AS time_per_question_p10_s,
    coalesce(CAST(sum(CASE WHEN seq > 0 THEN greatest(seq - prev_seq - 1, 0) END) AS BIGINT), 0) AS seq_gaps,
    count(*) FILTER (event_type = 'exam_submitted') AS submits,
    count(*) FILTER (is_answer AND t - prev_answer <= 10000000) AS answer_burst_count,
    count(*) FILTER (is_visible AND next_answer - t <= 10000000) AS tab_return_fast_answer_count,
    coalesce(min(next_answer - t) FILTER (is_paste) / 1000000, 999.0) AS paste_to_answer_seconds_min,
    count(*) FILTER (is_paste AND next_answer - t <= 10000000) AS paste_to_answer_fast_count,
    count(*) FILTER (is_enter AND last_enter IS NOT NULL) AS navigation_revisit_count,
    count(*) FILTER (is_enter AND abs(CAST(substr(question_id, 2) AS BIGINT) - prev_qnum) > 1) AS question_jump_count,
    coalesce(stddev_pop(question_us) / avg(question_us), 0.0) AS timing_variance_score,
    count(*) FILTER (is_active AND least(next_leave, next_answer) - t <= 35000000) AS idle_to_activity_burst_count
  FROM cand GROUP BY aid),
ent AS (
  SELECT aid, greatest(-sum(p * log2(p)), 0.0) AS behavior_entropy_score
  FROM (SELECT aid, count(*) / sum(count(*)) OVER (PARTITION BY aid) AS p FROM fl GROUP BY aid, event_type) GROUP BY aid),
ft AS (
  SELECT ft0.*, behavior_entropy_score, coalesce({ratio}, 0.0) AS ratio, coalesce({fast}, 0.0) AS fast_ratio,
    {gaps} AS client_seq_gaps, {submit} AS has_submit_event FROM ft0 JOIN ent USING (aid)),
sg AS (
  SELECT *, CASE WHEN time_per_question_mean_s = 0 THEN 100.0 ELSE time_per_question_mean_s END AS avg_time,
    CASE WHEN time_per_question_mean_s > 0 AND time_per_question_mean_s < 8 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS s1,
    least(1.0, tab_hidden_count / 3) AS s2, least(1.0, paste_count / 2) AS s3 FROM ft),
cb0 AS (
  SELECT *, (0.21 * s1 + 0.16 * s2 + 0.21 * s3 + 0.12 * 0.1 + 0.20 * 0.1 + 0.10 * 0.1) AS mean,
    CAST(s1 >= 0.6 AS INT) + CAST(s2 >= 0.6 AS INT) + CAST(s3 >= 0.6 AS INT) AS elevated_count,
    CAST(s1 >= 0.85 AS INT) + CAST(s2 >= 0.85 AS INT) + CAST(s3 >= 0.85 AS INT) AS strong_count,
    CAST(s1 >= 0.2 AS INT) + CAST(s2 >= 0.2 AS INT) + CAST(s3 >= 0.2 AS INT) AS support_count,
    list_reverse_sort([s1, s2, s3, 0.1, 0.1, 0.1]) AS top FROM sg),
cb1 AS (SELECT *, CASE WHEN support_count >= 2 THEN 0.2 * (top[1] + top[2]) / 2 ELSE 0.0 END AS bonus FROM cb0),
cb2 AS (SELECT *, least(1.0, mean + bonus) AS base0 FROM cb1),
cb3 AS (
  SELECT *, CASE WHEN elevated_count = 0 THEN least(base0, 0.45) WHEN elevated_count < 2 THEN least(base0, 0.66) ELSE base0 END AS capped FROM cb2),
cb AS (SELECT *, CASE WHEN strong_count >= 3 THEN least(1.0, capped + 0.05) ELSE capped END AS score0 FROM cb3),
pg AS (
  SELECT *,
    paste_count >= 2 AND idle_spike_count >= 1 AND tab_hidden_count >= 1 AND suspicious_sequence_count > 0 AS has_a,
    s2 >= 0.7 AND s1 >= 0.7 AS has_b,
    paste_count = 0 AND questions_seen >= {min_questions} AND tab_hidden_count BETWEEN 3 AND 6 AND ratio >= 0.04
      AND time_per_question_mean_s > 0 AND time_per_question_mean_s <= 80 AS has_c,
    paste_count = 0 AND idle_spike_count >= 1 AND questions_seen >= {min_questions} AND (tab_hidden_count >= 3 OR ratio >= 0.01) AS gate_d
  FROM cb),
ps AS (
  SELECT *, least(1.0, 0.30 + 0.25 * s3 + 0.20 * s1 + 0.15 * s2 + 0.10 * 0.1) AS str_a,
    least(1.0, 0.40 + 0.35 * s2 + 0.25 * s1) AS str_b,
    least(0.85, 0.40 + 0.20 * (1 - least(1.0, abs(tab_hidden_count - 4.5) / 4.5)) + 0.25 * least(1.0, (80 - time_per_question_mean_s) / 80)
      + 0.15 * least(1.0, ratio / 0.04)) AS str_c,
    least(0.85, 0.55 + 0.15 * least(1.0, idle_spike_count / 2) + 0.15 * greatest(0.0, 1 - quick_1 / 1000000 / 10) + 0.05 * s1) AS str_d1,
    least(0.85, 0.55 + 0.15 * least(1.0, idle_spike_count / 2) + 0.15 * greatest(0.0, 1 - quick_2 / 1000000 / 10) + 0.05 * s1) AS str_d2,
    CASE WHEN gate_d THEN quick_n ELSE 0 END AS n_d FROM pg),
pt AS (
  SELECT *, CAST(has_a AS BIGINT) + CAST(has_b AS BIGINT) + CAST(has_c AS BIGINT) + n_d AS pattern_count,
    list_sort(list_filter([
      CASE WHEN has_a THEN {{'s': -str_a, 'p': 1, 'n': 'idle_tab_paste_fast'}} END,
      CASE WHEN has_b THEN {{'s': -str_b, 'p': 2, 'n': 'high_tab_low_time'}} END,
      CASE WHEN has_c THEN {{'s': -str_c, 'p': 3, 'n': 'medium_tab_low_time_no_paste'}} END,
      CASE WHEN n_d >= 1 THEN {{'s': -str_d1, 'p': 4, 'n': 'medium_idle_fast_no_paste'}} END,
      CASE WHEN n_d >= 2 THEN {{'s': -str_d2, 'p': 5, 'n': 'medium_idle_fast_no_paste'}} END], lambda x: x IS NOT NULL)) AS found FROM ps),
rk AS (
  SELECT *, coalesce(-found[1].s, 0.0) AS pattern_strength,
    CASE WHEN score0 >= 0.8 AND (elevated_count >= 2 OR strong_count >= 1 OR support_count >= 4) THEN 'HIGH'
         WHEN score0 >= 0.45 AND (support_count >= 1 OR elevated_count >= 1) THEN 'MEDIUM' ELSE 'LOW' END AS rule0,
    questions_seen = 0 AND s1 <= 0.2 AND s2 <= 0.2 AND s3 <= 0.2 AND pattern_count = 0 AS low_data FROM pt),
pr AS (
  SELECT rk.*, {ml_risk} AS ml_risk, {ml_conf} AS ml_confidence,
    rule0 = 'LOW' AND pattern_strength >= 0.6 AS by_pattern FROM rk {ml_from}),
rr AS (SELECT *, CASE WHEN by_pattern THEN 'MEDIUM' ELSE rule0 END AS rule_risk FROM pr),
fd AS (
  SELECT *,
    CASE WHEN rule_risk = 'LOW' AND ml_risk = 'MEDIUM' AND ml_confidence >= 0.6 THEN 'MEDIUM'
         WHEN rule_risk = 'MEDIUM' AND ml_risk = 'HIGH' AND ml_confidence >= 0.85 AND (elevated_count >= 1 OR strong_count >= 1 OR pattern_count > 0) THEN 'HIGH'
         ELSE rule_risk END AS risk0,
    greatest(0.0, least(1.0, 0.75 * (0.6 * (0.55 * least(1.0, questions_seen / 20) + 0.45 * least(1.0, attempt_duration_s / 1200))
      + 0.4 * least(1.0, 0.3 * elevated_count + 0.2 * strong_count))
      + 0.25 * least(1.0, least(abs(score0 - 0.45), abs(score0 - 0.8)) / 0.3)
      - 0.08 * client_seq_gaps - CASE WHEN has_submit_event THEN 0 ELSE 0.35 END)) AS conf0,
    least(1.0, 0.35 * least(1.0, (0.2 * support_count + 0.35 * elevated_count + 0.45 * strong_count) / 2)
      + 0.45 * (top[1] + top[2] + top[3]) / 3 + 0.2 * pattern_strength) AS evid
  FROM rr),
ex AS (
  SELECT *, CASE WHEN ml_confidence > 0 THEN least(1.0, 0.7 * evid + 0.3 * ml_confidence) ELSE evid END AS cs0,
    list_concat(['Risk=' || risk0 || '.',
      CASE risk0 WHEN 'HIGH' THEN 'Strong indicators of cheating behavior detected.'
                 WHEN 'MEDIUM' THEN 'Suspicious behavior detected; requires review.'
                 ELSE 'No significant suspicious behavior detected.' END,
      'Attempt had ' || questions_seen || ' questions over ~' || printf('%.1f', attempt_duration_s / 60) || ' minutes.'],
      list_transform(found[1:2], lambda p: 'Detected pattern: ' || p.n || ' (strength=' || printf('%.2f', -p.s) || ').'),
      CASE WHEN ml_confidence <> 0 THEN ['ML prediction=' || ml_risk || '.', 'ML confidence=' || printf('%.2f', ml_confidence) || '.']
           ELSE ['ML prediction=' || ml_risk || '.'] END) AS summary0,
    list_concat(CASE WHEN questions_seen <= 2 THEN ['Limited data available; confidence may be lower.'] ELSE [] END,
      list_transform(list_sort(list_filter([
        CASE WHEN s1 >= 0.5 THEN {{'s': -s1, 'p': 1, 'n': CASE WHEN {'fast_ratio' if extended else '0'} > 0
            THEN 'Unusually fast responses detected (' || printf('%.0f', 100 * fast_ratio) || '%).'
            ELSE 'Answer timing pattern appears inconsistent with normal behavior.' END}} END,
        CASE WHEN s2 >= 0.5 THEN {{'s': -s2, 'p': 2, 'n': 'User spent ' || printf('%.0f', 100 * ratio) || '% of time outside the test window.'}} END,
        CASE WHEN s3 >= 0.5 THEN {{'s': -s3, 'p': 3, 'n': CAST(paste_count AS VARCHAR) || ' paste actions detected.'}} END],
        lambda x: x IS NOT NULL)), lambda x: x.n)) AS reasons0
  FROM fd),
result AS (
  SELECT *, CASE WHEN low_data THEN 'LOW' ELSE risk0 END AS risk,
    CASE WHEN low_data THEN 0.1 ELSE conf0 END AS confidence,
    CASE WHEN low_data THEN 0.1 ELSE cs0 END AS confidence_score,
    CASE WHEN low_data THEN false ELSE by_pattern OR risk0 <> rule_risk END AS promoted_by_pattern,
    CASE WHEN low_data THEN 0.0 ELSE base0 END AS base_score,
    CASE WHEN low_data THEN 0.0 ELSE score0 END AS combined_score,
    CASE WHEN low_data THEN ['Risk=LOW.', 'Insufficient behavioral data for reliable analysis.'] ELSE summary0 END AS summary,
    CASE WHEN low_data THEN ['Too few interactions detected and no suspicious signals.']
         ELSE list_concat(CASE WHEN len(reasons0) = 0 THEN ['No strong suspicious patterns detected.'] ELSE reasons0 END,
           ['Hybrid decision used rule risk=' || rule_risk || ' and ML risk=' || ml_risk || '.']) END AS reasons
  FROM ex),
res AS (
  SELECT *, CASE WHEN low_data THEN 'Insufficient behavioral data for reliable analysis.'
    ELSE array_to_string(summary, ' ') || ' ' || array_to_string(reasons, ' ') END AS explanation_text FROM result)"""


BASE = "SELECT attempt_id AS aid, * FROM ev"
PREDICTIONS = """SELECT attempt_id AS aid, CASE WHEN max(k) % 3 = 1 THEN 'MEDIUM' ELSE 'HIGH' END AS ml_risk,
  (count(*) * 7 % 50 + 50) / 100 AS ml_confidence FROM ev GROUP BY attempt_id HAVING max(k) % 3 <> 0"""


def sql(select: str, *, raw: bool = False, source: str | None = BASE, extra: str = "", **options) -> str:
    """A query over the events view, the raw view or the scoring chain."""
    parts = EVENTS + (RAW if raw else "")
    if source is not None:
        parts += "," + chain(source, **options)
    return f"WITH {parts}{extra} {select}"


def plain(select: str, raw: bool = False, extra: str = "") -> str:
    return sql(select, raw=raw, source=None, extra=extra)


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n.split('.')[-1]}" for n in names)


LAST = """, attrs AS (
  SELECT attempt_id AS aid, max(received_us) AS timestamp_us, arg_max(event_type, arrival) AS latest_event_type,
    arg_max(question_id, arrival) AS latest_question_id, arg_max(t, arrival) AS latest_event_us,
    count(*) FILTER (event_type = 'exam_submitted') > 0 AS any_submit, any_value(candidate_name) AS candidate_name,
    any_value(candidate_email) AS candidate_email, any_value(assessment_name) AS assessment_name,
    any_value(expected_label) AS expected_label, any_value(is_edge_case) AS is_edge_case, any_value(profile) AS profile
  FROM ev GROUP BY attempt_id),
att AS (
  SELECT res.*, attrs.* EXCLUDE (aid), CASE WHEN has_submit_event OR latest_event_type = 'exam_submitted' THEN 'COMPLETED' ELSE 'ONGOING' END AS status
  FROM res JOIN attrs USING (aid))"""

ISSUE = """CASE WHEN paste_count > 0 AND tab_hidden_count > 0 AND time_per_question_mean_s > 0 AND time_per_question_mean_s <= 20
    THEN 'Clipboard + tab switch + fast answering pattern'
  WHEN paste_count > 0 AND tab_hidden_count > 0 THEN 'Clipboard and tab switching detected'
  WHEN paste_count > 0 THEN 'Clipboard activity detected' WHEN tab_hidden_count > 0 THEN 'Tab switching detected'
  WHEN idle_spike_count > 0 THEN 'Idle activity gap detected'
  WHEN time_per_question_mean_s > 0 AND time_per_question_mean_s <= 12 THEN 'Fast answering pattern'
  ELSE 'No major violation detected' END"""


def label_of(event_type: str, question: str) -> str:
    return f"""CASE {event_type} WHEN 'exam_started' THEN 'Exam started' WHEN 'exam_submitted' THEN 'Exam submitted'
      WHEN 'clipboard' THEN 'Clipboard paste detected' WHEN 'visibility_change' THEN 'Tab/window switch detected'
      WHEN 'idle_state' THEN 'Idle activity gap detected' WHEN 'question_view' THEN 'Question ' || {question} || ' viewed'
      WHEN 'question_answer' THEN 'Answer submitted for ' || {question} ELSE replace({event_type}, '_', ' ') END"""


def duration_of(s: str) -> str:
    w = f"CAST(floor({s}) AS BIGINT)"
    two = lambda x: f"lpad(CAST({x} AS VARCHAR), 2, '0')"
    return f"""CASE WHEN {s} IS NULL OR {s} <= 0 THEN '—'
      WHEN {w} >= 3600 THEN CAST({w} // 3600 AS VARCHAR) || ':' || {two(f'({w} % 3600) // 60')} || ':' || {two(f'{w} % 60')}
      ELSE CAST(({w} % 3600) // 60 AS VARCHAR) || ':' || {two(f'{w} % 60')} END"""


def reason_of(risk: str, text: str) -> str:
    return f"""CASE WHEN length(trim({text})) > 0 THEN substr({text}, 1, 500)
      WHEN {risk} = 'HIGH' THEN 'Risk escalated to HIGH based on strong behavioral evidence.'
      WHEN {risk} = 'MEDIUM' THEN 'Risk escalated to MEDIUM based on suspicious behavioral signals.'
      ELSE 'Risk remains LOW. No major suspicious behavior detected.' END"""


# every event with all events of its attempt that arrived before it or with it
PREFIX = """SELECT n.attempt_id || '#' || CAST(n.arrival AS VARCHAR) AS aid, p.* EXCLUDE (seq), 0 AS seq, n.arrival AS n_arrival, n.session_id AS n_session
  FROM seen n JOIN seen p ON n.attempt_id = p.attempt_id AND n.session_id = p.session_id AND p.arrival <= n.arrival"""
NO_TTL = ", seen AS (SELECT *, 0 AS session_id FROM ev)"
TTL = """, seen AS (SELECT * EXCLUDE (gap), CAST(sum(CASE WHEN gap > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY attempt_id ORDER BY received_us, arrival) AS BIGINT) AS session_id
  FROM (SELECT *, received_us - lag(received_us) OVER (PARTITION BY attempt_id ORDER BY received_us, arrival) AS gap FROM ev))"""
LATE = """, seen AS (SELECT * EXCLUDE (arrival), CASE WHEN k % 7 = 0 THEN arrival + 600 ELSE arrival END * 100 + k AS arrival, 0 AS session_id FROM ev)"""
STREAMED = """, seen AS (SELECT ev.*, 0 AS session_id FROM ev JOIN raw USING (arrival)
  WHERE raw.event_type IS NOT NULL AND TRY_CAST(raw.occurred_at AS TIMESTAMPTZ) IS NOT NULL)"""
# every arrival at its place: the batch, then the event time, unreadable times last
PLACED = """, placed AS (
  SELECT attempt_id, arrival, CASE WHEN received_at < '2024-01-16' THEN 0 ELSE 1 END AS half,
    CASE WHEN TRY_CAST(occurred_at AS TIMESTAMPTZ) IS NULL THEN 9000000000000000000 ELSE t END AS at,
    event_type IS NOT NULL AND TRY_CAST(occurred_at AS TIMESTAMPTZ) IS NOT NULL AS usable FROM raw)"""
STAND_IN = """SELECT aid, CASE (paste_count * 3 + tab_hidden_count) % 3 WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'LOW' END AS ml_risk,
  ((paste_count * 7 + tab_hidden_count * 11) % 50 + 50) / 100 AS ml_confidence FROM ft"""
PROGRESS = """split_part(aid, '#', 1) AS attempt_id, CAST(split_part(aid, '#', 2) AS BIGINT) AS arrival, event_count, paste_count,
  tab_hidden_count, idle_spike_count, questions_seen, round(time_per_question_mean_s, 6) AS time_per_question_mean_s,
  round(attempt_duration_s, 6) AS attempt_duration_s, risk, round(confidence, 6) AS confidence,
  round(confidence_score, 6) AS confidence_score, round(combined_score, 6) AS combined_score, pattern_count,
  round(pattern_strength, 6) AS pattern_strength, """ + reason_of("risk", "explanation_text") + " AS reason"


def prefixes(select: str, seen: str = NO_TTL, extra: str = "") -> str:
    return f"WITH {EVENTS}{seen},{chain(PREFIX)}{extra} {select}"


HIST = """, hist AS (
  SELECT split_part(res.aid, '#', 1) AS attempt_id, CAST(split_part(res.aid, '#', 2) AS BIGINT) AS arrival, risk,
    combined_score, confidence_score, confidence, event_count, """ + reason_of("risk", "explanation_text") + """ AS reason,
    e.received_us AS timestamp_us, e.event_type, e.candidate_id, e.candidate_name, e.candidate_email, e.assessment_name
  FROM res JOIN ev e ON e.attempt_id = split_part(res.aid, '#', 1) AND e.arrival = CAST(split_part(res.aid, '#', 2) AS BIGINT))"""

SERVE = [
    "paste_count", "tab_hidden_count", "idle_spike_count", "time_per_question", "questions_seen", "attempt_duration",
    "paste_per_question", "tab_per_question", "speed", "tab_density", "paste_density", "idle_ratio",
    "suspicious_combo", "fast_paste", "fast_tab",
]
SEQUENCES = [
    "suspicious_sequence_count", "answer_burst_count", "tab_return_fast_answer_count", "paste_to_answer_seconds_min",
    "paste_to_answer_fast_count", "navigation_revisit_count", "question_jump_count", "timing_variance_score",
    "behavior_entropy_score", "idle_to_activity_burst_count",
]
REFINE = [c.replace("time_per_question", "time_per_question_mean_s") if c == "time_per_question" else
          "attempt_duration_s" if c == "attempt_duration" else c for c in SERVE] + SEQUENCES


def matrix(time: str, questions: str, duration: str, names=("time_per_question", "attempt_duration")) -> str:
    p, h, i = (f"CAST({c} AS DOUBLE)" for c in ("paste_count", "tab_hidden_count", "idle_spike_count"))
    t, q, d = f"CAST({time} AS DOUBLE)", f"CAST({questions} AS DOUBLE)", f"CAST({duration} AS DOUBLE)"
    s = f"(1 / ({t} + 0.00001))"
    return f"""{p} AS paste_count, {h} AS tab_hidden_count, {i} AS idle_spike_count, round({t}, 6) AS {names[0]},
      {q} AS questions_seen, round({d}, 6) AS {names[1]}, round({p} / {q}, 6) AS paste_per_question,
      round({h} / {q}, 6) AS tab_per_question, round({s}, 6) AS speed, round({h} / ({d} + 0.00001), 6) AS tab_density,
      round({p} / ({d} + 0.00001), 6) AS paste_density, round({i} / {q}, 6) AS idle_ratio,
      round({p} / {q} * ({h} / {q}), 6) AS suspicious_combo, round({s} * ({p} / {q}), 6) AS fast_paste,
      round({s} * ({h} / {q}), 6) AS fast_tab"""


SERVE_MATRIX = matrix(
    "CASE WHEN time_per_question_mean_s = 0 THEN 1 ELSE time_per_question_mean_s END",
    "CASE WHEN questions_seen = 0 THEN 1 ELSE questions_seen END",
    "CASE WHEN attempt_duration_s = 0 THEN 1 ELSE attempt_duration_s END",
)
TRAIN_MATRIX = matrix(
    "CASE WHEN time_per_question_mean_s = 0 THEN 1 ELSE time_per_question_mean_s END",
    "greatest(questions_seen, 1)",
    "attempt_duration_s",
)
REFINE_MATRIX = matrix(
    "greatest(time_per_question_mean_s, 0.001)",
    "greatest(questions_seen, 1)",
    "greatest(attempt_duration_s, 1.0)",
    ("time_per_question_mean_s", "attempt_duration_s"),
) + ", " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in SEQUENCES)
NO_SEQUENCES = REFINE_MATRIX.split(", round(CAST(suspicious_sequence_count")[0] + ", " + ", ".join(
    f"{999.0 if c == 'paste_to_answer_seconds_min' else 0.0}::DOUBLE AS {c}" for c in SEQUENCES)
RANK = "CASE {r} WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 END"

RESULT = f"""aid AS attempt_id, risk, {r('confidence', 'confidence_score')}, promoted_by_pattern, {r('base_score', 'combined_score')},
  pattern_count, {r('pattern_strength')}, explanation_text"""

PAIRS = ", pairs AS (SELECT aid AS attempt_id, expected_label, risk AS predicted_label, att.* EXCLUDE (aid, expected_label) FROM att)"
CELLS = "count(*) FILTER (predicted_label = 'LOW') AS \"LOW\", count(*) FILTER (predicted_label = 'MEDIUM') AS \"MEDIUM\", count(*) FILTER (predicted_label = 'HIGH') AS \"HIGH\""
LABELS3 = "(VALUES ('LOW'), ('MEDIUM'), ('HIGH'))"


def ratio(part: str, whole: str) -> str:
    return f"round(CASE WHEN {whole} = 0 THEN 0.0 ELSE {part} / {whole} END, 6)"


def n(cond: str) -> str:
    return f"count(*) FILTER ({cond})"


REPORT = """, per AS (
  SELECT l AS label, count(*) FILTER (e = l AND p = l) AS hit, count(*) FILTER (p = l) AS pred, count(*) FILTER (e = l) AS support
  FROM (SELECT expected_label AS e, predicted_label AS p FROM pairs), (VALUES ('LOW'), ('MEDIUM'), ('HIGH')) v(l) GROUP BY l),
prf AS (
  SELECT label, CASE WHEN pred = 0 THEN 0.0 ELSE hit / pred END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE hit / support END AS recall,
    support, hit, pred FROM per),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1_score FROM prf)"""


EV_NULLS = "CAST(NULL AS BIGINT) AS idle_end_us, CAST(NULL AS BIGINT) AS tab_hidden_us, CAST(NULL AS BIGINT) AS paste_us, CAST(NULL AS BIGINT) AS question_leave_us, CAST(NULL AS VARCHAR) AS question_id, CAST(NULL AS DOUBLE) AS question_time_s"
PAT_A = """SELECT aid AS attempt_id, 'idle_tab_paste_fast' AS pattern_type, round(str_a, 6) AS strength, c.last_active AS idle_end_us,
    c.last_hidden AS tab_hidden_us, c.t AS paste_us, c.next_leave AS question_leave_us, CAST(NULL AS VARCHAR) AS question_id,
    CAST(NULL AS DOUBLE) AS question_time_s
  FROM ps JOIN (SELECT * FROM cand WHERE is_seq QUALIFY row_number() OVER (PARTITION BY aid ORDER BY t, seq, arrival) = 1) c USING (aid) WHERE has_a"""
PAT_B = f"SELECT aid AS attempt_id, 'high_tab_low_time' AS pattern_type, round(str_b, 6) AS strength, {EV_NULLS} FROM ps WHERE has_b"
PAT_C = f"SELECT aid AS attempt_id, 'medium_tab_low_time_no_paste' AS pattern_type, round(str_c, 6) AS strength, {EV_NULLS} FROM ps WHERE has_c"
PAT_D = """SELECT aid AS attempt_id, 'medium_idle_fast_no_paste' AS pattern_type,
    round(least(0.85, 0.55 + 0.15 * least(1.0, idle_spike_count / 2) + 0.15 * greatest(0.0, 1 - (c.t - c.last_enter) / 1000000 / 10) + 0.05 * s1), 6) AS strength,
    c.last_active AS idle_end_us, CAST(NULL AS BIGINT) AS tab_hidden_us, CAST(NULL AS BIGINT) AS paste_us, c.t AS question_leave_us,
    c.question_id, round((c.t - c.last_enter) / 1000000, 6) AS question_time_s
  FROM ps JOIN cand c USING (aid) WHERE gate_d AND c.is_quick"""

SCORE = "round(combined_score, 6) AS combined_score"
REASON3 = "CASE WHEN questions_seen % 3 = 0 THEN '  ' ELSE repeat(explanation_text, 3) END"


def _evidence() -> str:
    texts = {
        "Clipboard Activity": "Clipboard usage during an assessment may indicate copied or externally generated answers.",
        "Tab Switching": "The candidate left the assessment window. Repeated switching is suspicious when paired with other signals.",
        "Fast Answer Timing": "Very fast submissions can indicate external assistance, especially after tab or clipboard events.",
        "Idle + Burst Pattern": "Long inactivity followed by sudden answer activity can indicate external lookup behavior.",
        "Multi-Signal Pattern": "Combined behavioral evidence is stronger than any single violation alone.",
        "High Risk Score": "The total risk score crossed the high-risk review threshold.",
        "Moderate Risk Score": "The attempt contains enough behavioral evidence to justify manual review.",
        "Normal Behavior Pattern": "The available behavioral signals do not indicate strong assessment integrity risk.",
    }
    plural = lambda c, what: f"CAST({c} AS VARCHAR) || ' {what}' || CASE WHEN {c} = 1 THEN '' ELSE 's' END || ' detected'"
    rows = [
        (1, "paste_count > 0", "Clipboard Activity", "CASE WHEN paste_count >= 4 THEN 'HIGH' WHEN paste_count >= 2 THEN 'MEDIUM' ELSE 'LOW' END", plural("paste_count", "paste event")),
        (2, "tab_hidden_count > 0", "Tab Switching", "CASE WHEN tab_hidden_count >= 5 THEN 'HIGH' WHEN tab_hidden_count >= 2 THEN 'MEDIUM' ELSE 'LOW' END", plural("tab_hidden_count", "tab switch event")),
        (3, "time_per_question_mean_s > 0 AND time_per_question_mean_s <= 15", "Fast Answer Timing", "CASE WHEN time_per_question_mean_s <= 8 THEN 'HIGH' ELSE 'MEDIUM' END", "'Average answer time: ' || printf('%.1f', time_per_question_mean_s) || ' seconds'"),
        (4, "idle_spike_count > 0", "Idle + Burst Pattern", "CASE WHEN idle_spike_count >= 3 THEN 'HIGH' ELSE 'MEDIUM' END", plural("idle_spike_count", "idle spike")),
        (5, "paste_count > 0 AND tab_hidden_count > 0", "Multi-Signal Pattern", "'HIGH'", "'Multiple suspicious signals occurred in one attempt'"),
        (6, "combined_score >= 0.6", "High Risk Score", "'HIGH'", "'Combined score: ' || printf('%.2f', combined_score)"),
        (6, "combined_score >= 0.25 AND combined_score < 0.6", "Moderate Risk Score", "'MEDIUM'", "'Combined score: ' || printf('%.2f', combined_score)"),
    ]
    out = [
        f"SELECT aid AS attempt_id, {pos} AS pos, '{title}' AS title, {sev} AS severity, {finding} AS finding, '{texts[title]}' AS explanation FROM res WHERE {cond}"
        for pos, cond, title, sev, finding in rows
    ]
    none = " AND ".join(f"NOT ({cond})" for _, cond, *_ in rows)
    out.append(
        f"SELECT aid, 1, 'Normal Behavior Pattern', 'LOW', 'No major suspicious behavior detected', '{texts['Normal Behavior Pattern']}' FROM res WHERE {none}"
    )
    return " UNION ALL ".join(out)


def _refine() -> str:
    adv = "(suspicious_sequence_count > 0 OR paste_to_answer_fast_count > 0 OR tab_return_fast_answer_count > 0 OR answer_burst_count > 0 OR idle_to_activity_burst_count > 0)"
    extra = f""", j AS (
      SELECT *, {adv} AS adv, CASE WHEN event_count % 11 <> 0 THEN (event_count * 37 % 100) / 100 + 0.001 END AS p FROM res),
    st AS (
      SELECT *, CASE WHEN risk = 'HIGH' THEN 'high'
        WHEN risk = 'LOW' AND combined_score < 0.2 AND NOT adv THEN 'far'
        WHEN risk = 'MEDIUM' AND combined_score > 0.7 THEN 'sure'
        WHEN p IS NULL THEN 'none'
        WHEN risk = 'LOW' THEN CASE WHEN p >= (CASE WHEN adv THEN 0.62 ELSE 0.65 END)
            AND (paste_count > 0 OR tab_hidden_count > 0 OR (time_per_question_mean_s > 0 AND time_per_question_mean_s < 12) OR adv)
            AND combined_score >= (CASE WHEN adv THEN 0.15 ELSE 0.25 END) THEN 'promote' ELSE 'keep_low' END
        WHEN p <= 0.35 AND combined_score <= 0.55 THEN 'demote' ELSE 'keep_medium' END AS step FROM j)"""
    return sql(
        """SELECT aid AS attempt_id, CASE step WHEN 'promote' THEN 'MEDIUM' WHEN 'demote' THEN 'LOW' ELSE risk END AS refined_risk,
          CASE step WHEN 'high' THEN 'Rule risk is HIGH; ML refinement skipped.'
            WHEN 'far' THEN 'Combined score far below MEDIUM; ML refinement skipped.'
            WHEN 'sure' THEN 'Combined score strongly MEDIUM; ML refinement skipped.'
            WHEN 'none' THEN 'ML refinement unavailable: no model.'
            WHEN 'promote' THEN 'ML refinement promoted LOW→MEDIUM (p_medium=' || printf('%.2f', p) || ') for borderline suspicious behavior.'
            WHEN 'keep_low' THEN 'ML refinement kept LOW (p_medium=' || printf('%.2f', p) || ').'
            WHEN 'demote' THEN 'ML refinement demoted MEDIUM→LOW (p_medium=' || printf('%.2f', p) || ') due to weak suspicious evidence.'
            ELSE 'ML refinement kept MEDIUM (p_medium=' || printf('%.2f', p) || ').' END AS note,
          CASE WHEN step IN ('promote', 'keep_low', 'demote', 'keep_medium') THEN round(p, 6) END AS used_p_medium FROM st""",
        extra=extra,
    )


FEATURES8 = f"""aid AS attempt_id, paste_count, tab_hidden_count, idle_spike_count, {r('time_per_question_mean_s')}, questions_seen,
  {r('attempt_duration_s')}, CAST(client_seq_gaps AS BIGINT) AS client_seq_gaps, has_submit_event"""

ORACLE: dict[str, str] = {
    # sources
    "scan_attempt_batches": plain(
        """SELECT attempt_id, event_attempt_id, event_type, occurred_at, question_id, client_seq,
             row_number() OVER (PARTITION BY attempt_id ORDER BY arrival) - 1 AS arrival FROM raw""", raw=True),
    "scan_raw_events": plain("SELECT attempt_id, event_type, occurred_at, state, arrival FROM raw", raw=True),
    "stream_events": plain(
        "SELECT attempt_id, event_type, occurred_at, true AS stamped FROM raw", raw=True),
    "scan_score_log": sql(
        f"""SELECT aid AS attempt_id, risk, paste_count, questions_seen, round(s2, 6) AS tab_score FROM res
            JOIN (SELECT attempt_id AS aid, arg_max(k, arrival) AS last_k FROM ev GROUP BY ALL) USING (aid) WHERE last_k NOT IN (5, 7)"""),
    "coerce_log_types": sql(
        f"""SELECT aid AS attempt_id, last_k % 9 <> 0 AS has_time, round(CASE WHEN last_k % 9 = 1 THEN 0.0 ELSE confidence END, 6) AS confidence,
              {r('confidence_score', 'combined_score')} FROM res
            JOIN (SELECT attempt_id AS aid, arg_max(k, arrival) AS last_k FROM ev GROUP BY ALL) USING (aid) WHERE last_k NOT IN (5, 7)"""),
    "scan_labelled_attempts": plain(
        """SELECT attempt_id, any_value(expected_label) AS expected_label,
             any_value(candidate_id) AS candidate_id, any_value(profile) AS profile, any_value(is_edge_case) AS is_edge_case,
             CAST(count(*) AS INTEGER) AS n_events, arg_min(event_type, arrival) AS first_event_type FROM ev GROUP BY attempt_id"""),
    "scan_training_csv": sql(
        f"""SELECT * REPLACE (CASE WHEN paste_count = 3 THEN 0.0 ELSE paste_count END AS paste_count)
            FROM (SELECT CAST({RANK.format(r='risk')} AS VARCHAR) AS risk, {TRAIN_MATRIX} FROM res)"""),
    # sinks
    "append_raw_events": plain(
        """SELECT id, attempt_id, event_type, occurred_at, substr(received_at, 1, 10) AS event_date FROM raw""", raw=True),
    "append_score_log": sql(f"SELECT {FEATURES8}, risk, s1 AS timing_score FROM res"),
    "append_risk_history": prefixes(
        f"SELECT attempt_id, arrival, risk, round(confidence_score, 6) AS confidence, {SCORE}, reason FROM hist", extra=HIST),
    "upsert_current_risk": prefixes(
        f"SELECT attempt_id, arrival, risk, {SCORE} FROM hist QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY timestamp_us DESC) = 1", extra=HIST),
    "live_update_feed": prefixes(
        "SELECT attempt_id AS key, 'progressive_ingest' AS mode, risk, event_type, event_count, timestamp_us AS received_us FROM hist", extra=HIST),
    "write_training_csv": sql(
        f"SELECT expected_label AS label, {NO_SEQUENCES} FROM att WHERE expected_label <> 'HIGH'", extra=LAST),
    "write_eval_report": sql(
        f"""SELECT expected_label, {CELLS}, count(*) AS total FROM pairs GROUP BY 1 UNION ALL SELECT 'TOTAL', {CELLS}, count(*) FROM pairs""",
        extra=LAST + PAIRS),
    # normalisation and filters
    "normalize_events": plain(
        """SELECT attempt_id, arrival, event_type, action, state, question_id, coalesce(CAST(client_seq AS BIGINT), 0) AS client_seq, t AS t_us
           FROM raw WHERE event_type IS NOT NULL AND TRY_CAST(occurred_at AS TIMESTAMPTZ) IS NOT NULL AND attempt_id NOT IN
             (SELECT attempt_id FROM raw WHERE event_attempt_id <> attempt_id)""", raw=True),
    "rejected_events": plain(
        """SELECT * FROM (SELECT attempt_id, count(*) AS events, CASE WHEN count(*) FILTER (event_attempt_id <> attempt_id) > 0 THEN 'attempt_id mismatch in events'
             WHEN count(*) FILTER (event_type IS NOT NULL AND TRY_CAST(occurred_at AS TIMESTAMPTZ) IS NOT NULL) = 0 THEN 'No valid events provided' END AS reason
           FROM raw GROUP BY attempt_id) WHERE reason IS NOT NULL""", raw=True),
    "ordered_events": plain(
        "SELECT attempt_id, arrival, row_number() OVER (PARTITION BY attempt_id ORDER BY t, seq, arrival) AS event_rn FROM ev"),
    "event_flags": sql(
        """SELECT attempt_id, arrival, is_paste, is_hidden AS is_tab_hidden, is_visible AS is_tab_visible, is_idle AS is_idle_start,
             is_active AS is_idle_end, is_enter AS is_question_enter, is_leave AS is_question_leave FROM fl"""),
    "events_for_attempt": plain(
        "SELECT id, attempt_id, candidate_name, event_type, occurred_at FROM raw WHERE attempt_id = '5-0' ORDER BY occurred_at, id", raw=True),
    "risk_history_for_attempt": prefixes(
        f"SELECT attempt_id, risk, {SCORE}, reason, timestamp_us FROM hist WHERE attempt_id = '5-0'", extra=HIST),
    "live_risk": prefixes(
        f"""SELECT attempt_id, risk, {SCORE}, event_count, timestamp_us AS updated_us FROM (SELECT * FROM hist WHERE timestamp_us <= {EPOCH + 3 * WEEK}
            QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY timestamp_us DESC) = 1) WHERE {EPOCH + 3 * WEEK} - timestamp_us <= 21600000000""", extra=HIST),
    "score_summary": sql(
        f"SELECT aid AS attempt_id, risk, round(confidence_score, 6) AS confidence, {SCORE}, explanation_text AS explanation FROM res"),
    "filter_attempt_log": sql(
        f"SELECT aid AS attempt_id, risk, {SCORE}, timestamp_us FROM att WHERE risk IN ('HIGH', 'MEDIUM') AND aid LIKE '%1-%'", extra=LAST),
    "search_attempts": sql(
        """SELECT aid AS attempt_id, risk, candidate_name FROM att WHERE risk IN ('LOW', 'HIGH')
           AND lower(aid || ' ' || coalesce(candidate_name, '') || ' ' || coalesce(candidate_email, '')) LIKE '%date 1%'""", extra=LAST),
    "violation_events": plain(
        f"""SELECT attempt_id, arrival, event_type, {label_of('event_type', 'question_id')} AS label,
              'violation ' || CASE event_type WHEN 'clipboard' THEN 'paste' WHEN 'visibility_change' THEN 'tab' WHEN 'idle_state' THEN 'idle'
                WHEN 'question_answer' THEN 'answer' ELSE 'exam' END AS tone FROM ev WHERE event_type <> 'question_view'"""),
    "flatten_features": sql(
        """SELECT aid AS attempt_id, risk, paste_count, tab_hidden_count, questions_seen, round(time_per_question_mean_s, 6) AS time_per_question,
             round(attempt_duration_s, 6) AS attempt_duration FROM res"""),
    "explode_signals": sql(
        """SELECT aid AS attempt_id, s.n AS signal, round(s.v, 6) AS score FROM (SELECT aid, unnest([{'n': 'timing', 'v': s1}, {'n': 'tab', 'v': s2},
             {'n': 'clipboard', 'v': s3}, {'n': 'idle', 'v': 0.1}, {'n': 'answer_changes', 'v': 0.1}, {'n': 'typing', 'v': 0.1}]) AS s FROM res)"""),
    "attempt_drilldown": sql(
        f"""SELECT aid AS attempt_id, risk, {r('confidence', 'confidence_score', 'combined_score')}, explanation_text AS explanation,
              {FEATURES8.split(',', 1)[1]} FROM res WHERE aid = '8-0'"""),
    # joins
    "asof_prev_event": sql(
        """SELECT attempt_id, arrival, question_id, match_arrival, gap_s FROM (
             SELECT p.attempt_id, p.arrival, p.question_id, h.arrival AS match_arrival, round((p.t - h.t) / 1000000, 6) AS gap_s,
               row_number() OVER (PARTITION BY p.arrival ORDER BY h.t DESC, h.arrival DESC) AS rn, p.t - h.t AS gap
             FROM fl p JOIN fl h ON p.aid = h.aid AND p.is_paste AND h.is_hidden AND (h.t, h.arrival) < (p.t, p.arrival))
           WHERE rn = 1 AND gap <= 30000000"""),
    "asof_next_event": sql(
        """SELECT attempt_id, arrival, question_id, match_arrival, gap_s FROM (
             SELECT p.attempt_id, p.arrival, p.question_id, h.arrival AS match_arrival, round((h.t - p.t) / 1000000, 6) AS gap_s,
               row_number() OVER (PARTITION BY p.arrival ORDER BY h.t, h.arrival) AS rn, h.t - p.t AS gap
             FROM fl p JOIN fl h ON p.aid = h.aid AND p.is_paste AND h.is_leave AND (h.t, h.arrival) > (p.t, p.arrival))
           WHERE rn = 1 AND gap <= 30000000"""),
    "paste_attribution": sql(
        """SELECT a.attempt_id, a.arrival, a.question_id, CASE WHEN (a.t - p.t) // 1000 BETWEEN 0 AND 2000 THEN 'paste' ELSE 'input' END AS change_type,
             (a.t - p.t) // 1000 AS paste_recent_ms,
             CASE WHEN p.k IS NULL THEN NULL WHEN p.k * 2 <= 0 THEN 'unknown' WHEN p.k * 2 <= 20 THEN 'small' WHEN p.k * 2 <= 120 THEN 'medium' ELSE 'large' END AS paste_size
           FROM fl a LEFT JOIN fl p ON a.aid = p.aid AND a.question_id = p.question_id AND p.is_paste AND (p.t, p.arrival) < (a.t, a.arrival)
           WHERE a.is_answer QUALIFY row_number() OVER (PARTITION BY a.arrival ORDER BY p.t DESC NULLS LAST, p.arrival DESC NULLS LAST) = 1"""),
    "join_ml_predictions": sql("SELECT aid AS attempt_id, ml_risk, round(ml_confidence, 6) AS ml_confidence FROM res", predictions=PREDICTIONS),
    "join_expected_predicted": sql("SELECT attempt_id, expected_label, predicted_label FROM pairs", extra=LAST + PAIRS),
    "prefix_expand": sql(
        """SELECT n.attempt_id, n.arrival, count(*) AS prefix_events, min(p.t) AS prefix_first_us, max(p.t) AS prefix_last_us,
             count(*) FILTER (p.is_paste) AS prefix_pastes, count(*) FILTER (p.is_hidden) AS prefix_hidden
           FROM fl n JOIN fl p ON n.aid = p.aid AND p.arrival <= n.arrival GROUP BY 1, 2"""),
    "touched_attempts": plain(
        f"SELECT attempt_id, arrival FROM ev WHERE attempt_id IN (SELECT attempt_id FROM ev WHERE received_us >= {EPOCH + 4 * WEEK})"),
    "report_identity_fallback": sql(
        """SELECT aid AS attempt_id,
             coalesce(CASE WHEN event_count % 2 = 0 THEN att.candidate_name END, att.candidate_name, 'Unknown Candidate') AS candidate_name,
             coalesce(att.candidate_email, 'No email available') AS candidate_email,
             coalesce(first_assessment, att.assessment_name, 'Assessment') AS assessment_name
           FROM att JOIN (SELECT attempt_id AS aid, arg_min(CASE WHEN k % 2 = 0 THEN assessment_name ELSE '' END, t * 1000000 + arrival) AS fa FROM ev GROUP BY 1)
             USING (aid), LATERAL (SELECT nullif(fa, '') AS first_assessment)""", extra=LAST),
    # features
    "f_paste_count": sql("SELECT aid AS attempt_id, paste_count FROM ft"),
    "f_tab_hidden_count": sql("SELECT aid AS attempt_id, tab_hidden_count FROM ft"),
    "f_idle_spike_count": sql("SELECT aid AS attempt_id, idle_spike_count FROM ft"),
    "f_time_per_question_mean_s": sql(f"SELECT aid AS attempt_id, {r('time_per_question_mean_s')} FROM ft"),
    "f_questions_seen": sql("SELECT aid AS attempt_id, questions_seen FROM ft"),
    "f_attempt_duration_s": sql(f"SELECT aid AS attempt_id, {r('attempt_duration_s')} FROM ft"),
    "f_question_durations": sql(
        "SELECT attempt_id, arrival, question_id, round(question_us / 1000000, 6) AS question_time_s FROM mk WHERE question_us IS NOT NULL"),
    "attempt_features": sql(f"SELECT {FEATURES8} FROM ft"),
    "attempt_features_ext": sql(
        f"""SELECT aid AS attempt_id, client_seq_gaps, has_submit_event, round(ratio, 6) AS tab_hidden_ratio, {r('time_per_question_p10_s', 'fast_ratio')},
              round(coalesce(idle_us_sum / nullif(t_max - t_min, 0), 0.0), 6) AS idle_ratio FROM ft""", extended=True),
    "attempt_event_counts": plain(
        "SELECT attempt_id, count(*) AS event_count, " + ", ".join(
            f"count(*) FILTER (event_type = '{e}') AS n_{e}" for e in
            ("question_view", "question_answer", "clipboard", "visibility_change", "idle_state", "exam_started", "exam_submitted"))
        + " FROM ev GROUP BY attempt_id"),
    **{
        f"f_{c}": sql(f"SELECT aid AS attempt_id, {r(c) if c.endswith(('score', '_min')) else c} FROM ft")
        for c in SEQUENCES
    },
    # scoring
    "detect_signals": sql(
        f"""SELECT aid AS attempt_id, {r('avg_time')}, round(s1, 6) AS timing_score, round(s2, 6) AS tab_score, round(s3, 6) AS clipboard_score,
              0.1::DOUBLE AS idle_score, 0.1::DOUBLE AS answer_changes_score, 0.1::DOUBLE AS typing_score FROM res"""),
    "combine_signals": sql(
        f"""SELECT aid AS attempt_id, round(base0, 6) AS base_score, round(score0, 6) AS combined_score, elevated_count, strong_count,
              support_count, {r('bonus')} FROM cb"""),
    "assign_risk": sql("SELECT aid AS attempt_id, rule0 AS risk FROM rk"),
    "promote_by_pattern": sql("SELECT aid AS attempt_id, rule_risk, by_pattern AS promoted_by_pattern FROM rr"),
    "hybrid_decision": sql("SELECT aid AS attempt_id, rule_risk, ml_risk, risk, promoted_by_pattern FROM res", predictions=PREDICTIONS),
    "low_data_guard": sql(
        """SELECT aid AS attempt_id, 'LOW' AS risk, 0.1::DOUBLE AS confidence, 0.1::DOUBLE AS confidence_score, 0.0::DOUBLE AS base_score,
             0.0::DOUBLE AS combined_score, 'Insufficient behavioral data for reliable analysis.' AS explanation_text FROM rk WHERE low_data"""),
    "rule_confidence": sql(f"SELECT aid AS attempt_id, {r('confidence')} FROM res"),
    "evidence_confidence": sql(f"SELECT aid AS attempt_id, {r('confidence_score')} FROM res"),
    "blend_confidence": sql(f"SELECT aid AS attempt_id, {r('confidence_score')} FROM res", predictions=PREDICTIONS),
    "score_attempts": sql(f"SELECT {RESULT} FROM res"),
    "score_attempts_extended": sql(f"SELECT {RESULT} FROM res", extended=True),
    # evaluation
    "confusion_matrix": sql(f"SELECT expected_label, {CELLS} FROM pairs GROUP BY 1", extra=LAST + PAIRS),
    "confusion_with_totals": sql(
        f"""SELECT expected_label, {CELLS}, count(*) AS total FROM pairs GROUP BY 1 UNION ALL SELECT 'TOTAL', {CELLS}, count(*) FROM pairs""",
        extra=LAST + PAIRS),
    "eval_metrics": sql(
        f"""SELECT count(*) AS n_attempts, {ratio(n('expected_label = predicted_label'), 'count(*)')} AS accuracy,
          {ratio(n("expected_label = 'LOW' AND predicted_label <> 'LOW'"), n("expected_label = 'LOW'"))} AS false_positive_rate,
          {ratio(n("expected_label = 'HIGH' AND predicted_label = 'HIGH'"), n("predicted_label = 'HIGH'"))} AS high_precision,
          {ratio(n("expected_label = 'HIGH' AND predicted_label = 'HIGH'"), n("expected_label = 'HIGH'"))} AS high_recall,
          {ratio(n("expected_label = 'MEDIUM' AND predicted_label = 'MEDIUM'"), n("expected_label = 'MEDIUM'"))} AS medium_recall FROM pairs""",
        extra=LAST + PAIRS),
    "predicted_distribution": sql(
        f"SELECT l AS label, count(aid) AS n FROM {LABELS3} v(l) LEFT JOIN res ON risk = l GROUP BY l"),
    "classification_report": sql(
        """SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support FROM f
           UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
           UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6), CAST(sum(support) AS BIGINT) FROM f
           UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
             round(sum(f1_score * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""", extra=LAST + PAIRS + REPORT),
    "binary_metrics": sql(
        f"""SELECT {ratio(n('a = p'), 'count(*)')} AS accuracy, {ratio(n('a = 1 AND p = 1'), n('p = 1'))} AS precision,
          {ratio(n('a = 1 AND p = 1'), n('a = 1'))} AS recall, {n('a = 0 AND p = 0')} AS true_low_pred_low, {n('a = 0 AND p = 1')} AS true_low_pred_medium,
          {n('a = 1 AND p = 0')} AS true_medium_pred_low, {n('a = 1 AND p = 1')} AS true_medium_pred_medium
          FROM (SELECT CAST(expected_label = 'MEDIUM' AS INT) AS a, CAST(predicted_label <> 'LOW' AS INT) AS p FROM pairs WHERE expected_label <> 'HIGH')""",
        extra=LAST + PAIRS),
    "per_attempt_eval": sql(
        f"""SELECT attempt_id, expected_label, predicted_label, round(confidence_score, 6) AS confidence, {SCORE}, explanation_text AS explanation,
              is_edge_case FROM pairs""", extra=LAST + PAIRS),
    "label_profile_distribution": plain(
        """SELECT 'label' AS kind, expected_label AS value, count(DISTINCT attempt_id) AS n FROM ev GROUP BY 2
           UNION ALL SELECT 'profile', profile, count(DISTINCT attempt_id) FROM ev GROUP BY 2
           UNION ALL SELECT 'edge', 'LOW', count(DISTINCT attempt_id) FROM ev WHERE is_edge_case AND expected_label = 'LOW'"""),
    "class_distribution": sql(f"SELECT {RANK.format(r='risk')} AS risk, count(*) AS n FROM res GROUP BY 1"),
    "dashboard_kpis": sql(
        f"""SELECT count(*) AS total, {n("risk = 'HIGH'")} AS high, {n("risk = 'MEDIUM'")} AS medium, {n("risk = 'LOW'")} AS low,
              round(avg(confidence), 6) AS avg_confidence, round(avg(combined_score), 6) AS avg_score FROM res"""),
    "console_stats": sql(
        f"""SELECT count(*) AS total, {n("risk = 'HIGH'")} AS high, {n("risk = 'MEDIUM'")} AS medium, {n("risk = 'LOW'")} AS low,
              {n("status = 'ONGOING'")} AS ongoing, {n("status = 'COMPLETED'")} AS completed, round(avg(confidence), 6) AS avg_confidence FROM att""", extra=LAST),
    "risk_distribution": sql("SELECT risk, count(*) AS n FROM res GROUP BY risk"),
    "feature_means_by_risk": sql(
        """SELECT risk, round(avg(paste_count), 6) AS mean_paste_count, round(avg(tab_hidden_count), 6) AS mean_tab_hidden_count,
             round(avg(time_per_question_mean_s), 6) AS mean_time_per_question FROM res GROUP BY risk"""),
    "score_trend": sql(f"SELECT timestamp_us, aid AS attempt_id, {SCORE} FROM att", extra=LAST),
    "risk_options": sql("SELECT DISTINCT risk FROM res"),
    # patterns
    "pattern_idle_tab_paste_fast": sql(PAT_A),
    "pattern_high_tab_low_time": sql(PAT_B),
    "pattern_medium_tab_low_time": sql(PAT_C, extended=True),
    "pattern_medium_idle_fast": sql(PAT_D),
    "detect_patterns": sql(" UNION ALL ".join([PAT_A, PAT_B, PAT_C, PAT_D])),
    "pattern_medium_tab_low_time_default": sql(PAT_C, extended=True, min_questions=10),
    "pattern_medium_idle_fast_default": sql(PAT_D, min_questions=10),
    "pattern_summary": sql(
        f"SELECT aid AS attempt_id, pattern_count, {r('pattern_strength')}, found[1].n AS first_pattern, found[2].n AS second_pattern FROM res WHERE pattern_count > 0"),
    # windows
    "latest_per_attempt": plain(
        """SELECT attempt_id, max_by(timestamp_us, arrival) AS timestamp_us, max_by(event_type, arrival) FILTER (event_type IS NOT NULL) AS event_type,
             max_by(state, arrival) FILTER (state IS NOT NULL) AS state, max_by(question_id, arrival) AS question_id
           FROM (SELECT *, max(timestamp_us) OVER (PARTITION BY attempt_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newest FROM (
             SELECT split_part(attempt_id, '-', 1) AS attempt_id, arrival, CASE WHEN k % 6 = 0 THEN received_us - 432000000000 ELSE received_us END AS timestamp_us,
               CASE WHEN k % 2 = 0 THEN event_type END AS event_type, state, question_id FROM ev))
           WHERE timestamp_us = newest GROUP BY attempt_id"""),
    "progressive_risk": prefixes(f"SELECT {PROGRESS} FROM res"),
    "progressive_risk_with_predictions": f"WITH {EVENTS}{NO_TTL},{chain(PREFIX, predictions=STAND_IN)} SELECT {PROGRESS} FROM res",
    "progressive_risk_ttl": prefixes(
        f"SELECT session_id, {PROGRESS} FROM res JOIN (SELECT attempt_id || '#' || CAST(arrival AS VARCHAR) AS aid, session_id FROM seen) USING (aid)", seen=TTL),
    "progressive_risk_late": prefixes(f"SELECT {PROGRESS} FROM res", seen=LATE),
    "risk_transitions": prefixes(
        f"""SELECT attempt_id, arrival, risk, {SCORE}, previous_risk FROM (SELECT *, lag(risk) OVER (PARTITION BY attempt_id ORDER BY arrival) AS previous_risk FROM hist)
            WHERE previous_risk <> risk""", extra=HIST),
    "cache_sessions": f"WITH {EVENTS}{TTL} SELECT attempt_id, arrival, session_id FROM seen",
    "retain_latest_n": sql("SELECT aid AS attempt_id, risk, timestamp_us FROM att ORDER BY timestamp_us DESC, aid LIMIT 500", extra=LAST),
    "retain_latest_clamped": plain(
        """SELECT user AS attempt_id, arrival FROM (SELECT *, split_part(attempt_id, '-', 1) AS user FROM ev)
           QUALIFY row_number() OVER (PARTITION BY user ORDER BY t DESC, seq DESC, arrival DESC) <= 100"""),
    "retain_latest_per_attempt": plain(
        "SELECT attempt_id, arrival FROM ev QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY t DESC, seq DESC, arrival DESC) <= 5"),
    "top_signals": sql(
        """SELECT aid AS attempt_id, CAST(position - 1 AS INTEGER) AS position, x.n AS name, round(-x.s, 6) AS score FROM (
             SELECT aid, unnest(list_sort([{'s': -s1, 'p': 1, 'n': 'timing'}, {'s': -s2, 'p': 2, 'n': 'tab'}, {'s': -s3, 'p': 3, 'n': 'clipboard'},
               {'s': -0.1::DOUBLE, 'p': 4, 'n': 'idle'}, {'s': -0.1::DOUBLE, 'p': 5, 'n': 'answer_changes'}, {'s': -0.1::DOUBLE, 'p': 6, 'n': 'typing'}])[1:3]) AS x,
               unnest([1, 2, 3]) AS position FROM res)"""),
    # sorts and limits
    "top_alerts": sql(
        f"""SELECT aid AS attempt_id, risk, {r('combined_score', 'confidence')}, timestamp_us FROM att WHERE risk IN ('HIGH', 'MEDIUM')
            ORDER BY timestamp_us DESC, aid LIMIT 8""", extra=LAST),
    "log_explorer": sql(
        f"""SELECT timestamp_us, aid AS attempt_id, risk, {r('confidence', 'confidence_score', 'combined_score')} FROM att
            ORDER BY timestamp_us DESC, aid LIMIT 200""", extra=LAST),
    "review_queue": sql(
        f"""SELECT aid AS attempt_id, coalesce(candidate_name, aid) AS display_name, coalesce(candidate_email, 'No email available') AS display_email,
              assessment_name AS display_assessment, {duration_of('attempt_duration_s')} AS duration_text, 'COMPLETED' AS status, risk, {SCORE},
              {label_of('latest_event_type', 'latest_question_id')} AS activity, latest_event_us AS last_activity_at, event_count
            FROM att ORDER BY timestamp_us DESC, aid LIMIT 150""", extra=LAST),
    "panel_top8": sql(
        """SELECT aid AS attempt_id, timestamp_us, panel, CAST(position AS INTEGER) AS position FROM (
             SELECT aid, timestamp_us, panel, row_number() OVER (PARTITION BY panel ORDER BY timestamp_us DESC, aid) AS position FROM (
               SELECT aid, timestamp_us, status AS panel FROM att UNION ALL SELECT aid, timestamp_us, risk FROM att WHERE risk <> 'LOW'))
           WHERE position <= 8""", extra=LAST),
    # scalar functions
    "clamp01": """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber = 7 THEN 0.0 ELSE
        greatest(0.0, least(1.0, l_discount * 20 - l_tax * 10)) END, 6) AS clamped FROM lineitem""",
    "ramp": """SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, (l_discount * 4 - 0.08) / (0.25 - 0.08))), 6) AS rising,
        round(greatest(0.0, least(1.0, (l_quantity / 5 - 9.0) / (4.0 - 9.0))), 6) AS falling FROM lineitem""",
    "parse_event_time": plain(
        f"""SELECT id, epoch_us(TRY_CAST(CASE WHEN arrival % 5 = 0 THEN replace(occurred_at, 'Z', '+05:30') ELSE occurred_at END AS TIMESTAMPTZ)) - {EPOCH} AS t_us
            FROM raw""", raw=True),
    "risk_labels": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS rank,
        CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS mapped,
        CASE WHEN o_orderkey % 5 IN (1, 3) THEN 1 ELSE 0 END AS binary FROM orders""",
    "safe_label": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'LOW' END AS label FROM orders""",
    "fixed_numbers": """SELECT o_orderkey, printf('%.1f', x) AS one, printf('%.2f', x) AS two, printf('%.0f', 100 * x) || '%' AS pct
        FROM (SELECT o_orderkey, o_orderkey / 3000.0::DOUBLE + 1.0::DOUBLE / 7 AS x FROM orders)""",
    "format_duration": f"""SELECT l_orderkey, l_linenumber, {duration_of('s')} AS text
        FROM (SELECT *, CASE WHEN l_linenumber <> 6 THEN l_extendedprice / 7 - 500 END AS s FROM lineitem)""",
    "paste_size_category": """SELECT l_orderkey, l_linenumber, CASE WHEN x IS NULL OR x <= 0 THEN 'unknown' WHEN x <= 20 THEN 'small' WHEN x <= 120 THEN 'medium'
        ELSE 'large' END AS size FROM (SELECT *, CASE WHEN l_linenumber <> 5 THEN l_quantity * 4 - 10 END AS x FROM lineitem)""",
    "build_reason": sql(f"SELECT aid AS attempt_id, {reason_of('risk', REASON3)} AS reason FROM res"),
    "primary_issue": sql(f"SELECT aid AS attempt_id, {ISSUE} AS issue FROM res"),
    "report_texts": sql(
        f"""SELECT aid AS attempt_id, CASE risk WHEN 'HIGH' THEN 'Urgent evaluator review recommended' WHEN 'MEDIUM' THEN 'Manual review recommended'
              ELSE 'No immediate review required' END AS decision,
            CASE risk WHEN 'HIGH' THEN 'This attempt needs urgent review. The strongest reason is: ' || {ISSUE} || '.'
              WHEN 'MEDIUM' THEN 'This attempt should be manually reviewed. The strongest reason is: ' || {ISSUE} || '.'
              ELSE 'This attempt currently appears normal. No strong suspicious behavioral pattern was detected.' END AS summary FROM res"""),
    "evidence_items": sql(_evidence()),
    "exam_status": sql("SELECT aid AS attempt_id, status FROM att", extra=LAST),
    "exam_status_extended": sql("SELECT aid AS attempt_id, status FROM att", extra=LAST, extended=True),
    "latest_activity": sql(
        f"""SELECT aid AS attempt_id, coalesce(CASE WHEN event_count % 3 <> 0 THEN {label_of('latest_event_type', 'latest_question_id')} END,
              CASE WHEN event_count % 2 = 0 THEN explanation_text END, {ISSUE}) AS activity,
            CASE WHEN event_count % 3 <> 0 THEN latest_event_us ELSE timestamp_us END AS activity_us FROM att""", extra=LAST),
    "display_defaults": sql(
        f"""SELECT aid AS attempt_id, coalesce(candidate_name, aid) AS display_name, coalesce(candidate_email, 'No email available') AS display_email,
              assessment_name AS display_assessment, {duration_of('attempt_duration_s')} AS duration_text, event_count FROM att""", extra=LAST),
    "explain_attempts": sql(
        "SELECT aid AS attempt_id, array_to_string(summary, '|') AS summary, array_to_string(reasons, '|') AS reasons FROM res"),
    "explanation_text": sql("SELECT aid AS attempt_id, explanation_text FROM res", predictions=PREDICTIONS),
    # streaming and sessions
    "stream_score_attempts": f"WITH {EVENTS}{RAW}{STREAMED},{chain(PREFIX)}{HIST}{PLACED} "
    f"""SELECT attempt_id, risk, round(confidence_score, 6) AS confidence, {SCORE}, reason FROM (
          SELECT attempt_id, risk, confidence_score, combined_score, reason FROM hist
          UNION ALL
          SELECT u.attempt_id, h.risk, h.confidence_score, h.combined_score, h.reason
          FROM placed u JOIN (SELECT placed.*, hist.* EXCLUDE (attempt_id, arrival) FROM placed JOIN hist USING (attempt_id, arrival)) h
            ON u.attempt_id = h.attempt_id AND (h.half, h.at) < (u.half, u.at)
          WHERE NOT u.usable QUALIFY row_number() OVER (PARTITION BY u.arrival ORDER BY h.half DESC, h.at DESC) = 1)""",
    "stream_current_risk": plain(
        """SELECT attempt_id, count(*) AS event_count FROM raw GROUP BY 1
           HAVING count(*) FILTER (event_type IS NOT NULL AND TRY_CAST(occurred_at AS TIMESTAMPTZ) IS NOT NULL) > 0""", raw=True),
    "stream_quarantine": plain(
        """SELECT CASE WHEN arrival % 13 = 0 THEN 'Unreadable record' WHEN arrival % 11 = 0 THEN 'Missing attempt_id'
               WHEN event_type IS NULL THEN 'Missing event_type' ELSE 'Unreadable time' END AS reason, count(*) AS n
           FROM raw WHERE arrival % 13 = 0 OR arrival % 11 = 0 OR event_type IS NULL OR TRY_CAST(occurred_at AS TIMESTAMPTZ) IS NULL GROUP BY 1""", raw=True),
    "stream_attempt_state": plain(
        """SELECT attempt_id, count(*) AS event_count, count(*) FILTER (event_type = 'clipboard' AND action = 'paste') AS paste_count,
             count(*) FILTER (event_type = 'visibility_change' AND state = 'hidden') AS tab_hidden_count,
             count(*) FILTER (event_type = 'exam_submitted') AS submits,
             min(t) FILTER (TRY_CAST(occurred_at AS TIMESTAMPTZ) IS NOT NULL) AS first_us,
             max(t) FILTER (TRY_CAST(occurred_at AS TIMESTAMPTZ) IS NOT NULL) AS last_us FROM raw GROUP BY 1""", raw=True),
    "late_event_policy": f"""WITH {EVENTS}{LATE} SELECT attempt_id, arrival, round((newest - t) / 1000000, 6) AS late_by_s FROM (
        SELECT *, max(t) OVER (PARTITION BY attempt_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM seen)
        WHERE newest - t > 20000000""",
    "idle_sessions": plain(
        """SELECT attempt_id, arrival, 'idle' AS state, p AS t_us, round((t - p) / 1000000, 6) AS duration_s FROM g WHERE t - p >= 30000000
           UNION ALL SELECT attempt_id, arrival, 'active', t, NULL FROM g WHERE t - p >= 30000000""",
        extra=", g AS (SELECT attempt_id, arrival, t, lag(t) OVER (PARTITION BY attempt_id ORDER BY t, seq, arrival) AS p FROM ev)"),
    "typing_sessions": plain(
        """SELECT attempt_id, question_id, session, min(t) AS start_us, max(t) + 8000000 AS stop_us, count(*) AS keystrokes,
             round((max(t) + 8000000 - min(t)) / 1000000, 6) AS duration_s
           FROM (SELECT *, CAST(sum(CASE WHEN t - p <= 8000000 THEN 0 ELSE 1 END) OVER (PARTITION BY attempt_id, question_id ORDER BY t, seq, arrival) AS BIGINT) AS session
             FROM (SELECT *, lag(t) OVER (PARTITION BY attempt_id, question_id ORDER BY t, seq, arrival) AS p FROM ev WHERE event_type = 'question_answer'))
           GROUP BY 1, 2, 3"""),
    "focus_sessions": plain(
        """SELECT attempt_id, arrival, 'hidden' AS kind, p AS start_us, t AS end_us, round((t - p) / 1000000, 6) AS duration_s FROM (
             SELECT *, lag(t) OVER (PARTITION BY attempt_id ORDER BY t, seq, arrival) AS p, lag(state) OVER (PARTITION BY attempt_id ORDER BY t, seq, arrival) AS ps
             FROM ev WHERE event_type = 'visibility_change') WHERE state = 'visible' AND ps = 'hidden'"""),
    # learning
    "ml_features_serve": sql(f"SELECT aid AS attempt_id, {SERVE_MATRIX} FROM res"),
    "ml_features_train": sql(
        f"SELECT aid AS attempt_id, {RANK.format(r='risk')} AS risk, {TRAIN_MATRIX} FROM res WHERE event_count % 9 <> 0"),
    "ml_features_refine": sql(f"SELECT aid AS attempt_id, {REFINE_MATRIX} FROM ft"),
    "clean_training_set": sql(
        f"SELECT aid AS attempt_id, {RANK.format(r='risk')} AS risk, {TRAIN_MATRIX} FROM res WHERE greatest(questions_seen, 1) <> 2 AND paste_count <> 4"),
    "stratified_split": sql(
        f"""SELECT risk, side, CAST(CASE side WHEN 'train' THEN round(n * 0.8) ELSE n - round(n * 0.8) END AS BIGINT) AS n
            FROM (SELECT {RANK.format(r='risk')} AS risk, count(*) AS n FROM res GROUP BY 1), (VALUES ('train'), ('test')) v(side)"""),
    "scale_features": sql(
        "SELECT attempt_id, risk, " + ", ".join(
            f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) AS {c}" for c in SERVE)
        + f" FROM (SELECT aid AS attempt_id, {RANK.format(r='risk')} AS risk, {TRAIN_MATRIX.replace(', 6)', ', 15)')} FROM res)"),
    "save_model": sql("SELECT aid AS attempt_id, true AS same FROM res"),
    "predict_in_plan": sql("SELECT aid AS attempt_id, true AS same FROM res"),
    "predict_risk": sql("SELECT aid AS attempt_id, true AS known_label, true AS adds_up, true AS is_maximum, true AS beats_majority FROM res"),
    "train_risk_forest": sql("SELECT risk AS expected_label, n - CAST(round(n * 0.8) AS BIGINT) AS n, true AS beats_majority FROM (SELECT risk, count(*) AS n FROM res GROUP BY 1)"),
    "feature_importance": "SELECT unnest([" + ", ".join(f"'{c}'" for c in SERVE) + "]) AS feature, true AS adds_up, true AS is_share, true AS tells_apart",
    **{name: sql("""SELECT CAST(expected_label = 'MEDIUM' AS INTEGER) AS label, count(*) - CAST(round(count(*) * 0.75) AS BIGINT) AS n, true AS probabilities, true AS tells_apart
        FROM att WHERE expected_label <> 'HIGH' GROUP BY 1""", extra=LAST) for name in ("train_refine_logistic", "train_refine_forest")},
    "rebuild_refine_dataset": sql(
        f"SELECT aid AS attempt_id, expected_label AS label, {REFINE_MATRIX} FROM att WHERE expected_label <> 'HIGH'", extra=LAST),
    "refine_low_medium": _refine(),
}
ORACLE["write_eval_report_metrics"] = ORACLE["eval_metrics"]
ORACLE["score_attempts_default"] = ORACLE["score_attempts"].replace("questions_seen >= 4", "questions_seen >= 10")
ORACLE["score_attempts_with_model"] = ORACLE["score_attempts"].replace(chain(BASE), chain(BASE, predictions=STAND_IN))
ORACLE["stream_late_events"] = ORACLE["late_event_policy"]


def _newton(columns: list[str], rows: str, steps: int = 10) -> str:
    """Newton steps for logistic regression: sums per step, and elimination of one variable after the other."""
    d = len(columns) + 1
    scaled = ", ".join(f"CASE WHEN stddev_samp({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () ELSE 0 END" for c in columns)
    names = ", ".join(f"'{c}'" for c in ["intercept", *columns])
    return f"""WITH RECURSIVE {rows},
    seen AS MATERIALIZED (SELECT CAST(label = 'MEDIUM' AS DOUBLE) AS y, CASE WHEN label = 'MEDIUM' THEN 1.25 ELSE 1.0 END AS w,
        [1.0::DOUBLE, {scaled}] AS x FROM labelled),
    newton(step, b) AS (
        SELECT 0, list_transform(range({d}), lambda i: 0.0::DOUBLE)
        UNION ALL
        SELECT step + 1, list_transform(range(1, {d + 1}), lambda i: b[i] + m[i][{d + 1}]) FROM (
            SELECT step, b, list_reduce(list_prepend(m, list_transform(range(1, {d + 1}), lambda k: [[k::DOUBLE]])), lambda a, e:
                list_transform(range(1, {d + 1}), lambda r: list_transform(range(1, {d + 2}), lambda c:
                    CASE WHEN r = e[1][1]::INTEGER THEN a[r][c] / a[r][r]
                    ELSE a[r][c] - a[r][e[1][1]::INTEGER] * a[e[1][1]::INTEGER][c] / a[e[1][1]::INTEGER][e[1][1]::INTEGER] END))) AS m
            FROM (SELECT step, any_value(b) AS b, list(line ORDER BY i) AS m FROM (
                SELECT step, i, any_value(b) AS b, list(v ORDER BY j) AS line FROM (
                    SELECT step, i, j, any_value(b) AS b,
                        CASE WHEN j <= {d} THEN sum(w * p * (1 - p) * x[i] * x[j]) + CASE WHEN i = j AND i > 1 THEN 1 ELSE 0 END
                        ELSE sum(w * (y - p) * x[i]) - CASE WHEN i > 1 THEN any_value(b)[i] ELSE 0 END END AS v
                    FROM (SELECT step, b, x, y, w, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM newton, seen WHERE step < {steps}),
                        range(1, {d + 1}) AS r1(i), range(1, {d + 2}) AS r2(j)
                    GROUP BY step, i, j) GROUP BY step, i) GROUP BY step)))
    SELECT unnest([{names}]) AS feature, unnest(list_transform(b, lambda v: round(v, 6))) AS weight FROM newton WHERE step = {steps}"""


_REFINE_COLUMNS = [c + {"time_per_question": "_mean_s", "attempt_duration": "_s"}.get(c, "") for c in SERVE] + list(SEQUENCES)
_LABELLED = sql(
    f"SELECT expected_label AS label, {REFINE_MATRIX.replace(', 6)', ', 15)')} FROM att WHERE expected_label <> 'HIGH'", extra=LAST)
ORACLE["train_refine_newton"] = _newton(_REFINE_COLUMNS, f"labelled AS MATERIALIZED ({_LABELLED})")
