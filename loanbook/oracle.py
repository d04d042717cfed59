"""Equivalent SQL for the registered queries, for an independent engine.

The statements run in DuckDB over the same tables. They are written from the
definition of each table, not generated from the DataFrame code; only the
synthetic tape and its defects are shared text.
"""

from __future__ import annotations

import re

from loanbook.config import DEFAULT
from loanbook.registry import DEMO_SQL, FIXED_SCORE, STATE_CODES, TEST_ERAS, TEST_SMALL_POOL, _slug
from loanbook.operators.report import BUCKET_COLOURS, RECOMMENDATION_TEXTS, STATE_NAMES
from loanbook.sources.testtables import BLANK_FILE, DEFECTS, SHORT_FILE, TAPE_COLUMNS, TORN_FILE


def _r(expression: str, digits: int = 0) -> str:
    if digits == 0:
        return f"round(cast({expression} AS DOUBLE))"
    return f"round(cast({expression} AS DOUBLE)*1e{digits})/1e{digits}"


def _even(expression: str, digits: int = 0) -> str:
    return f"round_even(cast({expression} AS DOUBLE)*1e{digits}, 0)/1e{digits}"


def _pct(part: str, whole: str, digits: int) -> str:
    return _r(f"100e0*({part})/nullif(cast({whole} AS DOUBLE),0)", digits)


def _pct_even(part: str, whole: str, digits: int) -> str:
    return _even(f"100e0*({part})/nullif(cast({whole} AS DOUBLE),0)", digits)


def _n(condition: str = "TRUE") -> str:
    return f"count(*) FILTER (WHERE {condition})"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _bands(column: str, bands, truncate: bool) -> str:
    value = f"trunc({column})" if truncate else column
    cases = " ".join(f"WHEN {value} >= {low} AND {value} <= {high} THEN {_q(label)}" for low, high, label in bands)
    return f"CASE {cases} ELSE 'Unknown' END"


TAPE = "tape AS (SELECT o.o_orderkey AS row_key, " + ", ".join(f"{sql} AS {name}" for name, sql in TAPE_COLUMNS) + (
    " FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey)"
)


def _derived(source: str, name: str) -> str:
    """Sentinels out, derived columns in; ``source`` has typed columns."""
    no_sentinel = ", ".join(
        f"CASE WHEN {c} NOT IN ({', '.join(map(str, DEFAULT.sentinels[c]))}) THEN {c} END AS {c}"
        for c in ("credit_score", "current_credit_score", "ltv", "dti")
    )
    month = "try_cast(substring(orig_date,5,2) AS INTEGER)"
    return (
        f"{name}_a AS (SELECT * REPLACE ({no_sentinel}) FROM {source}), "
        f"{name}_b AS (SELECT *, coalesce(greatest(current_ib_upb, current_actual_upb, current_deferred_upb), 0e0) AS current_upb, "
        "try_cast(substring(orig_date,1,4) AS DOUBLE) AS orig_year, "
        f"CASE WHEN {month} IS NOT NULL THEN concat(substring(orig_date,1,4),'Q',cast(cast(floor(({month}-1)/3e0)+1 AS INTEGER) AS VARCHAR)) END AS orig_quarter, "
        "CASE WHEN delinquency_status IS NULL THEN 'Unknown' WHEN delinquency_status='00' THEN 'Current' "
        "WHEN delinquency_status='01' THEN '30_DPD' WHEN delinquency_status='02' THEN '60_DPD' "
        "WHEN delinquency_status='03' THEN '90_DPD' WHEN delinquency_status='RA' THEN 'REO_Acquired' "
        "WHEN try_cast(delinquency_status AS INTEGER) >= 4 THEN '120_Plus_DPD' ELSE 'Other' END AS dpd_bucket, "
        f"{_bands('credit_score', DEFAULT.credit_score_bands, True)} AS credit_score_band, "
        f"{_bands('ltv', DEFAULT.ltv_buckets, True)} AS ltv_bucket, "
        f"{_bands('orig_interest_rate', DEFAULT.rate_buckets, False)} AS rate_bucket FROM {name}_a), "
        f"{name} AS (SELECT *, cast(dpd_bucket <> 'Current' AS INTEGER) AS is_delinquent, "
        "cast(dpd_bucket IN ('90_DPD','120_Plus_DPD','REO_Acquired') AS INTEGER) AS is_seriously_delinquent "
        f"FROM {name}_b)"
    )


LOANS = f"{TAPE}, {_derived('tape', 'loans')}"

# -- raw text with defects -----------------------------------------------------

_INTS = ("credit_score", "current_credit_score", "ltv", "dti", "loan_age", "num_borrowers")
_DOUBLES = ("orig_interest_rate", "orig_loan_amount", "current_ib_upb", "current_actual_upb", "current_deferred_upb")


def _raw_column(name: str) -> str:
    if name in _INTS:
        clean = f"coalesce(cast(cast({name} AS BIGINT) AS VARCHAR),'')"
    else:
        clean = f"coalesce(cast({name} AS VARCHAR),'')"
    text = DEFECTS[name].replace("{v}", clean) if name in DEFECTS else clean
    return f"{text} AS {name}"


RAW = f"{TAPE}, raw AS (SELECT row_key, {', '.join(_raw_column(n) for n, _ in TAPE_COLUMNS)} FROM tape)"


def _number(name: str) -> str:
    pattern = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    return f"CASE WHEN regexp_full_match({name}, '{pattern}') THEN try_cast({name} AS DOUBLE) END"


TRIMMED = f"{RAW}, trimmed AS (SELECT row_key, {', '.join(f'nullif(trim({n}),{_q(str())}) AS {n}' for n, _ in TAPE_COLUMNS)} FROM raw)"
TYPED = f"{TRIMMED}, typed AS (SELECT * REPLACE ({', '.join(f'{_number(n)} AS {n}' for n in _INTS + _DOUBLES)}) FROM trimmed)"
CLEANED = f"{TYPED}, {_derived('typed', 'cleaned')}"
_CLEAN_COLUMNS = (
    "loan_id, property_state, orig_date, credit_score, current_credit_score, ltv, dti, orig_interest_rate, "
    "delinquency_status, current_ib_upb, current_upb, orig_year, orig_quarter, dpd_bucket, credit_score_band, "
    "ltv_bucket, rate_bucket, is_delinquent, is_seriously_delinquent"
)

# Which file a row's line is in, and what its line looks like.
_FILE = f"CASE WHEN row_key % 500 = 0 THEN '{BLANK_FILE}' WHEN row_key % 50 = 0 THEN '{SHORT_FILE}' ELSE concat(pool_prefix,'_lld.txt') END"
_FIELDS = (
    "CASE WHEN row_key % 500 = 0 THEN 1 WHEN row_key % 50 = 0 THEN 60 WHEN row_key % 1009 = 7 THEN 1 "
    "WHEN row_key % 97 = 3 THEN 87 WHEN row_key % 101 = 5 THEN 88 WHEN row_key % 89 = 4 THEN 95 ELSE 90 END"
)
LINES = f"{RAW}, lines AS (SELECT *, {_FILE} AS file, {_FIELDS} AS fields FROM raw)"
_RECORD_FILE = "concat(pool_prefix,'_records_lld.txt')"
_MATCHED = "(row_key % 13 <> 0 OR row_key % 19 = 0)"

# -- features --------------------------------------------------------------------

_YEAR = "substring(payment_history,37,12)"


def _x(text: str) -> str:
    return f"(length({text}) - length(replace({text},'X','')))"


_WORST = "CASE " + " ".join(f"WHEN contains({_YEAR},'{d}') THEN {d}" for d in range(9, 0, -1)) + " ELSE 0 END"
_RECENT, _PRIOR = "substring(payment_history,43,6)", "substring(payment_history,37,6)"
MATRIX = (
    f"{LOANS}, matrix AS (SELECT loan_id, credit_score, ltv, dti, orig_interest_rate, loan_age, orig_loan_amount, "
    "num_borrowers, cast(trunc(orig_year) AS INTEGER) AS orig_year, credit_score_band, ltv_bucket, rate_bucket, "
    "coalesce(channel,'Unknown') AS channel, coalesce(property_type,'Unknown') AS property_type, "
    "coalesce(occupancy_status,'Unknown') AS occupancy_status, coalesce(loan_purpose,'Unknown') AS loan_purpose, "
    "CASE WHEN first_time_homebuyer='Y' THEN 1 ELSE 0 END AS is_first_time_buyer, "
    f"cast({_x(_YEAR)} AS INTEGER) AS dlq_count_12m, cast({_WORST} AS INTEGER) AS max_dpd_12m, "
    f"cast(12 - length(rtrim({_YEAR},'0')) AS INTEGER) AS consecutive_current, "
    f"cast({_x(_RECENT)} - {_x(_PRIOR)} AS INTEGER) AS dlq_trend_6m, current_upb, "
    "coalesce(current_credit_score, credit_score) AS latest_credit_score, is_delinquent, is_seriously_delinquent, dpd_bucket, "
    f"cast(length(regexp_replace({_YEAR},'[^1-9]','','g')) AS INTEGER) AS dlq_months_12m "
    "FROM loans WHERE loan_id IS NOT NULL AND credit_score IS NOT NULL AND ltv IS NOT NULL AND loan_age IS NOT NULL "
    "AND payment_history IS NOT NULL AND length(payment_history) >= 48)"
)
_NUMERIC = ("credit_score", "ltv", "dti", "orig_interest_rate", "loan_age", "orig_loan_amount", "num_borrowers")
_BEHAVIORAL = ("dlq_count_12m", "max_dpd_12m", "consecutive_current", "dlq_trend_6m", "current_upb", "latest_credit_score")


def _imputed(names) -> str:
    return ", ".join(
        f"coalesce(cast({c} AS DOUBLE), (SELECT quantile_cont(cast({c} AS DOUBLE), 0.5) FROM matrix)) AS {c}" for c in names
    )


# Levels of the synthetic tape after cleaning, sorted, first one dropped.
_LEVELS = {
    "credit_score_band": ["Fair (620-679)", "Good (680-719)", "Subprime (<620)", "Very Good (720-779)"],
    "ltv_bucket": ["Low (<=60)", "Medium (61-80)", "Very High (>90)"],
    "rate_bucket": ["4.5% - 5.5%", "5.5% - 6.5%", "6.5%+", "Below 3.5%"],
    "channel": ["C", "R", "Unknown"],
    "property_type": ["MH", "PU", "SF"],
    "occupancy_status": ["P", "S"],
    "loan_purpose": ["N", "P"],
}
_ONE_HOT = ", ".join(
    f"cast({c} = {_q(level)} AS INTEGER) AS {_slug(f'{c}_{level}')}" for c, levels in _LEVELS.items() for level in levels
)
_MEDIAN_AGE = "(SELECT quantile_cont(loan_age, 0.5) FROM matrix)"
SCORED = f"{MATRIX}, scored AS (SELECT *, {FIXED_SCORE} AS score, is_delinquent AS label FROM matrix)"

# Average rank of ties, 1 = lowest score.
_AUC = (
    "SELECT {name} (sum(avg_rank) FILTER (WHERE label = 1) - {pos} * ({pos} + 1) / 2e0) / ({pos} * (count(*) - {pos})) AS area "
    "FROM (SELECT label, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2e0 AS avg_rank FROM scored)"
)


def _auc(score: str, name: str = "") -> str:
    return _AUC.format(score=score, name=name, pos=f"cast({_n('label = 1')} AS DOUBLE)")


LIFT = (
    f"{SCORED}, ranked AS (SELECT label, row_number() OVER (ORDER BY score DESC, loan_id) AS pos, count(*) OVER () AS n, "
    "sum(label) OVER () AS total FROM scored), "
    "cuts AS (SELECT cast(p AS INTEGER) AS top_pct FROM (VALUES (1),(5),(10),(20)) v(p)), "
    "lift AS (SELECT top_pct, cast(max(greatest(1, floor(n*top_pct/100e0))) AS BIGINT) AS loans_reviewed, "
    "cast(sum(CASE WHEN pos <= greatest(1, floor(n*top_pct/100e0)) THEN label ELSE 0 END) AS BIGINT) AS delinquencies_caught, "
    f"{_pct_even('sum(CASE WHEN pos <= greatest(1, floor(n*top_pct/100e0)) THEN label ELSE 0 END)', 'max(total)', 1)} AS capture_rate_pct "
    "FROM ranked CROSS JOIN cuts GROUP BY top_pct)"
)

_KEYS = "credit_score_band, ltv_bucket, rate_bucket, orig_year"
SEGMENTS = (
    f"{SCORED}, grouped AS (SELECT {_KEYS}, count(*) AS loans, sum(current_upb) AS upb, avg(score) AS s, avg(is_delinquent) AS d, "
    f"avg(credit_score) AS f, round(avg(orig_interest_rate),9) AS r FROM scored WHERE orig_year IS NOT NULL GROUP BY {_KEYS} HAVING count(*) >= 30), "
    f"segments AS (SELECT cast(row_number() OVER (ORDER BY s DESC, {_KEYS}) AS INTEGER) AS position, {_KEYS}, loans, "
    f"{_even('upb')} AS total_upb, {_even('s*100', 2)} AS avg_risk_score, {_even('d*100', 2)} AS actual_dlq_rate, "
    f"{_even('f')} AS avg_fico, {_even('r', 3)} AS avg_rate FROM grouped)"
)

# -- portfolio -------------------------------------------------------------------

_DLQ = _pct("sum(is_delinquent)", "count(*)", 2)
_SERIOUS = _pct("sum(is_seriously_delinquent)", "count(*)", 2)
_PAIR_STATE = "CASE {c} WHEN '0' THEN 'Current' WHEN '1' THEN '30_DPD' WHEN '2' THEN '60_DPD' WHEN '3' THEN '90_DPD' ELSE '120_Plus' END"
ROLL = (
    f"{LOANS}, pairs AS (SELECT substring(payment_history, p, 1) AS a, substring(payment_history, p + 1, 1) AS b "
    "FROM loans, (SELECT cast(unnest(generate_series(37, 47)) AS INTEGER) AS p) WHERE length(payment_history) >= 48), "
    f"moves AS (SELECT {_PAIR_STATE.format(c='a')} AS from_bucket, {_PAIR_STATE.format(c='b')} AS to_bucket, count(*) AS transitions "
    "FROM pairs WHERE a BETWEEN '0' AND '9' AND b BETWEEN '0' AND '9' GROUP BY 1, 2), "
    f"roll AS (SELECT *, {_pct('transitions', 'sum(transitions) OVER (PARTITION BY from_bucket)', 2)} AS transition_pct FROM moves)"
)
_SEGMENT_SQL = (
    "SELECT credit_score_band, ltv_bucket, rate_bucket, cast(trunc(orig_year) AS INTEGER) AS orig_year, count(*) AS loans, "
    f"{_r('sum(current_upb)')} AS total_upb, {_DLQ} AS dlq_rate_pct, {_SERIOUS} AS serious_dlq_pct, "
    f"{_r('avg(credit_score)')} AS avg_fico, {_r('round(avg(orig_interest_rate),9)', 3)} AS avg_rate, {_r('avg(loan_age)')} AS avg_loan_age "
    "FROM loans WHERE credit_score_band <> 'Unknown' AND ltv_bucket <> 'Unknown' AND orig_year IS NOT NULL "
    "GROUP BY credit_score_band, ltv_bucket, rate_bucket, orig_year HAVING count(*) >= 20"
)
_SUMMARY = (
    f"SELECT count(*) AS total_loans, {_r('sum(current_upb)')} AS total_upb, {_r('avg(credit_score)')} AS avg_credit_score, "
    f"{_r('round(avg(orig_interest_rate),9)', 3)} AS avg_orig_rate, {_r('avg(ltv)', 1)} AS avg_ltv, {_DLQ} AS delinquency_rate_pct, "
    f"{_SERIOUS} AS serious_dlq_rate_pct, cast(sum(is_delinquent) AS BIGINT) AS delinquent_loans, "
    "cast(sum(is_seriously_delinquent) AS BIGINT) AS seriously_delinquent_loans, min(orig_year) AS earliest_vintage, "
    "max(orig_year) AS latest_vintage, count(DISTINCT property_state) AS states_covered, "
    "count(DISTINCT pool_prefix) AS pools_loaded FROM loans"
)


def _share_of(bucket: str, digits: int, column: str) -> str:
    return _pct(_n(f"{column} = {_q(bucket)}"), "count(*)", digits)


_VINTAGE = (
    f"SELECT cast(trunc(orig_year) AS INTEGER) AS orig_year, count(*) AS loans, {_r('sum(current_upb)/1e9', 2)} AS upb_billions, "
    f"{_DLQ} AS dlq_rate_pct, {_SERIOUS} AS serious_dlq_pct, {_r('avg(credit_score)')} AS avg_fico, "
    f"{_r('round(avg(orig_interest_rate),9)', 3)} AS avg_rate, {_r('avg(ltv)', 1)} AS avg_ltv, {_r('avg(loan_age)')} AS avg_loan_age, "
    f"{_share_of('30_DPD', 2, 'dpd_bucket')} AS pct_30dpd, {_share_of('60_DPD', 2, 'dpd_bucket')} AS pct_60dpd, "
    f"{_share_of('90_DPD', 2, 'dpd_bucket')} AS pct_90dpd, {_share_of('120_Plus_DPD', 2, 'dpd_bucket')} AS pct_120plus, "
    f"{_share_of('Excellent (780+)', 1, 'credit_score_band')} AS pct_excellent, "
    f"{_share_of('Fair (620-679)', 1, 'credit_score_band')} AS pct_fair FROM loans WHERE orig_year IS NOT NULL GROUP BY orig_year"
)
_GEO = (
    f"SELECT property_state, count(*) AS loans, {_r('sum(current_upb)/1e9', 3)} AS upb_billions, {_DLQ} AS dlq_rate_pct, "
    f"{_SERIOUS} AS serious_dlq_pct, {_r('avg(credit_score)')} AS avg_fico, {_r('round(avg(orig_interest_rate),9)', 3)} AS avg_rate, "
    f"{_r('avg(ltv)', 1)} AS avg_ltv, {_pct('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct_of_portfolio, "
    f"{_pct('sum(current_upb)', 'sum(sum(current_upb)) OVER ()', 2)} AS pct_of_upb "
    "FROM loans WHERE property_state IS NOT NULL GROUP BY property_state"
)
_DPD = (
    f"SELECT dpd_bucket, count(*) AS loans, {_r('sum(current_upb)')} AS total_upb, "
    f"{_pct('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct_of_portfolio FROM loans GROUP BY dpd_bucket"
)
_AVG_DLQ = f"(SELECT {_DLQ} FROM loans)"
_DUPLICATES = "(SELECT count(*) FROM (SELECT loan_id FROM loans WHERE loan_id IS NOT NULL GROUP BY loan_id HAVING count(*) > 1))"


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


# -- checks ------------------------------------------------------------------------

_PROFILE = (
    "loan_id", "credit_score", "ltv", "dti", "current_upb", "delinquency_status",
    "property_state", "orig_interest_rate", "payment_history", "current_credit_score",
)


def _gate(name: str, status: str, value: str, detail: str) -> str:
    return f"SELECT '{name}' AS check_name, {status} AS status, cast({value} AS DOUBLE) AS value, {detail} AS detail FROM loans"


def _null_gate(c: str, limit: float, worse: str) -> str:
    share = _pct_even(_n(f"{c} IS NULL"), "count(*)", 2)
    return _gate(
        f"null_{c}", f"CASE WHEN {share} > {limit} THEN '{worse}' ELSE 'PASS' END", share,
        f"concat(cast({share} AS VARCHAR), '% null (threshold: {limit}%)')",
    )


def _range_gate(c: str, low: float, high: float) -> str:
    count = _n(f"{c} < {low} OR {c} > {high}")
    share = _pct_even(count, "count(*)", 2)
    return _gate(
        f"range_{c}", f"CASE WHEN {share} < 1 THEN 'PASS' ELSE 'WARN' END", count,
        f"concat(format('{{:,}}', {count}), ' loans out of [{low}, {high}] (', cast({share} AS VARCHAR), '%)')",
    )


_SMALL = "(SELECT count(*) FROM (SELECT pool_prefix FROM loans GROUP BY pool_prefix HAVING count(*) < 100))"
GATES = f"{LOANS}, gates AS (" + _union([
    _gate("total_rows", "CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END", "count(*)", "concat(format('{:,}', count(*)), ' loans loaded')"),
    f"SELECT 'duplicate_loan_ids', CASE WHEN d <= 0 THEN 'PASS' ELSE 'WARN' END, cast(d AS DOUBLE), "
    f"concat(format('{{:,}}', d), ' duplicate loan IDs (threshold: 0)') FROM (SELECT {_DUPLICATES} AS d)",
    _null_gate("loan_id", 0.0, "FAIL"), _null_gate("delinquency_status", 1.0, "FAIL"),
    _null_gate("credit_score", 5.0, "WARN"), _null_gate("ltv", 5.0, "WARN"), _null_gate("current_upb", 2.0, "WARN"),
    _range_gate("credit_score", 300, 850), _range_gate("ltv", 1, 200), _range_gate("orig_interest_rate", 0.1, 15.0),
    _gate("vintage_coverage", "CASE WHEN count(DISTINCT orig_year) >= 5 THEN 'PASS' ELSE 'WARN' END", "count(DISTINCT orig_year)",
          "concat(cast(count(DISTINCT orig_year) AS VARCHAR), ' distinct origination years')"),
    f"SELECT 'small_pools', 'WARN', cast({_SMALL} AS DOUBLE), concat(cast({_SMALL} AS VARCHAR), ' pool(s) have fewer than 100 loans') FROM (SELECT 1) WHERE {_SMALL} > 0",
]) + ")"
_OVERALL = (
    f"SELECT CASE WHEN {_n('status = ' + _q('FAIL'))} > 0 THEN 'FAIL' WHEN {_n('status = ' + _q('WARN'))} > 0 THEN 'WARN' ELSE 'PASS' END AS overall, "
    f"{_n('status = ' + _q('FAIL'))} = 0 AS passed, {_n('status = ' + _q('PASS'))} AS n_pass, "
    f"{_n('status = ' + _q('WARN'))} AS n_warn, {_n('status = ' + _q('FAIL'))} AS n_fail FROM "
)


def _complete(c: str) -> str:
    limit = {"loan_id": 0.0, "delinquency_status": 1.0, "credit_score": 5.0, "ltv": 5.0, "current_upb": 2.0}.get(c, 10.0)
    worse = "FAIL" if c in ("loan_id", "delinquency_status") else "WARN"
    share = _pct_even(_n(f"{c} IS NULL"), "count(*)", 3)
    return (
        f"SELECT '{c}' AS column_name, {share} AS null_pct, cast({limit} AS DOUBLE) AS threshold, "
        f"CASE WHEN {share} > {limit} THEN '{worse}' ELSE 'PASS' END AS status FROM loans"
    )


_COMPLETENESS = _union([_complete(c) for c in _PROFILE])
_RULES = {
    "Credit score outside 300–850": "credit_score < 300 OR credit_score > 850",
    "LTV outside 1–200": "ltv < 1 OR ltv > 200",
    "Interest rate outside 0.1–15%": "orig_interest_rate < 0.1 OR orig_interest_rate > 15",
    "Negative current UPB": "current_upb < 0",
    "Empty property state": "property_state IS NULL OR length(trim(property_state)) = 0",
    "Payment history shorter than 10 chars": "length(payment_history) < 10",
}


def _valid(label: str, condition: str) -> str:
    share = _pct_even(_n(condition), "count(*)", 3)
    return (
        f"SELECT '{label}' AS check_name, {_n(condition)} AS violations, {share} AS pct, "
        f"CASE WHEN {share} < 0.5 THEN 'PASS' WHEN {share} < 2 THEN 'WARN' ELSE 'FAIL' END AS status FROM loans"
    )


_VALIDITY = _union([_valid(k, v) for k, v in _RULES.items()])
_ABOVE = _n("current_upb > orig_loan_amount AND orig_loan_amount > 0 AND current_upb > 0 AND dpd_bucket = 'Current'")
_NO_AGE = _n("loan_age IS NULL")


def _consistent(label: str, count: str, status: str, note: str) -> str:
    return (
        f"SELECT '{label}' AS check_name, cast({count} AS BIGINT) AS violations, {_pct_even(count, 'count(*)', 3)} AS pct, "
        f"{status} AS status, '{note}' AS note FROM loans"
    )


_CONSISTENCY = _union([
    _consistent("Current UPB exceeds original amount (performing loans)", _ABOVE,
                f"CASE WHEN {_ABOVE}/cast(count(*) AS DOUBLE) < 0.01 THEN 'PASS' ELSE 'WARN' END",
                "The balance can pass the original amount when missed interest is added to it by a modification"),
    _consistent("Duplicate loan IDs", _DUPLICATES, f"CASE WHEN {_DUPLICATES} = 0 THEN 'PASS' ELSE 'FAIL' END", ""),
    _consistent("Missing loan_age", _NO_AGE, f"CASE WHEN {_NO_AGE}/cast(count(*) AS DOUBLE) < 0.01 THEN 'PASS' ELSE 'WARN' END",
                "Record-type tapes carry no loan age"),
])


# -- manifest ------------------------------------------------------------------------

_KEY_COLUMNS = ("loan_id", "credit_score", "ltv", "dti", "delinquency_status", "current_upb", "property_state")
# A line of 87 fields or fewer, or in an unusable file, is not loaded.
_LOADED = "l.fields >= 88"
_LAYOUT = (
    f"layout_of AS (SELECT file, count(*) AS n, CASE WHEN file = '{BLANK_FILE}' THEN 'UNKNOWN' ELSE 'DI' END AS layout, "
    f"file NOT IN ('{BLANK_FILE}', '{SHORT_FILE}') AS ok, {_n('fields >= 88')} AS good FROM lines GROUP BY file)"
)
MANIFEST = (
    f"{LINES}, trimmed AS (SELECT row_key, {', '.join(f'nullif(trim({n}),{_q(str())}) AS {n}' for n, _ in TAPE_COLUMNS)} FROM raw), "
    f"typed AS (SELECT * REPLACE ({', '.join(f'{_number(n)} AS {n}' for n in _INTS + _DOUBLES)}) FROM trimmed), {_derived('typed', 'cleaned')}, {_LAYOUT}, "
    "loaded AS (SELECT l.file, count(*) AS rows_loaded, "
    f"{_r('sum(c.current_upb)')} AS total_upb, concat(cast(cast(trunc(min(c.orig_year)) AS INTEGER) AS VARCHAR),'-',cast(cast(trunc(max(c.orig_year)) AS INTEGER) AS VARCHAR)) AS vintages, "
    + ", ".join(f"{_pct_even(_n(f'c.{k} IS NULL'), 'count(*)', 2)} AS null_pct_{k}" for k in _KEY_COLUMNS)
    + f" FROM lines l JOIN cleaned c USING (row_key) JOIN layout_of f ON f.file = l.file WHERE f.ok AND {_LOADED} GROUP BY l.file), "
    "manifest AS (SELECT f.file, cast(NULL AS DOUBLE) AS size_mb, CASE WHEN f.ok THEN 'OK' ELSE 'SKIPPED' END AS status, f.layout, "
    "CASE WHEN f.layout = 'UNKNOWN' THEN 0 ELSE f.n END AS total_lines, CASE WHEN f.ok THEN f.good END AS rows_parsed, "
    "CASE WHEN f.ok THEN f.n - f.good END AS rows_skipped, d.rows_loaded, "
    "CASE WHEN f.ok THEN cast(sum(d.rows_loaded) OVER (ORDER BY f.file) AS BIGINT) END AS total_in_table, d.total_upb, d.vintages, "
    + ", ".join(f"d.null_pct_{k}" for k in _KEY_COLUMNS)
    + ", CASE WHEN f.layout = 'UNKNOWN' THEN 'File is empty or unreadable' WHEN NOT f.ok THEN 'Expected 90 fields, found 60: schema mismatch' END AS issues, "
    "CASE WHEN f.layout = 'UNKNOWN' THEN 'Unknown format: UNKNOWN' WHEN NOT f.ok THEN 'Schema mismatch: field count does not match expected' END AS error "
    "FROM layout_of f LEFT JOIN loaded d ON d.file = f.file)"
)


# Files of a load: flat ones as above, record-type ones, and one that cannot be read.
_RECORD_COUNT = "1 + " + " + ".join(f"cast({c} AS INTEGER)" for c in ("row_key % 1000 = 0", "row_key % 19 = 0", "row_key % 13 <> 0", "row_key % 17 = 0", "row_key % 23 = 0"))
LOADED = (
    f"{MANIFEST}, merged AS (SELECT {_RECORD_FILE} AS file, {_RECORD_COUNT} AS lines, {_MATCHED} AS matched, * REPLACE ("
    "CASE WHEN row_key % 17 = 0 THEN 'ZZ' ELSE property_state END AS property_state, "
    "CASE WHEN row_key % 13 <> 0 THEN delinquency_status ELSE '09' END AS delinquency_status, coalesce(current_deferred_upb, 0e0) AS current_upb) FROM cleaned), "
    f"record_lines AS (SELECT file, cast(sum(lines) AS BIGINT) AS total_lines, {_n('matched')} AS rows_parsed, {_n('NOT matched')} AS rows_skipped FROM merged GROUP BY file), "
    f"record_files AS (SELECT file, 'OK' AS status, 'SC' AS layout, total_lines, rows_parsed, rows_skipped, count(*) AS rows_loaded, {_r('sum(current_upb)')} AS total_upb, "
    "concat(cast(cast(trunc(min(orig_year)) AS INTEGER) AS VARCHAR),'-',cast(cast(trunc(max(orig_year)) AS INTEGER) AS VARCHAR)) AS vintages, "
    + ", ".join(f"{_pct_even(_n(f'{k} IS NULL'), 'count(*)', 2)} AS null_pct_{k}" for k in _KEY_COLUMNS)
    + f" FROM merged JOIN record_lines USING (file) WHERE matched GROUP BY file, total_lines, rows_parsed, rows_skipped), "
    f"torn AS (SELECT '{TORN_FILE}' AS file, 'ERROR' AS status, 'UNKNOWN' AS layout, 0 AS total_lines, 'File is empty or unreadable' AS issues, "
    "'Read error: ChecksumException' AS error), "
    "all_files AS (SELECT * EXCLUDE (size_mb, total_in_table) FROM manifest UNION ALL BY NAME SELECT * FROM record_files UNION ALL BY NAME SELECT * FROM torn), "
    "loads AS (SELECT *, CASE WHEN status <> 'OK' THEN NULL WHEN run = 1 THEN cast(sum(rows_loaded) OVER (PARTITION BY run ORDER BY file) AS BIGINT) "
    "ELSE cast(sum(rows_loaded) OVER (PARTITION BY run) AS BIGINT) END AS total_in_table FROM all_files, (SELECT unnest([1, 2]) AS run))"
)


def _padded(name: str, position: int) -> str:
    """A field of a parsed flat line: lost when the line was cut before it."""
    return f"CASE WHEN fields > {position} THEN {name} ELSE '' END"


_FLAT = ("reporting_period", "pool_prefix", "loan_id", "property_state", "orig_date", "credit_score", "dti", "delinquency_status", "payment_history")


def _sample(name: str, layout: str) -> str:
    if layout == "DI":
        return f"trim({name})"
    return f"trim({name})" if name in ("loan_id", "property_state", "credit_score") else "NULL"


_SAMPLES = ("reporting_period", "pool_prefix", "loan_id", "property_state", "orig_date", "credit_score", "delinquency_status")
LAYOUTS = (
    f"{LINES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY row_key) AS rn, count(*) OVER (PARTITION BY file) AS n FROM lines), "
    # Upper median of the field counts of the non-blank first lines; a line of
    # the row_key % 1009 = 7 kind is blank.
    "head AS (SELECT * FROM numbered WHERE rn <= 20 AND fields > 1), "
    "median AS (SELECT file, list_sort(list(fields))[cast(floor(count(*)/2) AS BIGINT) + 1] AS m, min(rn) AS first_rn FROM head GROUP BY file), "
    "flat AS (SELECT n.file, CASE WHEN m IS NULL THEN 'UNKNOWN' ELSE 'DI' END AS layout, coalesce(m, 0) AS fields_per_row, "
    "coalesce(abs(m - 90) <= 2, FALSE) AS matches_schema, CASE WHEN m IS NULL THEN 0 ELSE n.n END AS total_lines, "
    + ", ".join(f"CASE WHEN m IS NOT NULL THEN {_sample(s, 'DI').replace('trim(', 'trim(h.')} END AS sample_{s}" for s in _SAMPLES)
    + ", CASE WHEN m IS NOT NULL THEN trim(h.orig_interest_rate) END AS sample_orig_interest_rate, "
    "CASE WHEN m IS NULL THEN 'File is empty or unreadable' WHEN abs(m - 90) > 2 THEN concat('Expected 90 fields, found ', cast(m AS VARCHAR), ': schema mismatch') END AS issues "
    "FROM (SELECT file, max(n) AS n FROM numbered GROUP BY file) n LEFT JOIN median md ON md.file = n.file LEFT JOIN head h ON h.file = n.file AND h.rn = md.first_rn), "
    # Record files: 20-lines have 33 fields; their sample is the first 20-line.
    f"rec AS (SELECT {_RECORD_FILE} AS file, row_key, loan_id, property_state, credit_score, "
    "1 + cast(row_key % 1000 = 0 AS INTEGER) + cast(row_key % 19 = 0 AS INTEGER) + cast(row_key % 13 <> 0 AS INTEGER) + cast(row_key % 17 = 0 AS INTEGER) + cast(row_key % 23 = 0 AS INTEGER) AS n_lines FROM raw), "
    "records AS (SELECT file, 'SC' AS layout, 33 AS fields_per_row, TRUE AS matches_schema, cast(sum(n_lines) AS BIGINT) AS total_lines, "
    "NULL AS sample_reporting_period, NULL AS sample_pool_prefix, arg_min(loan_id, row_key) AS sample_loan_id, "
    "trim(arg_min(property_state, row_key)) AS sample_property_state, NULL AS sample_orig_date, trim(arg_min(credit_score, row_key)) AS sample_credit_score, "
    "NULL AS sample_delinquency_status, NULL AS sample_orig_interest_rate, NULL AS issues FROM rec GROUP BY file)"
)

# -- report ----------------------------------------------------------------------------

VINTAGES = f"{LOANS}, vintages AS ({_VINTAGE}), geo AS ({_GEO})"
_EXTREMES = "(SELECT * FROM vintages WHERE loans >= 1000)"
_SEVERITY = f"CASE WHEN dlq_rate_pct > {_AVG_DLQ}*1.5 THEN 'high' WHEN dlq_rate_pct > {_AVG_DLQ} THEN 'medium' ELSE 'low' END"
_HOTSPOTS = f"SELECT *, {_AVG_DLQ} AS avg_dlq FROM geo WHERE dlq_rate_pct > {_AVG_DLQ} AND loans >= 500 ORDER BY dlq_rate_pct DESC, property_state LIMIT "
_CONCENTRATION = (
    f"SELECT cast(sum(loans) AS BIGINT) AS loans, sum(total_upb) AS upb, {_even('sum(actual_dlq_rate*loans)/sum(loans)', 1)} AS avg_dlq "
    "FROM segments WHERE position <= 15"
)
_CURE = "coalesce(max(transition_pct) FILTER (WHERE from_bucket = '30_DPD' AND to_bucket = 'Current'), 0e0)"
_NONE = "cast(NULL AS DOUBLE) AS ratio, cast(NULL AS BIGINT) AS loans, cast(NULL AS DOUBLE) AS upb_billions"
_RECOMMENDATIONS = _union([
    f"SELECT 'Vintage Risk' AS category, cast(orig_year AS VARCHAR) AS subject, dlq_rate_pct AS rate, dlq_rate_pct/nullif({_AVG_DLQ},0) AS ratio, "
    f"loans, upb_billions FROM vintages WHERE dlq_rate_pct > {_AVG_DLQ}*2 AND loans >= 1000",
    f"SELECT 'Geographic Concentration', property_state, dlq_rate_pct, dlq_rate_pct/nullif({_AVG_DLQ},0), loans, cast(NULL AS DOUBLE) "
    f"FROM ({_HOTSPOTS} 3) WHERE dlq_rate_pct > {_AVG_DLQ}*1.5",
    f"SELECT 'Segment Concentration', 'Top 15 segments', avg_dlq, avg_dlq/nullif({_AVG_DLQ},0), loans, upb/1e9 "
    f"FROM ({_CONCENTRATION}) WHERE avg_dlq > {_AVG_DLQ}*3",
    f"SELECT CASE WHEN cure > 75 THEN 'Loss Mitigation Effectiveness' ELSE 'Loss Mitigation Concern' END, '30-DPD cure rate', cure, {_NONE} "
    f"FROM (SELECT {_CURE} AS cure FROM roll) WHERE cure > 75 OR cure < 60",
    f"SELECT 'Risk Scoring Opportunity', 'Top 20% of scores', capture_rate_pct, {_NONE} FROM lift WHERE top_pct = 20",
])


_FILLED = {
    "subject": "subject", "rate": "rate", "one": "format('{:.1f}', rate)", "ratio": "format('{:.1f}', ratio)",
    "loans": "format('{:,}', loans)", "upb": "format('{:.1f}', upb_billions)",
}
_SENTENCES = " ".join(
    f"WHEN {_q(kind)} THEN " + " || ".join(f"coalesce(cast({_FILLED[p]} AS VARCHAR), '')" if n % 2 else _q(p) for n, p in enumerate(re.split("[{}]", text)))
    for kind, text in RECOMMENDATION_TEXTS.items()
)


def _after_loans(cte: str) -> str:
    """The part of a WITH list that follows the shared loans."""
    return cte[len(LOANS):]


def _after_scored(cte: str) -> str:
    return cte[len(SCORED):]


_EVERYTHING = VINTAGES + _after_loans(ROLL) + _after_loans(LIFT) + _after_scored(SEGMENTS)
_METRICS = (
    "tp/nullif(tp+fp,0) AS p, tp/nullif(tp+fn,0) AS r, 2*tp/nullif(2*tp+fp+fn,0) AS f"
)
_CONFUSION = ", ".join(
    f"cast({_n(condition)} AS DOUBLE) AS {name}"
    for name, condition in {
        "tn": "score <= 0.5 AND label = 0", "fp": "score > 0.5 AND label = 0",
        "fn": "score <= 0.5 AND label = 1", "tp": "score > 0.5 AND label = 1",
    }.items()
)
_BOTH = (
    f"{SCORED}, judged AS (SELECT 0 AS position, 'fixed' AS model_name, {_r('area', 4)} AS auc_roc, "
    f"(SELECT {_r('coalesce(tp/nullif(tp+fp,0),0)', 4)} FROM (SELECT {_CONFUSION} FROM scored)) AS precision, "
    f"(SELECT {_r('coalesce(tp/nullif(tp+fn,0),0)', 4)} FROM (SELECT {_CONFUSION} FROM scored)) AS recall FROM ({_auc('score')}) "
    "UNION ALL SELECT 1, 'oracle', 1e0, 1e0, 1e0)"
)
_ERA = "CASE " + " ".join(f"WHEN orig_year BETWEEN {a} AND {b} THEN '{label}'" for a, b, label in TEST_ERAS) + " ELSE 'Other' END"


def _shares(a: str, b: str, names: tuple[str, str], where: str = "TRUE") -> str:
    return (
        f"SELECT {a} AS {names[0]}, {b} AS {names[1]}, count(*) AS loans, "
        f"{_pct('count(*)', f'sum(count(*)) OVER (PARTITION BY {a})', 2)} AS pct FROM loans WHERE {where} GROUP BY 1, 2"
    )


_CODE = f"list_extract([{', '.join(_q(c) for c in STATE_CODES)}], cast(row_key % {len(STATE_CODES)} AS BIGINT) + 1)"
_CORRELATED = _union([
    f"SELECT '{c}' AS feature, {_r(f'abs(corr({c}, is_delinquent))', 6)} AS correlation FROM filled"
    for c in _NUMERIC
] + [f"SELECT 'leaked_status', {_r('abs(corr(is_delinquent*2e0+1, is_delinquent))', 6)} FROM filled"])


def _profile(c: str) -> str:
    zero = " OR current_upb = 0" if c == "current_upb" else ""
    return f"SELECT '{c}' AS column_name, {_pct(_n(f'{c} IS NULL{zero}'), 'count(*)', 3)} AS null_pct, count(*) AS total_rows FROM loans"


SQL: dict[str, str] = {
    # ingestion
    "tape_files": f"WITH {LINES} SELECT DISTINCT replace(file, '_lld', s) AS file FROM lines, (SELECT unnest(['_lld','_LLD']) AS s)",
    "tape_layouts": f"WITH {LAYOUTS} SELECT * FROM flat UNION ALL BY NAME SELECT * FROM records",
    "parse_flat_tape": f"WITH {LINES} SELECT file, {', '.join(_FLAT)}, try_cast(orig_interest_rate AS DOUBLE) AS orig_interest_rate, "
    "try_cast(orig_loan_amount AS DOUBLE) AS orig_loan_amount, try_cast(current_ib_upb AS DOUBLE) AS current_ib_upb, "
    "'' AS relief_refinance, '' AS f90 FROM lines WHERE fields >= 88",
    "flat_rejects": f"WITH {LINES} SELECT file, concat('too_few_fields (', cast(fields AS VARCHAR), ')') AS reason, count(*) AS lines "
    "FROM lines WHERE fields < 88 GROUP BY 1, 2",
    "merge_record_types": f"WITH {RAW} SELECT {_RECORD_FILE} AS file, reporting_period, concat(substring(pool_prefix,1,2),'DNA') AS pool_prefix, loan_id, "
    "CASE WHEN row_key % 17 = 0 THEN 'ZZ' ELSE trim(property_state) END AS property_state, trim(orig_date) AS orig_date, "
    "try_cast(orig_interest_rate AS DOUBLE) AS orig_interest_rate, trim(credit_score) AS credit_score, trim(dti) AS dti, "
    "CASE WHEN row_key % 13 <> 0 THEN trim(delinquency_status) ELSE '09' END AS delinquency_status, payment_history, "
    f"try_cast(current_deferred_upb AS DOUBLE) AS current_deferred_upb, '' AS loan_age, '' AS f90 FROM raw WHERE {_MATCHED}",
    "record_counts": f"WITH {RAW} SELECT {_RECORD_FILE} AS file, {_n(_MATCHED)} AS rows_parsed, {_n('NOT ' + _MATCHED)} AS rows_skipped, "
    f"count(*) AS origination_loans, {_n(_MATCHED)} AS performance_loans, {_n('row_key % 23 = 0')} AS lines_without_loan FROM raw GROUP BY 1",
    "pool_prefixes": f"WITH {TAPE}, ids AS (SELECT CASE WHEN row_key % 3 = 0 THEN concat('A00B0', loan_id) ELSE loan_id END AS loan_id FROM tape) "
    "SELECT loan_id, rtrim(regexp_extract(loan_id, '^(.{0,4}[^0-9]*)', 1), '0') AS pool_prefix FROM ids",
    "sql_text": f"WITH {LOANS} {DEMO_SQL}",
    # cleaning
    "clean_loans": f"WITH {CLEANED} SELECT {_CLEAN_COLUMNS} FROM cleaned",
    "cast_failures": f"WITH {TRIMMED} SELECT * FROM (" + _union([
        f"SELECT '{c}' AS column_name, {_n(f'{c} IS NOT NULL AND ({_number(c)}) IS NULL')} AS failures FROM trimmed" for c in _INTS + _DOUBLES
    ]) + ") WHERE failures > 0",
    "sentinel_counts": f"WITH {TYPED} SELECT * FROM (" + _union([
        f"SELECT '{c}' AS column_name, {_n(f'{c} IN ({codes})')} AS replaced FROM typed"
        for c, codes in {"credit_score": "9999, 0", "current_credit_score": "9999, 0", "dti": "999, 0", "ltv": "999, 0"}.items()
    ]) + ") WHERE replaced > 0",
    "cleaning_null_rates": f"WITH {CLEANED} " + _union([
        f"SELECT '{c}' AS column_name, count(*) AS rows_out, {_pct_even(_n(f'{c} IS NULL'), 'count(*)', 2)} AS null_pct FROM cleaned" for c in _KEY_COLUMNS
    ]),
    # load and export
    "align_columns": f"WITH {LOANS} SELECT loan_id, cast(NULL AS DOUBLE) AS loan_term, cast(NULL AS VARCHAR) AS seller_name, "
    "cast(NULL AS VARCHAR) AS f90, dti, current_upb, is_delinquent FROM loans",
    "replace_partitions": f"WITH {LOANS} SELECT pool_prefix, count(*) AS loans, {_r('sum(current_upb)')} AS total_upb FROM loans "
    "WHERE pool_prefix NOT IN ('95DNA1','98DNA1') OR num_borrowers = 1 GROUP BY pool_prefix",
    "load_manifest": f"WITH {MANIFEST} SELECT * FROM manifest",
    "load_tapes": f"WITH {LOADED} SELECT * FROM loads",
    "load_rejects": f"WITH {LINES} SELECT file, concat('too_few_fields (', cast(fields AS VARCHAR), ')') AS reason, count(*) AS lines FROM lines "
    f"WHERE fields < 88 AND file NOT IN ('{BLANK_FILE}', '{SHORT_FILE}') GROUP BY 1, 2 "
    f"UNION ALL SELECT {_RECORD_FILE}, 'unmatched_origination', count(*) FROM raw WHERE NOT {_MATCHED} GROUP BY 1 "
    f"UNION ALL SELECT {_RECORD_FILE}, 'no_loan_id', count(*) FROM raw WHERE row_key % 23 = 0 GROUP BY 1",
    "load_cleaning": f"WITH {LINES}, usable AS (SELECT file, {', '.join(f'nullif(trim({n}),{_q(str())}) AS {n}' for n in _INTS + _DOUBLES)} FROM lines "
    f"WHERE fields >= 88 AND file NOT IN ('{BLANK_FILE}', '{SHORT_FILE}')) SELECT * FROM (" + _union([
        f"SELECT file, 'cast_failure' AS kind, '{c}' AS column_name, {_n(f'{c} IS NOT NULL AND ({_number(c)}) IS NULL')} AS n FROM usable GROUP BY file" for c in _INTS + _DOUBLES
    ] + [
        f"SELECT file, 'sentinel', '{c}', {_n(f'({_number(c)}) IN ({codes})')} FROM usable GROUP BY file"
        for c, codes in {"credit_score": "9999, 0", "current_credit_score": "9999, 0", "dti": "999, 0", "ltv": "999, 0"}.items()
    ]) + ") WHERE n > 0",
    "manifest_status": f"WITH {LOADED} SELECT status, count(*) AS files FROM loads WHERE run = 1 GROUP BY status",
    "loan_detail": f"WITH {LOANS} SELECT loan_id, pool_prefix, cast(trunc(orig_year) AS INTEGER) AS orig_year, orig_quarter, property_state, credit_score, "
    "credit_score_band, ltv, ltv_bucket, dti, orig_interest_rate, rate_bucket, orig_loan_amount, current_upb, loan_age, channel, property_type, "
    "occupancy_status, loan_purpose, num_borrowers, first_time_homebuyer, dpd_bucket, delinquency_status, is_delinquent, is_seriously_delinquent, "
    "current_credit_score, servicer_name, payment_history FROM loans",
    "exported_csv": f"WITH {LOANS} {_VINTAGE}",
    "exported_json": f"WITH {LOANS} {_GEO}",
    # load validation
    "load_validation": f"WITH {GATES} SELECT * FROM gates",
    "validation_overall": f"WITH {GATES} {_OVERALL} gates",
    "vintage_coverage": f"WITH {LOANS} SELECT orig_year, count(*) AS loans, {_r('sum(current_upb)')} AS total_upb, {_DLQ} AS dlq_rate_pct, "
    f"{_r('avg(credit_score)')} AS avg_fico, {_r('round(avg(orig_interest_rate),9)', 3)} AS avg_rate FROM loans WHERE orig_year IS NOT NULL GROUP BY orig_year",
    "small_pools": f"WITH {LOANS} SELECT pool_prefix AS pool, count(*) AS loans FROM loans GROUP BY 1 HAVING count(*) < {TEST_SMALL_POOL}",
    # portfolio tables
    "null_profile": f"WITH {LOANS} " + _union([_profile(c) for c in _PROFILE]),
    "portfolio_summary": f"WITH {LOANS} {_SUMMARY}",
    "delinquency_distribution": f"WITH {LOANS} {_DPD}",
    "roll_rates": f"WITH {ROLL} SELECT * FROM roll",
    "risk_segmentation": f"WITH {LOANS} {_SEGMENT_SQL}",
    "paydown": f"WITH {LOANS} SELECT cast(trunc(orig_year) AS INTEGER) AS orig_year, rate_bucket, count(*) AS loans, "
    f"{_r('sum(orig_loan_amount)')} AS total_orig_amount, {_r('sum(current_upb)')} AS total_current_upb, "
    f"{_r('sum(orig_loan_amount) - sum(current_upb)')} AS total_paydown, "
    f"{_pct('sum(orig_loan_amount) - sum(current_upb)', 'sum(orig_loan_amount)', 2)} AS paydown_pct, "
    f"{_r('avg(loan_age)')} AS avg_loan_age_months, {_r('round(avg(orig_interest_rate),9)', 3)} AS avg_rate "
    "FROM loans WHERE orig_year IS NOT NULL AND orig_loan_amount > 0 AND current_upb >= 0 GROUP BY orig_year, rate_bucket",
    "vintage_comparison": f"WITH {LOANS} {_VINTAGE}",
    "geographic": f"WITH {LOANS} {_GEO}",
    "site_summary": f"WITH {LOANS} SELECT count(*) AS total_loans, {_r('sum(current_upb)/1e9', 1)} AS upb_billions, {_DLQ} AS dlq_rate, "
    f"{_SERIOUS} AS serious_dlq, {_r('avg(credit_score)')} AS avg_fico, {_r('round(avg(orig_interest_rate),9)', 2)} AS avg_rate, "
    "count(DISTINCT cast(trunc(orig_year) AS INTEGER)) AS vintage_count FROM loans",
    "executive_summary": f"WITH {LOANS} SELECT count(*) AS total_loans, {_r('sum(current_upb)')} AS total_upb, {_DLQ} AS dlq_rate, "
    f"{_SERIOUS} AS serious_dlq_rate, {_r('avg(credit_score)')} AS avg_fico, max(reporting_period) AS reporting_period FROM loans",
    # data-quality report
    "dq_summary": f"WITH {LOANS} SELECT count(*) AS total_loans, {_r('sum(current_upb)')} AS total_upb, count(DISTINCT pool_prefix) AS pools_loaded, "
    "count(DISTINCT property_state) AS states_covered, cast(trunc(min(orig_year)) AS INTEGER) AS earliest_vintage, "
    "cast(trunc(max(orig_year)) AS INTEGER) AS latest_vintage FROM loans",
    "dq_completeness": f"WITH {LOANS} {_COMPLETENESS}",
    "dq_validity": f"WITH {LOANS} {_VALIDITY}",
    "dq_consistency": f"WITH {LOANS} {_CONSISTENCY}",
    "dq_dist_credit": f"WITH {LOANS} SELECT credit_score_band AS band, count(*) AS loans, {_pct('count(*)', 'sum(count(*)) OVER ()', 1)} AS pct "
    "FROM loans WHERE credit_score_band <> 'Unknown' GROUP BY 1",
    "dq_dist_dpd": f"WITH {LOANS} SELECT dpd_bucket AS bucket, count(*) AS loans, {_pct('count(*)', 'sum(count(*)) OVER ()', 2)} AS pct FROM loans GROUP BY 1",
    "dq_dist_vintage": f"WITH {LOANS} SELECT cast(trunc(orig_year) AS INTEGER) AS year, count(*) AS loans, "
    f"{_pct('count(*)', 'sum(count(*)) OVER ()', 1)} AS pct FROM loans WHERE orig_year IS NOT NULL GROUP BY 1",
    "dq_pools": f"WITH {LOANS} SELECT pool_prefix AS pool, count(*) AS loans, CASE WHEN count(*) >= 100 THEN 'PASS' ELSE 'WARN' END AS status FROM loans GROUP BY 1",
    "dq_overall": f"WITH {LOANS} {_OVERALL} (SELECT status FROM ({_COMPLETENESS}) UNION ALL SELECT status FROM ({_VALIDITY}) "
    f"UNION ALL SELECT status FROM ({_CONSISTENCY}))",
    # features
    "feature_matrix": f"WITH {MATRIX} SELECT * FROM matrix",
    "imputed_features": f"WITH {MATRIX} SELECT loan_id, {_imputed(_NUMERIC + _BEHAVIORAL)} FROM matrix",
    "one_hot_features": f"WITH {MATRIX} SELECT loan_id, {_ONE_HOT}, is_first_time_buyer FROM matrix",
    "behavioral_features": f"WITH {MATRIX} SELECT loan_id, {_imputed(_NUMERIC + _BEHAVIORAL)}, {_ONE_HOT}, is_first_time_buyer FROM matrix",
    "scaled_features": f"WITH {MATRIX}, filled AS (SELECT loan_id, {_imputed(_NUMERIC)} FROM matrix), "
    f"train AS (SELECT * FROM filled WHERE loan_age >= {_MEDIAN_AGE}), stats AS (SELECT "
    + ", ".join(f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s" for c in _NUMERIC)
    + " FROM train) SELECT loan_id, "
    + ", ".join(f"{_r(f'({c} - {c}_m)/{c}_s', 5)} AS {c}" for c in _NUMERIC)
    + " FROM train, stats",
    "split_info": f"WITH {MATRIX}, cut AS (SELECT quantile_cont(loan_age, 0.5) AS m FROM matrix) SELECT 'loan_age_median' AS split_method, max(m) AS median_age, "
    f"{_n('loan_age >= m')} AS train_size, {_n('loan_age < m')} AS test_size, "
    f"{_even('avg(is_delinquent) FILTER (WHERE loan_age >= m)', 4)} AS train_dlq_rate, {_even('avg(is_delinquent) FILTER (WHERE loan_age < m)', 4)} AS test_dlq_rate FROM matrix, cut",
    # gates, metrics and scores
    "class_weights": f"WITH {MATRIX} SELECT is_delinquent AS label, count(*) AS loans, (SELECT count(*) FROM matrix)/(2e0*count(*)) AS weight FROM matrix GROUP BY 1",
    "target_check": f"WITH {MATRIX} SELECT {_r('avg(is_delinquent)', 6)} AS target_rate, "
    "CASE WHEN avg(is_delinquent) < 0.001 THEN 'TOO_LOW' WHEN avg(is_delinquent) > 0.5 THEN 'TOO_HIGH' ELSE 'PASS' END AS status FROM matrix",
    "feature_correlations": f"WITH {MATRIX}, filled AS (SELECT is_delinquent, {_imputed(_NUMERIC)} FROM matrix) {_CORRELATED}",
    "leakage_check": f"WITH {MATRIX}, filled AS (SELECT is_delinquent, {_imputed(_NUMERIC)} FROM matrix) "
    f"SELECT feature, {_even('correlation', 4)} AS correlation FROM ({_CORRELATED}) WHERE correlation >= 0.95",
    "split_check": f"WITH {MATRIX}, sides AS (SELECT CASE WHEN loan_age >= {_MEDIAN_AGE} THEN 'train' ELSE 'test' END AS split, is_delinquent FROM matrix) "
    "SELECT split, cast(sum(is_delinquent) AS BIGINT) AS positives, CASE WHEN sum(is_delinquent) >= 50 THEN 'PASS' ELSE 'FAIL' END AS status FROM sides GROUP BY split",
    "auc": f"WITH {SCORED} SELECT {_even('area', 4)} AS auc_roc FROM ({_auc('score')})",
    "classification_metrics": f"WITH {SCORED} SELECT {_even('coalesce(p,0)', 4)} AS precision, {_even('coalesce(r,0)', 4)} AS recall, {_even('coalesce(f,0)', 4)} AS f1_score, "
    "cast(tn AS BIGINT) AS true_negatives, cast(fp AS BIGINT) AS false_positives, cast(fn AS BIGINT) AS false_negatives, cast(tp AS BIGINT) AS true_positives "
    f"FROM (SELECT *, {_METRICS} FROM (SELECT {_CONFUSION} FROM scored))",
    "lift_table": f"WITH {LIFT} SELECT * FROM lift",
    "lift_curve": f"WITH {LIFT} SELECT 0 AS top_pct, 0e0 AS capture_rate_pct UNION ALL SELECT top_pct, capture_rate_pct FROM lift",
    "score_stats": f"WITH {SCORED} SELECT count(*) AS loans, {_r('avg(score)', 4)} AS mean_score, {_r('quantile_cont(score, 0.5)', 4)} AS median_score, "
    f"{_r('quantile_cont(score, 0.95)', 4)} AS p95_score FROM scored",
    **{
        name: f"WITH {MATRIX} SELECT '{model}' AS model_name, count(*) AS test_loans, cast(sum(is_delinquent) AS BIGINT) AS positives, "
        f"TRUE AS measures_possible FROM matrix WHERE loan_age < {_MEDIAN_AGE}"
        for name, model in {
            "origination_regression": "logistic_regression", "origination_forest": "random_forest", "origination_boosting": "gradient_boosting",
        }.items()
    },
    "saved_model": f"WITH {MATRIX} SELECT count(*) AS loans, 0e0 AS largest_difference FROM matrix",
    "behavioral_segments": f"WITH {SEGMENTS} SELECT * EXCLUDE (position, avg_risk_score) FROM segments",
    "rank_segments": f"WITH {SEGMENTS} SELECT * FROM segments",
    "post_training_check": f"WITH {_BOTH} SELECT model_name, auc_roc, auc_roc >= 0.99 AS auc_flag, precision = 1 AS perfect_precision, recall = 1 AS perfect_recall, "
    "CASE WHEN auc_roc >= 0.999 THEN 'LEAKAGE_CONFIRMED' WHEN auc_roc >= 0.99 THEN 'LEAKAGE_SUSPECTED' ELSE 'healthy' END AS diagnosis FROM judged",
    "best_model": f"WITH {_BOTH} SELECT model_name, auc_roc FROM judged ORDER BY auc_roc DESC, position LIMIT 1",
    # report and dashboard
    "vintage_extremes": f"WITH {VINTAGES} SELECT (SELECT orig_year FROM {_EXTREMES} ORDER BY dlq_rate_pct DESC, orig_year LIMIT 1) AS worst_year, "
    f"(SELECT max(dlq_rate_pct) FROM {_EXTREMES}) AS worst_dlq_pct, (SELECT orig_year FROM {_EXTREMES} ORDER BY dlq_rate_pct, orig_year LIMIT 1) AS best_year, "
    f"(SELECT min(dlq_rate_pct) FROM {_EXTREMES}) AS best_dlq_pct",
    "dpd_chart": f"WITH {LOANS}, dist AS ({_DPD}) SELECT dpd_bucket AS label, loans, CASE dpd_bucket "
    + " ".join(f"WHEN '{b}' THEN '{c}'" for b, c in BUCKET_COLOURS.items())
    + " ELSE '#95a5a6' END AS colour, concat(cast(pct_of_portfolio AS VARCHAR), '%') AS text FROM dist",
    "roll_matrix": f"WITH {ROLL} SELECT from_bucket, "
    + ", ".join(f"coalesce(max(transition_pct) FILTER (WHERE to_bucket = '{c}'), 0e0) AS \"to_{c}\"" for c in ("Current", "30_DPD", "60_DPD", "90_DPD", "120_Plus"))
    + " FROM roll GROUP BY from_bucket",
    "cure_rate": f"WITH {ROLL} SELECT {_CURE} AS cure_rate_30 FROM roll",
    "geo_hotspots": f"WITH {VINTAGES} {_HOTSPOTS} 12",
    "hotspot_severity": f"WITH {VINTAGES} SELECT property_state, dlq_rate_pct, CASE WHEN dlq_rate_pct > avg_dlq*1.5 THEN 'high' ELSE 'medium' END AS severity FROM ({_HOTSPOTS} 12)",
    "headline": f"WITH {VINTAGES}, worst AS (SELECT * FROM {_EXTREMES} ORDER BY dlq_rate_pct DESC, orig_year LIMIT 1), "
    f"book AS (SELECT count(*) AS n, round(sum(current_upb)/1e9,9) AS upb, {_DLQ} AS rate FROM loans) "
    "SELECT 'Portfolio delinquency stands at ' || b.rate || '%' || coalesce(' across ' || format('{:,}', b.n) || ' loans ($' || format('{:.1f}', b.upb) || 'B UPB). The ' "
    "|| cast(w.orig_year AS INTEGER) || ' vintage is the highest-risk cohort at ' || w.dlq_rate_pct || '% delinquency — ' "
    "|| format('{:.1f}', w.dlq_rate_pct/b.rate) || 'x the portfolio average.', '.') AS headline FROM book b LEFT JOIN worst w ON TRUE",
    "recommendation_text": f"WITH {_EVERYTHING} SELECT category, CASE category {_SENTENCES} END AS text FROM ({_RECOMMENDATIONS})",
    "segment_page": f"WITH {SEGMENTS} SELECT *, CASE WHEN actual_dlq_rate > 5 THEN 'high' WHEN actual_dlq_rate > 2 THEN 'medium' ELSE 'none' END AS severity "
    "FROM segments WHERE position <= 15",
    "segment_concentration": f"WITH {SEGMENTS} {_CONCENTRATION}",
    "recommendations": f"WITH {_EVERYTHING} {_RECOMMENDATIONS}",
    "vintage_severity": f"WITH {VINTAGES} SELECT orig_year, loans, dlq_rate_pct, {_SEVERITY} AS severity FROM vintages",
    "roll_severity": f"WITH {ROLL} SELECT from_bucket, to_bucket, transition_pct, CASE WHEN to_bucket = 'Current' AND transition_pct > 70 THEN 'low' "
    "WHEN to_bucket <> 'Current' AND transition_pct > 10 THEN 'high' WHEN transition_pct > 5 THEN 'medium' ELSE 'none' END AS severity FROM roll",
    "band_ltv_heatmap": f"WITH {LOANS} SELECT credit_score_band, "
    + ", ".join(
        f"{_pct(f'sum(is_delinquent) FILTER (WHERE ltv_bucket = {_q(label)})', _n(f'ltv_bucket = {_q(label)}'), 2)} AS {_slug(label)}"
        for _, _, label in DEFAULT.ltv_buckets
    )
    + " FROM loans WHERE credit_score_band <> 'Unknown' AND ltv_bucket <> 'Unknown' GROUP BY 1",
    "dlq_by_band": f"WITH {LOANS} SELECT credit_score_band, count(*) AS loans, {_DLQ} AS dlq_rate_pct FROM loans WHERE credit_score_band <> 'Unknown' GROUP BY 1",
    "seasoning_curve": f"WITH {LOANS} SELECT {_ERA} AS era, cast(trunc(loan_age) AS INTEGER) AS loan_age, count(*) AS loans, {_DLQ} AS dlq_rate_pct "
    "FROM loans WHERE loan_age IS NOT NULL GROUP BY 1, 2",
    "rate_by_vintage": f"WITH {LOANS} " + _shares("cast(trunc(orig_year) AS INTEGER)", "rate_bucket", ("orig_year", "rate_bucket"), "orig_year IS NOT NULL"),
    "score_by_status": f"WITH {LOANS} " + _shares("dpd_bucket", "credit_score_band", ("dpd_bucket", "credit_score_band")),
    "top_segments": f"WITH {LOANS} {_SEGMENT_SQL} ORDER BY dlq_rate_pct DESC, credit_score_band, ltv_bucket, rate_bucket, orig_year LIMIT 15",
    "filtered_vintages": f"WITH {LOANS}, part AS (SELECT * FROM loans WHERE credit_score_band = 'Good (680-719)' AND property_type = 'SF') "
    f"SELECT cast(trunc(orig_year) AS INTEGER) AS orig_year, count(*) AS loans, {_pct('sum(is_delinquent)', 'count(*)', 2)} AS dlq_rate_pct, "
    f"{_r('sum(current_upb)/1e9', 2)} AS upb_billions, (SELECT {_pct('sum(is_delinquent)', 'count(*)', 2)} FROM part) AS avg_dlq "
    "FROM part WHERE orig_year IS NOT NULL GROUP BY orig_year",
    "filtered_states": f"WITH {LOANS}, part AS (SELECT * FROM loans WHERE orig_year = 1998 AND property_type = 'SF') "
    f"SELECT property_state, count(*) AS loans, {_pct('sum(is_delinquent)', 'count(*)', 2)} AS dlq_rate_pct, "
    f"{_r('sum(current_upb)/1e9', 3)} AS upb_billions, (SELECT {_pct('sum(is_delinquent)', 'count(*)', 2)} FROM part) AS avg_dlq "
    "FROM part WHERE property_state IS NOT NULL GROUP BY property_state",
    "filtered_cure_rate": f"WITH {LOANS}, months AS (SELECT substring(payment_history, p, 1) AS was, substring(payment_history, p + 1, 1) AS became "
    "FROM loans, generate_series(37, 47) AS g(p) WHERE length(payment_history) >= 48 AND orig_year = 1998 AND credit_score_band = 'Good (680-719)') "
    f"SELECT coalesce({_pct(_n("became = '0'"), 'count(*)', 2)}, 0e0) AS cure_rate_30 FROM months WHERE was = '1' AND became BETWEEN '0' AND '9'",
    "filtered_summary": f"WITH {LOANS} {_SUMMARY} WHERE orig_year = 1998 AND credit_score_band = 'Good (680-719)' AND property_type = 'SF'",
    "state_names": f"WITH {TAPE}, coded AS (SELECT {_CODE} AS property_state FROM tape) SELECT property_state, CASE property_state "
    + " ".join(f"WHEN '{k}' THEN {_q(v)}" for k, v in STATE_NAMES.items())
    + " END AS state_name, count(*) AS loans FROM coded GROUP BY 1",
}
