"""The same relations in ANSI SQL for an independent engine: common table expressions and how values are written."""

from __future__ import annotations


def ratio(a: str, b: str, places: int, scale: int = 10000) -> str:
    """a / b rounded half up in whole numbers; a and b are decimals of the given scale, b > 0."""
    n, d = f"CAST({a} * {scale} AS HUGEINT)", f"CAST({b} * {scale} AS HUGEINT)"
    half = f"(2 * abs({n}) * {10**places} + {d}) // (2 * {d})"
    return f"(CASE WHEN {n} < 0 THEN -({half}) ELSE {half} END) / CAST({10**places} AS DOUBLE)"


def bill(total: str) -> str:
    """Bill columns over relation j with consumption_kwh, solar_kwh and tariff columns."""
    money = lambda x: f"CAST(round({x}, 2) AS DECIMAL(12,2))"
    own = "least(consumption_kwh, solar_kwh)"
    bought, sold = f"(consumption_kwh - {own})", f"(solar_kwh - {own})"
    kwh = [f"CAST(least({bought}, 60) AS DECIMAL(12,4))", f"CAST(least(greatest({bought} - 60, 0), 60) AS DECIMAL(12,4))", f"CAST(greatest({bought} - 120, 0) AS DECIMAL(12,4))"]
    charge = [money(f"{k} * block_{i}_rate") for i, k in enumerate(kwh, 1)]
    energy = f"CAST({' + '.join(charge)} AS DECIMAL(12,2))"
    subsidy = f"CASE WHEN subsidy_flag THEN {money(f'{energy} * subsidy_pct * CAST(0.01 AS DECIMAL(3,2))')} ELSE CAST(0 AS DECIMAL(12,2)) END"
    credit = money(f"{sold} * export_rate")
    parts = ", ".join(f"{k} AS kwh_{i}, {c} AS charge_{i}" for i, (k, c) in enumerate(zip(kwh, charge), 1))
    return f"""CAST({own} AS DECIMAL(12,4)) AS self_consumed_kwh, CAST({bought} AS DECIMAL(12,4)) AS billable_import_kwh, CAST({sold} AS DECIMAL(12,4)) AS export_kwh,
        {energy} AS energy_charge, {subsidy} AS subsidy_amount, {credit} AS export_credit, CAST({energy} + fixed_charge - {subsidy} - {credit} AS DECIMAL(12,2)) AS {total}, {parts}"""


_SUMS = "CAST(sum(consumption_kwh) AS DECIMAL(12,4)) AS consumption_kwh, CAST(sum(solar_generation_kwh) AS DECIMAL(12,4)) AS solar_kwh"
_TARIFF = """household_id, sim_date AS effective_date, billing_tier, subsidy_flag, CAST(25.00 AS DECIMAL(5,2)) AS subsidy_pct,
    CAST(CASE billing_tier WHEN 'TIER_1' THEN 120 WHEN 'TIER_2' THEN 240 ELSE 480 END AS DECIMAL(12,2)) AS fixed_charge,
    CAST(8.00 + CASE WHEN (date_diff('day', DATE '1970-01-01', sim_date) + 719163) % 2 = 0 THEN 0.50 ELSE 0 END AS DECIMAL(12,2)) AS block_1_rate,
    CAST(16.50 AS DECIMAL(12,2)) AS block_2_rate, CAST(24.50 AS DECIMAL(12,2)) AS block_3_rate, CAST(18.00 AS DECIMAL(12,2)) AS export_rate"""
_RATES = "billing_tier, subsidy_flag, subsidy_pct, fixed_charge, block_1_rate, block_2_rate, block_3_rate, export_rate"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY meter_id, event_ts ORDER BY ingest_ts, event_id) = 1"
_REASON = """CASE WHEN household_id = '' OR meter_id IS NULL OR event_ts IS NULL OR consumption_kwh IS NULL THEN 'null_field'
    WHEN consumption_kwh < 0 OR solar_generation_kwh < 0 THEN 'negative_kwh' WHEN household_id NOT IN (SELECT household_id FROM roster) THEN 'unknown_household'
    WHEN grid_zone NOT IN ('ZONE-A', 'ZONE-B', 'ZONE-C', 'ZONE-D', 'ZONE-E') THEN 'unknown_zone'
    WHEN event_ts NOT BETWEEN TIMESTAMP '2023-01-01 00:00:00' AND TIMESTAMP '2073-12-31 23:59:59' THEN 'event_ts_out_of_range' END"""
_RATIO = "CASE WHEN {c} > 0 THEN least(" + ratio("{s}", "{c}", 4) + ", 1.0) ELSE 0.0 END"
_STEPS = """(SELECT d, sim_date, '1' AS run, 0 AS seq, 'running' AS status FROM open_days UNION ALL
    SELECT d, sim_date, '1', 1, CASE WHEN d % 7 = 3 THEN 'failed' ELSE 'success' END FROM closed UNION ALL
    SELECT d, sim_date, '2', 2, 'running' FROM closed WHERE d % 7 = 3 UNION ALL SELECT d, sim_date, '2', 3, 'success' FROM closed WHERE d % 7 = 3 UNION ALL
    SELECT d, sim_date, '9', 4, 'running' FROM closed WHERE d % 5 = 0 UNION ALL
    SELECT d, sim_date, CASE WHEN d % 7 = 3 THEN '2' ELSE '1' END, 5, 'superseded' FROM closed WHERE d % 5 = 0 UNION ALL
    SELECT d, sim_date, '9', 6, 'success' FROM closed WHERE d % 5 = 0)"""

RELATIONS = {
    "readings": """SELECT event_id, user_id, printf('MTR-%04d', user_id + 1) AS meter_id, printf('HH-%04d', user_id + 1) AS household_id, 'ZONE-' || chr(CAST(65 + user_id % 5 AS INTEGER)) AS grid_zone,
        ts AS event_ts, CAST(value AS DECIMAL(12,4)) AS consumption_kwh,
        CASE WHEN (user_id + 1) % 3 = 0 THEN CAST(CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DECIMAL(8,0)) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(12,4)) ELSE CAST(0 AS DECIMAL(12,4)) END AS solar_generation_kwh FROM events""",
    "roster": """SELECT DISTINCT user_id, household_id, meter_id, grid_zone, 'TIER_' || CAST(user_id % 3 + 1 AS VARCHAR) AS billing_tier, (user_id + 1) % 4 = 0 AS subsidy_flag, (user_id + 1) % 3 = 0 AS has_solar FROM readings""",
    "days": "SELECT CAST(unnest(generate_series(lo - INTERVAL 1 DAY, hi, INTERVAL 1 DAY)) AS DATE) AS sim_date FROM (SELECT date_trunc('day', min(event_ts)) AS lo, date_trunc('day', max(event_ts)) AS hi FROM readings)",
    "open_days": "SELECT sim_date, row_number() OVER (ORDER BY sim_date) - 1 AS d FROM days WHERE sim_date > (SELECT min(sim_date) FROM days)",
    "closed": "SELECT * FROM open_days WHERE d < (SELECT max(d) FROM open_days)",
    "tariff_all": f"SELECT {_TARIFF} FROM roster CROSS JOIN days",
    "tariff": f"SELECT {_TARIFF} FROM roster CROSS JOIN open_days",
    "raw": """SELECT event_id, meter_id, CASE WHEN event_id % 100 = 1 THEN '' WHEN event_id % 200 = 5 THEN 'HH-9999' ELSE household_id END AS household_id,
        CASE WHEN event_id % 500 = 7 THEN 'ZONE-Z' ELSE grid_zone END AS grid_zone, t AS event_ts, t + to_seconds(late + CASE WHEN event_id % 40 = 11 THEN 2700 ELSE 0 END) AS ingest_ts,
        CASE WHEN event_id % 200 = 3 THEN CAST(-(consumption_kwh + 1) AS DECIMAL(12,4)) ELSE consumption_kwh END AS consumption_kwh, solar_generation_kwh
        FROM (SELECT *, CASE WHEN event_id % 500 = 9 THEN event_ts - INTERVAL 25 YEAR ELSE event_ts END AS t FROM readings) CROSS JOIN (SELECT unnest([0, 5]) AS late) WHERE late = 0 OR event_id % 50 = 0""",
    "marked": f"SELECT *, {_REASON} AS reason FROM raw",
    "deduped": f"SELECT * FROM raw {_FIRST}",
    "batch_valid": f"SELECT * FROM (SELECT *, {_REASON} AS reason FROM deduped) WHERE reason IS NULL",
    "totals": f"SELECT household_id, CAST(event_ts AS DATE) AS sim_date, {_SUMS}, count(*) AS readings_count FROM batch_valid GROUP BY 1, 2",
    "every": "SELECT t.household_id, t.effective_date AS sim_date, coalesce(d.consumption_kwh, 0) AS consumption_kwh, coalesce(d.solar_kwh, 0) AS solar_kwh, coalesce(d.readings_count, 0) AS readings_count, t.* EXCLUDE (household_id) FROM tariff t LEFT JOIN totals d ON d.household_id = t.household_id AND d.sim_date = t.effective_date",
    "bills": f"SELECT *, effective_date AS tariff_effective_date, {bill('final_bill')} FROM every",
    "speed_valid": f"SELECT * FROM (SELECT * FROM marked WHERE reason IS NULL {_FIRST}) WHERE ingest_ts <= event_ts + INTERVAL 30 MINUTE",
    "speed_totals": f"SELECT household_id, CAST(event_ts AS DATE) AS sim_date, {_SUMS}, count(*) AS readings_count FROM speed_valid GROUP BY 1, 2",
    "speed_bills": f"SELECT *, {bill('estimated_bill')} FROM (SELECT s.*, t.* EXCLUDE (household_id, effective_date), t.effective_date AS tariff_source_date FROM speed_totals s JOIN tariff_all t ON t.household_id = s.household_id AND t.effective_date = s.sim_date - 1)",
    "w": "SELECT grid_zone, time_bucket(INTERVAL '15 minutes', event_ts) AS window_start, CAST(sum(consumption_kwh) AS DECIMAL(12,4)) AS c, CAST(sum(solar_generation_kwh) AS DECIMAL(12,4)) AS s, count(DISTINCT meter_id) AS active_meters, max(event_ts) AS last_event_ts FROM speed_valid GROUP BY 1, 2",
    "windows": f"SELECT grid_zone, window_start, window_start + INTERVAL 15 MINUTE AS window_end, c AS total_consumption_kwh, s AS total_solar_kwh, {_RATIO.format(c='c', s='s')} AS renewable_ratio, active_meters, last_event_ts, TIMESTAMP '2024-06-01 00:00:00' + to_seconds(CAST(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', window_start + INTERVAL 15 MINUTE) // 288 AS BIGINT)) AS updated_at FROM w",
    "hday": "SELECT grid_zone, CAST(event_ts AS DATE) AS sim_date, household_id, sum(consumption_kwh) AS c, sum(solar_generation_kwh) AS s, count(DISTINCT meter_id) AS m, count(*) AS n FROM batch_valid GROUP BY 1, 2, 3",
    "bw": "SELECT grid_zone, CAST(event_ts AS DATE) AS sim_date, time_bucket(INTERVAL '15 minutes', event_ts) AS window_start, CAST(sum(consumption_kwh) AS DECIMAL(12,4)) AS c FROM batch_valid GROUP BY 1, 2, 3",
    "peaks": "SELECT grid_zone, sim_date, window_start AS peak_window_start, c AS peak_consumption_kwh FROM bw QUALIFY row_number() OVER (PARTITION BY grid_zone, sim_date ORDER BY c DESC, window_start) = 1",
    "zone_days": f"""SELECT *, {_RATIO.format(c='total_consumption_kwh', s='total_solar_kwh')} AS renewable_ratio FROM (SELECT grid_zone, sim_date, CAST(sum(c) AS DECIMAL(12,4)) AS total_consumption_kwh, CAST(sum(s) AS DECIMAL(12,4)) AS total_solar_kwh,
        CAST(sum(c - least(c, s)) AS DECIMAL(12,4)) AS total_import_kwh, CAST(sum(s - least(c, s)) AS DECIMAL(12,4)) AS total_export_kwh, sum(m) AS active_meters, sum(n) AS readings_count FROM hday GROUP BY 1, 2) JOIN peaks USING (grid_zone, sim_date)""",
    "priced": f"SELECT *, {bill('own_total')} FROM (SELECT s.household_id, s.sim_date, s.consumption_kwh, s.solar_kwh, s.estimated_bill, t.* EXCLUDE (household_id, effective_date) FROM speed_bills s JOIN tariff t ON t.household_id = s.household_id AND t.effective_date = s.sim_date)",
    "reconciled": f"""SELECT p.household_id, p.sim_date, p.estimated_bill AS speed_estimate, b.final_bill AS batch_final, abs(p.estimated_bill - b.final_bill) AS abs_divergence,
        CASE WHEN b.energy_charge + b.fixed_charge = 0 THEN 0.0 ELSE least({ratio('abs(p.estimated_bill - b.final_bill) * 100', '(b.energy_charge + b.fixed_charge)', 3, 100)}, 999.999) END AS pct_divergence,
        p.estimated_bill - p.own_total AS tariff_effect, p.own_total - b.final_bill AS data_effect FROM priced p JOIN bills b USING (household_id, sim_date)""",
    "ledger_events": f"SELECT 'run-' || CAST(sim_date AS VARCHAR) || '-' || run AS run_id, d, sim_date, 'batch' AS layer, seq, status, CASE WHEN status <> 'running' THEN 1000 + d END AS rows_in, CASE WHEN status <> 'running' THEN 100 + d END AS rows_out, TIMESTAMP '2024-06-01 00:05:00' + to_seconds(CAST(d * 300 + seq * 10 AS BIGINT)) AS moment, run FROM {_STEPS}",
    "runs": "SELECT run_id, sim_date, layer, min(moment) AS started_at, arg_max(status, seq) AS status, max(rows_in) AS rows_in, max(rows_out) AS rows_out, CASE WHEN arg_max(status, seq) <> 'running' THEN max(moment) END AS finished_at FROM ledger_events GROUP BY 1, 2, 3",
    "history": f"SELECT *, {bill('final_bill')} FROM (SELECT e.* REPLACE (CAST(CASE WHEN l.run = '9' THEN block_1_rate + 1 ELSE block_1_rate END AS DECIMAL(12,2)) AS block_1_rate), l.run_id FROM every e JOIN ledger_events l ON l.sim_date = e.sim_date AND l.status = 'success')",
    "finalised": "SELECT DISTINCT sim_date FROM runs WHERE status = 'success'",
}


def sql(columns: str, source: str, more: dict[str, str] | None = None) -> str:
    """A query over the relations. Each column is a name or 'name=expression', with a kind after a colon: n a
    double, i a whole number, t a time, d a date, none as it is."""
    parts = []
    for column in columns.split("; "):
        name, _, expression = column.partition("=")
        name, _, kind = name.partition(":")
        expression = expression or name
        wrap = {"n": "CAST({} AS DOUBLE)", "i": "CAST({} AS BIGINT)", "t": "strftime({}, '%Y-%m-%d %H:%M:%S.%f')", "d": "CAST({} AS VARCHAR)", "": "{}"}[kind.strip()]
        parts.append(f"{wrap.format(expression.strip())} AS {name.strip()}")
    relations = {**RELATIONS, **(more or {})}
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in relations.items()) + f"\nSELECT {', '.join(parts)} FROM {source}"
