"""The registered queries as SQL for DuckDB over the base tables.

The shared sub-selects are written once; every text puts the ones it needs into a WITH clause.
"""

from __future__ import annotations

from ..functions.scalars import QUANTILE_MIDDLE, QUANTILE_TAIL, QUANTILE_TAIL_BELOW

PATIENT = """
SELECT CombinedID, CombinedicuID, icuByDummy, Year, DiagID2, AdmCatID, Gender, ApacheIIScore, Age, BMI,
  inMV2_4, Propofol2_4, OralIntake2_4, PN2_4, EN2_4, PatientDied, 1 - PatientDied AS PatientDischarged,
  Surv0To60, Disc0To60,
  CASE WHEN PatientDied = 1 THEN LEAST(mv_raw, Surv0To60) ELSE mv_raw END AS DaysMechVent,
  CASE WHEN PatientDied = 1 THEN Surv0To60 ELSE Disc0To60 END AS event,
  LEAST(icu_raw, CASE WHEN PatientDied = 1 THEN Surv0To60 ELSE Disc0To60 END) AS DaysInICU
FROM (
  SELECT o_orderkey AS CombinedID, c_nationkey AS CombinedicuID, 1 AS icuByDummy,
    CAST(year(o_orderdate) AS VARCHAR) AS Year, o_orderpriority AS DiagID2,
    CASE o_orderstatus WHEN 'F' THEN 'Medical' WHEN 'O' THEN 'Surgical/Elective'
      ELSE 'Surgical/Emeregency' END AS AdmCatID,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'Male' ELSE 'Female' END AS Gender,
    k % 41 AS ApacheIIScore, 18 + CAST(floor(k / 7) AS BIGINT) % 73 AS Age,
    CAST(150 + CAST(floor(k / 3) AS BIGINT) % 300 AS DOUBLE) / 10 AS BMI,
    o_orderkey % 4 AS inMV2_4, CAST(floor(o_orderkey / 4) AS BIGINT) % 4 AS Propofol2_4,
    CAST(floor(o_orderkey / 16) AS BIGINT) % 4 AS OralIntake2_4,
    CAST(floor(o_orderkey / 64) AS BIGINT) % 4 AS PN2_4, o_custkey % 4 AS EN2_4,
    CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS PatientDied,
    CASE WHEN k % 4 = 0 THEN 1 + CAST(floor(k / 4) AS BIGINT) % 60 ELSE 61 END AS Surv0To60,
    CASE WHEN k % 4 = 0 THEN NULL ELSE 2 + CAST(floor(k / 5) AS BIGINT) % 59 END AS Disc0To60,
    (o_orderkey * 7 + o_custkey * 3) % 66 AS mv_raw, (o_orderkey * 5 + o_custkey) % 80 AS icu_raw
  FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS k FROM orders) o
  JOIN customer ON o_custkey = c_custkey) s"""

DAILY = """
SELECT CombinedID, Study_Day, incomplete_day, EN, PN, OralIntake, proteinGproKG, calproKg,
  proteinAdjustedPercentage,
  CASE WHEN proteinGproKG >= 0.8 AND proteinGproKG <= 1.2 THEN 1 ELSE 0 END AS proteinCat2,
  CASE WHEN proteinGproKG > 1.2 THEN 1 ELSE 0 END AS proteinCat3
FROM (
  SELECT l_orderkey AS CombinedID,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey,
      l_linenumber, l_quantity, l_extendedprice) AS INT) AS Study_Day,
    l_linenumber = 7 AS incomplete_day, l_partkey % 2 AS EN,
    CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS PN, l_linenumber % 2 AS OralIntake,
    CASE WHEN l_returnflag = 'R' AND l_quantity < 10 THEN 0.0 ELSE l_quantity END / 32 AS proteinGproKG,
    l_quantity / 2 AS calproKg,
    CASE WHEN l_returnflag = 'R' AND l_quantity < 10 THEN 0.0 ELSE l_quantity END * 2
      AS proteinAdjustedPercentage
  FROM lineitem) d"""

COHORT = """
SELECT *, CASE WHEN mv_status = 2 THEN 1 WHEN mv_status IS NOT NULL THEN 0 END AS delta_1,
  CASE WHEN mv_status = 1 THEN 1 WHEN mv_status IS NOT NULL THEN 0 END AS delta_2,
  CASE mv_status WHEN 1 THEN DaysMechVent WHEN 2 THEN Surv0To60 WHEN 0 THEN 61 END AS event_time
FROM (SELECT *, CASE WHEN DaysMechVent >= 60 OR DaysMechVent > Disc0To60 THEN 0
   WHEN DaysMechVent <= Disc0To60 OR DaysMechVent < Surv0To60 THEN 1
   WHEN DaysMechVent >= Surv0To60 THEN 2 END AS mv_status FROM patient WHERE DaysMechVent <> 0) c
WHERE mv_status IS NOT NULL"""

FITTED = """
SELECT *, CASE WHEN BMI < 18.5 THEN 'bmi<18.5' WHEN BMI > 30 THEN 'bmi>30' ELSE 'bmi18.5-30' END AS bmi_cat,
  CASE WHEN PN2_4 IN (0, 1) THEN 'pn01' ELSE 'pn23' END AS pn_bin
FROM cohort WHERE event_time >= 5 AND CombinedID IN (SELECT CombinedID FROM daily)"""

PED = """
SELECT c.*, CAST(d AS INT) AS tend, CAST(d - 1 AS INT) AS tstart, d - 0.5 AS int_mid,
  CASE WHEN event_time <= d THEN delta_1 ELSE 0 END AS ped_status_1,
  CASE WHEN event_time <= d THEN delta_2 ELSE 0 END AS ped_status_2
FROM fitted c JOIN range(5, 61) g(d) ON d - 1 < event_time"""

LAST = """
SELECT * FROM ped QUALIFY row_number() OVER (PARTITION BY CombinedID ORDER BY tend DESC) = 1"""

KEPT_DAILY = "SELECT * FROM daily WHERE CombinedID IN (SELECT CombinedID FROM fitted)"

LAG_LEAD = """
SELECT t, tz, CASE WHEN t >= tz + 4 AND t <= tz * 3 + 10 THEN 1 ELSE 0 END AS LL
FROM range(0, 61) a(t), range(1, 12) b(tz)"""

# B-spline values by truncated powers; the arguments are SQL expressions.
def bspline(x: str, lo: str, hi: str, k: str, i: str) -> str:
    xl = f"(({lo}) - 0.001 * (({hi}) - ({lo})))"
    width = f"(1.002 * (({hi}) - ({lo})))"
    v = f"((({x}) - {xl}) / ({width} / (({k}) - 3)) - ({i}) + 3)"
    parts = [f"({c}) * power(greatest({v} - {r}, 0), 3)" for r, c in enumerate((1, -4, 6, -4, 1))]
    return "((" + " + ".join(parts) + ") / 6)"


SHARED = {
    "patient": (PATIENT, []),
    "daily": (DAILY, []),
    "cohort": (COHORT, ["patient"]),
    "fitted": (FITTED, ["cohort", "daily"]),
    "ped": (PED, ["fitted"]),
    "last": (LAST, ["ped"]),
    "kept_daily": (KEPT_DAILY, ["daily", "fitted"]),
    "lag_lead": (LAG_LEAD, []),
}


def with_shared(names: list[str], body: str) -> str:
    """``WITH a AS (...), ... body`` with the named sub-selects and what they need."""
    order: list[str] = []

    def visit(name):
        for need in SHARED[name][1]:
            visit(need)
        if name not in order:
            order.append(name)
    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({SHARED[n][0]})" for n in order)
    return f"WITH {ctes}\n{body}"


def strata_sql(source: str, strata: list[str], outcome: str) -> str:
    parts = [f"SELECT '{s}' AS variable, CAST({s} AS VARCHAR) AS level, {outcome} AS outcome FROM {source}"
             for s in strata]
    return f"""SELECT variable, level, count(*) AS n,
  round(100 * count(*) / (SELECT count(*) FROM {source}), 6) AS percent,
  round(100 * avg(outcome), 6) AS outcome_percent
FROM ({' UNION ALL '.join(parts)}) u WHERE level IS NOT NULL GROUP BY variable, level"""


def six_sql(source: str, cols: list[str], by: str | None = None) -> str:
    key = f"{by}, " if by else ""
    parts = [f"""SELECT {key}'{c}' AS variable, count({c}) AS n, CAST(min({c}) AS DOUBLE) AS min_value,
  CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q1_value, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS median_value,
  round(avg({c}), 6) AS mean_value, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q3_value,
  CAST(max({c}) AS DOUBLE) AS max_value, count(*) - count({c}) AS n_missing
FROM {source}{' GROUP BY ' + by if by else ''}""" for c in cols]
    return "\nUNION ALL\n".join(parts)


TEN_STRATA = ["Year", "Gender", "mv_hours", "OralIntake2_4", "inMV2_4", "Propofol2_4", "PN2_4", "EN2_4",
              "AdmCatID", "DiagID2"]
MV_HOURS = """(SELECT *, CASE WHEN DaysMechVent * 24 >= 0 AND DaysMechVent * 24 <= 24 THEN '[0,24]'
  WHEN DaysMechVent * 24 <= 48 THEN '(24,48]' WHEN DaysMechVent * 24 > 48 THEN '(48,max]' END AS mv_hours
  FROM fitted)"""
STAT_TEXT = "CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def _num(x: str) -> str:
    return STAT_TEXT.format(x=f"({x})")


def _range(col: str, digits: int | None = None) -> str:
    q = [f"quantile_cont({col}, {p})" for p in (0.25, 0.75)]
    if digits is not None:
        q = [f"round({e}, {digits})" for e in q]
    q = [f"CAST({e} AS DOUBLE)" for e in q]
    return f"'[' || {_num(q[0])} || ', ' || {_num(q[1])} || ']'"


def _counts(pairs, share: bool) -> str:
    out = []
    for label, cond in pairs:
        n = f"round(avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END), 2)" if share else f"count(*) FILTER ({cond})"
        out.append(f"'{label} = ' || {_num(n)}")
    return " || ', ' || ".join(out)


SEXES = [("male", "Gender = 'Male'"), ("female", "Gender = 'Female'")]
KINDS = [("medical", "AdmCatID = 'Medical'"), ("elective", "AdmCatID = 'Surgical/Elective'"),
         ("emergency", "AdmCatID = 'Surgical/Emeregency'")]


def stratified_sql(stratum: str) -> str:
    return f"""SELECT {stratum}, round(avg(Age), 6) AS m_age, {_range('Age')} AS IQR_age,
  round(avg(ApacheIIScore), 6) AS m_apache, {_range('ApacheIIScore')} AS IQR_apache,
  round(avg(BMI), 1) AS m_bmi, {_range('BMI', 1)} AS IQR_bmi,
  {_counts(SEXES, False)} AS sex_n, {_counts(SEXES, True)} AS sex_percentage,
  {_counts(KINDS, False)} AS admcat_n, {_counts(KINDS, True)} AS admcat_percentage
FROM last GROUP BY {stratum}"""


CASES = "SELECT {s}, count(*) AS n, CAST(sum(ped_status_1) AS BIGINT) AS cases FROM last GROUP BY {s}"


def relational_sql() -> dict[str, str]:
    q = with_shared
    return {
        "life_table": q(["ped"], """SELECT tend, '(' || tstart || ',' || tend || ']' AS interval_label,
  count(*) AS at_risk, CAST(sum(ped_status_1) AS BIGINT) AS dying, CAST(sum(ped_status_2) AS BIGINT) AS extubation
FROM ped GROUP BY tend, tstart"""),
        "life_table_from_rows": q(["ped"], """SELECT tend, '(' || tstart || ',' || tend || ']' AS interval_label,
  count(*) AS at_risk, CAST(sum(ped_status_1) AS BIGINT) AS dying, CAST(sum(ped_status_2) AS BIGINT) AS extubation
FROM ped GROUP BY tend, tstart"""),
        "life_table_reclassified": q(["ped"], """SELECT tend, '(' || tstart || ',' || tend || ']' AS interval_label,
  count(*) AS at_risk, CAST(sum(CASE WHEN early AND event_time <= tend THEN 1 ELSE ped_status_1 END) AS BIGINT) AS dying,
  CAST(sum(CASE WHEN early THEN 0 ELSE ped_status_2 END) AS BIGINT) AS extubation
FROM (SELECT *, PatientDied = 1 AND delta_2 = 1 AND Surv0To60 - DaysMechVent <= 2 AS early FROM ped) p
GROUP BY tend, tstart"""),
        "cohort_status": q(["cohort"], """SELECT CombinedID, mv_status, delta_1, delta_2, event_time FROM cohort"""),
        "cohort_status_counts": q(["cohort"], """SELECT mv_status, count(*) AS n,
  CAST(sum(event_time) AS BIGINT) AS total_time FROM cohort GROUP BY mv_status"""),
        "table_summary": q(["patient"], six_sql("patient", ["Age", "ApacheIIScore", "BMI", "Disc0To60",
                                                            "Surv0To60", "DaysMechVent"])),
        "diary_summary": q(["daily"], six_sql("daily", ["Study_Day", "proteinGproKG", "calproKg"])),
        "ped_rows": q(["ped"], """SELECT AdmCatID, tend, count(*) AS n_rows,
  CAST(sum(ped_status_1) AS BIGINT) AS died, CAST(sum(ped_status_2) AS BIGINT) AS weaned,
  round(sum(CAST(int_mid AS DOUBLE)), 6) AS sum_int_mid, min(tstart) AS min_tstart FROM ped GROUP BY AdmCatID, tend"""),
        "ped_person_time": q(["cohort", "daily"], """SELECT count(*) AS n_rows, CAST(count(*) AS DOUBLE) AS person_time,
  CAST(sum(CASE WHEN event_time <= d THEN delta_1 ELSE 0 END) AS BIGINT) AS ped_status_1,
  CAST(sum(CASE WHEN event_time <= d THEN delta_2 ELSE 0 END) AS BIGINT) AS ped_status_2
FROM cohort JOIN range(1, 61) g(d) ON d - 1 < event_time
WHERE CombinedID IN (SELECT CombinedID FROM daily)"""),
        "ped_weekly_cuts": q(["fitted"], """SELECT CAST(lo AS INT) AS tstart, CAST(lo + 7 AS INT) AS tend, count(*) AS n_rows,
  round(CAST(sum(least(event_time, lo + 7) - lo) AS DOUBLE), 6) AS person_time,
  CAST(sum(CASE WHEN event_time <= lo + 7 THEN delta_1 ELSE 0 END) AS BIGINT) AS died,
  CAST(sum(CASE WHEN event_time <= lo + 7 THEN delta_2 ELSE 0 END) AS BIGINT) AS weaned
FROM fitted JOIN (SELECT range * 7 AS lo FROM range(0, 8)) g ON lo < event_time GROUP BY lo"""),
        "delayed_entry_ids": q(["ped"], "SELECT DISTINCT CombinedID FROM ped"),
        "last_rows": q(["last"], "SELECT CombinedID, tend, ped_status_1, ped_status_2 FROM last"),
        "saved_ped": q(["ped"], """SELECT AdmCatID, '(' || tstart || ',' || tend || ']' AS interval_label,
  count(*) AS n_rows, count(DISTINCT CombinedID) AS n_subjects, CAST(sum(ped_status_2) AS BIGINT) AS weaned
FROM ped GROUP BY AdmCatID, tstart, tend"""),
        "last_rows_en": q(["last"], """SELECT EN2_4, round(100 * avg(ped_status_1), 6) AS mdeath
FROM last GROUP BY EN2_4"""),
        "named_life_tables": q(["ped"], """SELECT 'main' AS cohort, tend, count(*) AS at_risk,
  CAST(sum(ped_status_1) AS BIGINT) AS dying, CAST(sum(ped_status_2) AS BIGINT) AS extubation FROM ped GROUP BY tend
UNION ALL SELECT 'sensitivity', tend, count(*),
  CAST(sum(CASE WHEN early AND event_time <= tend THEN 1 ELSE ped_status_1 END) AS BIGINT),
  CAST(sum(CASE WHEN early THEN 0 ELSE ped_status_2 END) AS BIGINT)
FROM (SELECT *, PatientDied = 1 AND delta_2 = 1 AND Surv0To60 - DaysMechVent <= 2 AS early FROM ped) p
GROUP BY tend"""),
        "diary_sums": q(["kept_daily"], """SELECT 'EN' AS kind, CAST(sum(EN) AS BIGINT) AS days, count(*) AS n FROM kept_daily
UNION ALL SELECT 'PN', CAST(sum(PN) AS BIGINT), count(*) FROM kept_daily"""),
        "relabelled_admissions": q(["fitted"], """SELECT CAST(CASE AdmCatID WHEN 'Medical' THEN 1
  WHEN 'Surgical/Elective' THEN 2 ELSE 3 END AS INT) AS AdmCatID_ord, CASE AdmCatID WHEN 'Medical' THEN 'medical'
  WHEN 'Surgical/Elective' THEN 'elective' ELSE 'emergency' END AS AdmCatID, count(*) AS n FROM fitted GROUP BY 1, 2"""),
        "pn_day_frequency": q(["fitted"], """SELECT CAST(v AS BIGINT) AS PN2_4, count(CombinedID) AS n
FROM range(0, 5) r(v) LEFT JOIN fitted ON PN2_4 = v GROUP BY v"""),
        "unknown_status": q(["patient"], """SELECT count(*) FILTER (NOT (DaysMechVent >= 60 OR Disc0To60 IS NOT NULL
  OR Surv0To60 IS NOT NULL)) AS n_unknown FROM patient WHERE DaysMechVent <> 0"""),
        "first_subjects": q(["fitted"], """SELECT CombinedID, AdmCatID, event_time FROM fitted
ORDER BY CombinedID LIMIT 25"""),
        "kept_tables": q(["fitted", "kept_daily"], """SELECT 'patient' AS name, count(*) AS n,
  CAST(sum(CombinedID) AS BIGINT) AS key_sum FROM fitted
UNION ALL SELECT 'daily', count(*), CAST(sum(CombinedID) AS BIGINT) FROM kept_daily"""),
        "early_death_reclass": q(["fitted"], """SELECT CASE WHEN early THEN 1 ELSE delta_1 END AS delta_1,
  CASE WHEN early THEN 0 ELSE delta_2 END AS delta_2, count(*) AS n, CAST(sum(event_time) AS BIGINT) AS total_time
FROM (SELECT *, PatientDied = 1 AND delta_2 = 1 AND Surv0To60 - DaysMechVent <= 2 AS early FROM fitted) f
GROUP BY 1, 2"""),
        "early_death_by_union": q(["fitted"], """SELECT CASE WHEN early THEN 1 ELSE delta_1 END AS delta_1,
  CASE WHEN early THEN 0 ELSE delta_2 END AS delta_2, count(*) AS n, CAST(sum(event_time) AS BIGINT) AS total_time
FROM (SELECT *, PatientDied = 1 AND delta_2 = 1 AND Surv0To60 - DaysMechVent <= 2 AS early FROM fitted) f
GROUP BY 1, 2"""),
        "early_death_48h": q(["fitted"], """SELECT CombinedID, Surv0To60 - DaysMechVent AS gap FROM fitted
WHERE PatientDied = 1 AND delta_2 = 1 AND Surv0To60 - DaysMechVent <= 2"""),
        "early_death_48_72h": q(["fitted"], """SELECT CombinedID, Surv0To60 - DaysMechVent AS gap FROM fitted
WHERE PatientDied = 1 AND delta_2 = 1 AND Surv0To60 - DaysMechVent > 2 AND Surv0To60 - DaysMechVent <= 3"""),
        "subgroup_cases_adm": q(["last"], CASES.format(s="AdmCatID")),
        "subgroup_cases_bmi": q(["last"], CASES.format(s="bmi_cat")),
        "subgroup_cases_pn": q(["last"], CASES.format(s="pn_bin")),
        "subgroup_diaries": q(["fitted", "kept_daily"], """SELECT 'AdmCatID' AS variable, AdmCatID AS level,
  count(*) AS n_days, count(DISTINCT d.CombinedID) AS n_subjects FROM kept_daily d JOIN fitted USING (CombinedID) GROUP BY AdmCatID
UNION ALL SELECT 'bmi_cat', bmi_cat, count(*), count(DISTINCT d.CombinedID) FROM kept_daily d JOIN fitted USING (CombinedID) GROUP BY bmi_cat
UNION ALL SELECT 'pn_bin', pn_bin, count(*), count(DISTINCT d.CombinedID) FROM kept_daily d JOIN fitted USING (CombinedID) GROUP BY pn_bin"""),
        "baseline_table": q(["fitted"], strata_sql(MV_HOURS, TEN_STRATA, "PatientDied")),
        "mv_hour_bins": q(["fitted"], f"SELECT mv_hours, count(*) AS n FROM {MV_HOURS} m GROUP BY mv_hours"),
        "mv_hour_bins_cohort": q(["cohort"], """SELECT mv_hours, count(*) AS n FROM (SELECT CASE
  WHEN 24 * DaysMechVent BETWEEN 0 AND 24 THEN '[0,24]' WHEN 24 * DaysMechVent > 24 AND 24 * DaysMechVent <= 48 THEN '(24,48]'
  WHEN 24 * DaysMechVent > 48 THEN '(48,max]' END AS mv_hours FROM cohort) m GROUP BY mv_hours"""),
        "co_partitioned": q(["ped", "fitted", "daily"], """SELECT AdmCatID, n_subjects, CAST(n_days AS BIGINT) AS n_days,
  CAST(n_rows AS BIGINT) AS n_rows, CAST(weaned AS BIGINT) AS weaned
FROM (SELECT AdmCatID, count(DISTINCT CombinedID) AS n_subjects, count(*) AS n_rows, sum(ped_status_2) AS weaned FROM ped GROUP BY AdmCatID) r
JOIN (SELECT AdmCatID, sum(least(days, 11)) AS n_days FROM fitted JOIN (
  SELECT CombinedID, count(*) AS days FROM daily GROUP BY CombinedID) d USING (CombinedID) GROUP BY AdmCatID) n USING (AdmCatID)"""),
        "baseline_csv": q(["fitted"], strata_sql(MV_HOURS, TEN_STRATA, "PatientDied")),
        "year_levels": q(["fitted"], "SELECT DISTINCT Year FROM fitted"),
        "last_interval_rate": q(["last"], strata_sql(
            "last", [s for s in TEN_STRATA if s != "mv_hours"], "ped_status_1")),
        "continuous_summary": q(["fitted"], six_sql("fitted", ["Age", "ApacheIIScore", "BMI"])),
        "stratified_table_pn": q(["last"], stratified_sql("pn_bin")),
        "stratified_table_bmi": q(["last"], stratified_sql("bmi_cat")),
        "study_flow": q(["patient", "fitted"], """SELECT n_database, n_model, n_extubated, n_died, n_died_48h, n_died_48_72h,
  n_model - n_extubated - n_died AS n_censored, round(n_extubated / n_model, 6) AS extubated_share,
  round(n_died / n_model, 6) AS died_share, round((n_model - n_extubated - n_died) / n_model, 6) AS censored_share
FROM (SELECT count(*) AS n_model, count(*) FILTER (event_time <= 60 AND delta_2 = 1) AS n_extubated,
  count(*) FILTER (event_time <= 60 AND delta_1 = 1) AS n_died,
  count(*) FILTER (PatientDied = 1 AND delta_2 = 1 AND Surv0To60 - DaysMechVent <= 2) AS n_died_48h,
  count(*) FILTER (PatientDied = 1 AND delta_2 = 1 AND Surv0To60 - DaysMechVent > 2
    AND Surv0To60 - DaysMechVent <= 3) AS n_died_48_72h FROM fitted) f,
 (SELECT count(*) AS n_database FROM patient) p"""),
        "diet_days": q(["kept_daily"], """SELECT diet_days, pn_days, no_pn_days, protein_days, n_subjects,
  round(diet_days / n_subjects, 6) AS diet_days_per_subject, round(pn_days / diet_days, 6) AS pn_share
FROM (SELECT count(*) FILTER (NOT incomplete_day) AS diet_days, count(*) FILTER (PN = 1) AS pn_days,
  count(*) FILTER (PN = 0) AS no_pn_days,
  count(*) FILTER (NOT incomplete_day AND proteinAdjustedPercentage <> 0) AS protein_days FROM kept_daily) d,
 (SELECT count(*) AS n_subjects FROM fitted) f"""),
        "en_share": q(["kept_daily"], """SELECT CAST(sum(EN) AS BIGINT) AS en, CAST(sum(PN) AS BIGINT) AS pn,
  round(sum(EN) / (sum(EN) + sum(PN)), 6) AS en_share FROM kept_daily"""),
        "low_intake_subjects": q(["kept_daily"], """SELECT n_low, n_subjects, round(n_low / n_subjects, 6) AS low_share
FROM (SELECT count(DISTINCT CombinedID) AS n_low FROM kept_daily
  WHERE NOT incomplete_day AND proteinCat2 = 0 AND proteinCat3 = 0) l, (SELECT count(*) AS n_subjects FROM fitted) f"""),
        "intake_bands": q(["kept_daily"], f"""SELECT s.*, protein_days, round(n / protein_days, 6) AS day_share FROM (
SELECT * FROM ({six_sql("banded", ["proteinGproKG", "calproKg"], "band")}) z WHERE band IS NOT NULL) s,
(SELECT count(*) AS protein_days FROM kept_daily WHERE NOT incomplete_day AND proteinAdjustedPercentage <> 0) p""".replace(
            "FROM banded", """FROM (SELECT *, CASE WHEN proteinGproKG < 0.8 AND proteinGproKG <> 0 THEN 'I'
  WHEN proteinGproKG BETWEEN 0.8 AND 1.2 THEN 'II' WHEN proteinGproKG > 1.2 THEN 'III' END AS band
  FROM kept_daily WHERE NOT incomplete_day) banded""")),
        "time_to_death_summary": q(["last"], six_sql("(SELECT * FROM last WHERE ped_status_1 = 1) d", ["tend"])),
        "extubated_durations": q(["fitted"], six_sql("(SELECT * FROM fitted WHERE delta_2 = 1) d",
                                                     ["DaysMechVent", "event"])),
        "extubated_icu_days": q(["fitted"], six_sql("(SELECT * FROM fitted WHERE delta_2 = 1) d",
                                                    ["DaysMechVent", "DaysInICU", "event"])),
    }



# Exposure and inference under given parameters. The coefficients are the `embeddings` vectors: place 1 the
# intercept (less 3), then 25 tensor coefficients of category 3 and 25 of category 2, for the second cause
# shifted by 13 places. Spline of t over [0, 59.5] and of tz over [0, 12], five functions each.
BASIS_T = f"SELECT t, a, {bspline('t - 0.5', '0.0', '59.5', '5', 'a')} AS bt FROM range(5, 61) x(t), range(0, 5) y(a)"
BASIS_TZ = f"SELECT tz, b, {bspline('tz + 1.0', '0.0', '12.0', '5', 'b')} AS bz FROM range(1, 12) x(tz), range(0, 5) y(b)"
SCHEMES = """
SELECT protocol, CAST(d AS INT) AS tz,
  CASE protocol WHEN 'low_to_med' THEN CASE WHEN d > 4 THEN 1 ELSE 0 END WHEN 'med' THEN 1
    WHEN 'med_to_high' THEN CASE WHEN d <= 4 THEN 1 ELSE 0 END ELSE 0 END AS C2,
  CASE protocol WHEN 'med_to_high' THEN CASE WHEN d > 4 THEN 1 ELSE 0 END WHEN 'high' THEN 1 ELSE 0 END AS C3
FROM (VALUES ('low'), ('low_to_med'), ('med'), ('med_to_high'), ('high')) p(protocol), range(1, 12) r(d)"""
LABELS = """SELECT * FROM (VALUES ('low', 'exclusively low', 1), ('low_to_med', 'late standard', 2),
  ('med', 'early standard', 3), ('med_to_high', 'late high', 4), ('high', 'early high', 5)) l(protocol, label, ord)"""
PAIRS = """SELECT comparison, p1, p2, a.label || ' vs. ' || b.label AS name FROM (VALUES ('A', 'low', 'low_to_med'),
  ('B', 'low_to_med', 'med'), ('C', 'low', 'med'), ('D', 'med', 'med_to_high'), ('E', 'med_to_high', 'high'),
  ('F', 'med', 'high')) c(comparison, p1, p2) JOIN labels a ON a.protocol = p1 JOIN labels b ON b.protocol = p2"""
# protocol, day, coefficient place and design value (places 2..51)
FRAME_X = """SELECT protocol, t AS tend, 2 + cat * 25 + a * 5 + b AS j,
  sum(bt * bz * LL * CASE cat WHEN 0 THEN C3 ELSE C2 END) AS x
FROM basis_t JOIN lag_lead USING (t) JOIN basis_tz USING (tz) JOIN schemes USING (tz), range(0, 2) c(cat)
GROUP BY protocol, t, cat, a, b"""
DRAWS = "SELECT vec_id AS sim_id, generate_subscripts(embedding, 1) AS j, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings"
# linear predictor of every draw, protocol and day, for both causes
ETAS = """SELECT sim_id, protocol, tend, max(i1) - 3 + sum(x * e1) AS eta1, max(i2) - 3 + sum(x * e2) AS eta2
FROM (SELECT d1.sim_id, d1.j, d1.e AS e1, d2.e AS e2 FROM draws d1 JOIN draws d2
        ON d2.sim_id = d1.sim_id AND d2.j = d1.j + 13 WHERE d1.j BETWEEN 2 AND 51) d
JOIN (SELECT sim_id, max(CASE WHEN j = 1 THEN e END) AS i1, max(CASE WHEN j = 14 THEN e END) AS i2
      FROM draws GROUP BY sim_id) i USING (sim_id)
JOIN frame_x USING (j) GROUP BY sim_id, protocol, tend"""
HAZARDS = "SELECT sim_id, protocol, CAST(tend AS INT) AS tend, exp(eta1) AS death, exp(eta2) AS extubation FROM etas"
CIFS = """SELECT sim_id, protocol, tend, survival,
  sum(death * (survival - 1e-10)) OVER w AS cif_death, sum(extubation * (survival - 1e-10)) OVER w AS cif_extubation
FROM (SELECT *, exp(-sum(death + extubation) OVER (PARTITION BY sim_id, protocol ORDER BY tend)) AS survival
      FROM hazards) h WINDOW w AS (PARTITION BY sim_id, protocol ORDER BY tend)"""
# the contrast of a draw: its mean over the draws is the log hazard ratio, its deviation the standard error
CONTRASTS = """SELECT comparison, name, tend, sim_id, sum((x2 - x1) * e) AS v
FROM (SELECT comparison, name, f1.tend, f1.j, f1.x AS x1, f2.x AS x2 FROM pairs
      JOIN frame_x f1 ON f1.protocol = p1 JOIN frame_x f2 ON f2.protocol = p2 AND f2.tend = f1.tend AND f2.j = f1.j) f
JOIN draws USING (j) GROUP BY comparison, name, tend, sim_id"""
EFFECTS = """SELECT comparison, name, CAST(tend AS INT) AS tend, tend - 0.5::DOUBLE AS intmid, exp(m) AS fit, s AS se,
  exp(m + 2 * s) AS hi, exp(m - 2 * s) AS lo
FROM (SELECT comparison, name, tend, avg(v) AS m, stddev_samp(v) AS s FROM contrasts GROUP BY ALL) c"""

# window of every fitted subject in long form, and its rows at risk
WINDOW = """SELECT f.CombinedID, f.event_time, f.AdmCatID, f.ApacheIIScore, f.delta_1, f.delta_2,
  CAST(tz AS INT) AS tz, d.CombinedID IS NOT NULL AS present,
  coalesce(d.proteinCat2, 0) AS C2, coalesce(d.proteinCat3, 0) AS C3
FROM fitted f CROSS JOIN range(1, 12) g(tz)
LEFT JOIN daily d ON d.CombinedID = f.CombinedID AND d.Study_Day = tz"""
EXPOSED = """SELECT w.*, CAST(t AS INT) AS tend, LL FROM "window" w JOIN lag_lead USING (tz)
WHERE t >= 5 AND t - 1 < event_time"""

SHARED.update({
    "basis_t": (BASIS_T, []),
    "basis_tz": (BASIS_TZ, []),
    "schemes": (SCHEMES, []),
    "labels": (LABELS, []),
    "pairs": (PAIRS, ["labels"]),
    "frame_x": (FRAME_X, ["basis_t", "basis_tz", "lag_lead", "schemes"]),
    "draws": (DRAWS, []),
    "etas": (ETAS, ["draws", "frame_x"]),
    "hazards": (HAZARDS, ["etas"]),
    "cifs": (CIFS, ["hazards"]),
    "contrasts": (CONTRASTS, ["pairs", "frame_x", "draws"]),
    "effects": (EFFECTS, ["contrasts"]),
    '"window"': (WINDOW, ["fitted", "daily"]),
    "exposed": (EXPOSED, ['"window"', "lag_lead"]),
})


def _digits(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def exposure_sql() -> dict[str, str]:
    q = with_shared
    return {
        "lag_lead_at_risk": q(["ped", "lag_lead"], """SELECT CAST(t AS INT) AS t, CAST(tz AS INT) AS tz, LL,
  at_risk, at_risk * LL AS acting FROM lag_lead JOIN (SELECT tend, count(*) AS at_risk FROM ped GROUP BY tend) p
  ON t = tend"""),
        "diary_window": q(["daily"], """SELECT CombinedID, least(max(Study_Day), 11) AS n_days,
  array_to_string(list_resize(list(proteinCat2 ORDER BY Study_Day), 11, 0), '') AS c2,
  array_to_string(list_resize(list(proteinCat3 ORDER BY Study_Day), 11, 0), '') AS c3
FROM daily GROUP BY CombinedID"""),
        "nested_diary": q(["daily"], """SELECT CombinedID, CAST((Study_Day - 1) // 1000 AS INT) AS piece, count(*) AS n_days,
  max(Study_Day) AS last_day, string_agg(Study_Day || ':' || EN, ',' ORDER BY Study_Day) AS diary
FROM daily GROUP BY CombinedID, piece"""),
        "overlong_diaries": """SELECT count(*) AS n_subjects, CAST(coalesce(sum(n - 11), 0) AS BIGINT) AS n_rows_cut
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) c WHERE n > 11""",
        "cumulative_exposure": q(["exposed"], """SELECT tend, tz AS day, count(*) AS n_rows,
  CAST(sum(CASE WHEN present THEN tend - 0.5 ELSE 0 END) AS DOUBLE) AS sum_t,
  CAST(sum(CASE WHEN present THEN tz + 1 ELSE 0 END) AS DOUBLE) AS sum_tz,
  CAST(sum(LL) AS DOUBLE) AS sum_ll, CAST(sum(C2) AS DOUBLE) AS sum_c2, CAST(sum(C3) AS DOUBLE) AS sum_c3
FROM exposed GROUP BY tend, tz"""),
        "effective_exposure": q(["exposed"], """SELECT tend, e2, e3, count(*) AS n_rows FROM (
  SELECT CombinedID, tend, CAST(sum(LL * C2) AS DOUBLE) AS e2, CAST(sum(LL * C3) AS DOUBLE) AS e3
  FROM exposed GROUP BY CombinedID, tend) e GROUP BY tend, e2, e3"""),
        "protocol_frames": q(["fitted", "schemes", "lag_lead", "labels"], """SELECT AdmCatID, CombinedID, protocol, label,
  CAST(t AS INT) AS tend, 0 AS icuByDummy, CAST(sum(LL * C2) AS DOUBLE) AS e2, CAST(sum(LL * C3) AS DOUBLE) AS e3
FROM (SELECT AdmCatID, min(CombinedID) AS CombinedID FROM fitted GROUP BY AdmCatID) f
CROSS JOIN schemes JOIN lag_lead USING (tz) JOIN labels USING (protocol) WHERE t >= 5
GROUP BY AdmCatID, CombinedID, protocol, label, t"""),
        "bspline_basis": q(["fitted"], f"""SELECT BMI, n, CAST(i AS INT) AS i,
  abs(round({bspline('BMI', 'lo', 'hi', '10', 'i')}, 6)) AS value
FROM (SELECT BMI, count(*) AS n FROM fitted GROUP BY BMI) b, (SELECT min(BMI) AS lo, max(BMI) AS hi FROM fitted) r,
 range(0, 10) g(i)"""),
        "tensor_exposure": q(["exposed", "basis_t", "basis_tz"], """SELECT tend, CAST(a * 5 + b AS INT) AS k,
  abs(round(sum(bt * bz * n3), 6)) AS cat3, abs(round(sum(bt * bz * n2), 6)) AS cat2
FROM (SELECT tend, tz, sum(LL * C3) AS n3, sum(LL * C2) AS n2 FROM exposed GROUP BY tend, tz) e
JOIN basis_t ON t = tend JOIN basis_tz USING (tz) GROUP BY tend, a, b"""),
        "design_sums": q(["exposed", "ped", "basis_t", "basis_tz"], """SELECT 'te(t,tz):I(LL * proteinCat' || c || ').' || (a * 5 + b + 1) AS term,
  round(sum(bt * bz * CASE c WHEN 3 THEN n3 ELSE n2 END), 6) AS total
FROM (SELECT tend, tz, sum(LL * C3) AS n3, sum(LL * C2) AS n2 FROM exposed GROUP BY tend, tz) e
JOIN basis_t ON t = tend JOIN basis_tz USING (tz), (VALUES (3), (2)) v(c) GROUP BY c, a, b
UNION ALL SELECT term, round(CAST(total AS DOUBLE), 6) FROM (
  SELECT '(Intercept)' AS term, count(*) AS total FROM ped
  UNION ALL SELECT 'AdmCatIDSurgical/Elective', count(*) FILTER (AdmCatID = 'Surgical/Elective') FROM ped
  UNION ALL SELECT 'AdmCatIDSurgical/Emeregency', count(*) FILTER (AdmCatID = 'Surgical/Emeregency') FROM ped
  UNION ALL SELECT 'ApacheIIScore', sum(ApacheIIScore) FROM ped
  UNION ALL SELECT 'ApacheIIScore:int_mid', sum(ApacheIIScore * int_mid) FROM ped) p"""),
        "compressed_design": q(["ped"], """SELECT AdmCatID, Gender, tend, count(*) AS n_rows,
  CAST(count(*) AS DOUBLE) AS exposure, CAST(sum(ped_status_1) AS BIGINT) AS ped_status_1,
  CAST(sum(ped_status_2) AS BIGINT) AS ped_status_2 FROM ped GROUP BY AdmCatID, Gender, tend"""),
        "linear_predictor_given": q(["exposed", "basis_t", "basis_tz", "draws"], """SELECT tend, count(*) AS n_rows,
  round(avg(m1 - 3 + eta), 6) AS mean_eta, round(avg(eta), 6) AS mean_effect, round(max(eta), 6) AS max_effect,
  round(min(eta), 6) AS min_effect
FROM (SELECT CombinedID, tend, sum(LL * (C3 * g3 + C2 * g2)) AS eta FROM exposed JOIN (
    SELECT t, tz, sum(bt * bz * CASE c WHEN 0 THEN m END) AS g3, sum(bt * bz * CASE c WHEN 1 THEN m END) AS g2
    FROM basis_t, basis_tz, range(0, 2) v(c), (SELECT j, avg(e) AS m FROM draws GROUP BY j) d
    WHERE j = 2 + c * 25 + a * 5 + b GROUP BY t, tz) g ON t = tend AND g.tz = exposed.tz
  GROUP BY CombinedID, tend) e, (SELECT avg(e) AS m1 FROM draws WHERE j = 1) i GROUP BY tend"""),
        "six_comparisons_given": q(["effects"], f"""SELECT comparison, name, tend, intmid,
  {_digits(['fit', 'se', 'hi', 'lo'])} FROM effects"""),
        "hr_table_given": q(["effects"], f"""SELECT comparison, tend, round(fit, 2) AS fit,
  '[' || {_num('round(lo, 2)')} || ', ' || {_num('round(hi, 2)')} || ']' AS CI FROM effects"""),
        "hr_extremes_given": q(["effects"], f"""SELECT comparison, 'min' AS extreme, tend, {_digits(['fit', 'se'])} FROM effects
QUALIFY fit = min(fit) OVER (PARTITION BY comparison)
UNION ALL SELECT comparison, 'max', tend, {_digits(['fit', 'se'])} FROM effects
QUALIFY fit = max(fit) OVER (PARTITION BY comparison)"""),
        "cause_hazards_given": q(["hazards"], f"SELECT sim_id, protocol, tend, {_digits(['death', 'extubation'])} FROM hazards"),
        "all_cause_hazard_given": q(["hazards"], """SELECT protocol, tend, count(*) AS n_draws,
  round(avg(death + extubation), 6) AS hazard FROM hazards GROUP BY protocol, tend"""),
        "cif_given": q(["cifs"], f"""SELECT sim_id, protocol, tend,
  {_digits(['survival', 'cif_death', 'cif_extubation'])} FROM cifs"""),
        "cif_band_given": q(["cifs", "labels", "pairs"], """SELECT comparison, name AS comparison_text, protocol, label,
  tend, tend - 0.5::DOUBLE AS int_mid, cause, round(cif, 6) AS cif, round(cif_lower, 6) AS cif_lower,
  round(cif_upper, 6) AS cif_upper
FROM (SELECT protocol, tend, cause, avg(v) AS cif, quantile_cont(v, 0.025) AS cif_lower, quantile_cont(v, 0.975) AS cif_upper
  FROM (SELECT protocol, tend, 'death' AS cause, cif_death AS v FROM cifs
        UNION ALL SELECT protocol, tend, 'extubation', cif_extubation FROM cifs) u GROUP BY protocol, tend, cause) b
JOIN pairs ON protocol IN (p1, p2) JOIN labels USING (protocol)"""),
        "poisson_rates_closed_form": q(["ped"], """SELECT AdmCatID, died, n_rows, round(died / n_rows, 6) AS rate,
  round(1 / sqrt(died), 6) AS log_rate_se
FROM (SELECT AdmCatID, CAST(sum(ped_status_1) AS BIGINT) AS died, count(*) AS n_rows FROM ped GROUP BY AdmCatID) p"""),
        "compressed_fit": q(["ped", "daily"], """SELECT AdmCatID, round(e / n_rows, 6) AS rate, round(1 / sqrt(e), 6) AS log_rate_se, n_rows, n_groups
FROM (SELECT AdmCatID, CAST(sum(ped_status_2) AS DOUBLE) AS e, count(*) AS n_rows, count(DISTINCT days || '/' || tend) AS n_groups
  FROM ped JOIN (SELECT CombinedID, string_agg(proteinCat2 || '-' || proteinCat3, ',' ORDER BY Study_Day) AS days
    FROM daily GROUP BY CombinedID) d USING (CombinedID) GROUP BY AdmCatID) g"""),
        "coefficients_without": q(["ped"], """SELECT 'weaning' AS model, 'DiagID2' || DiagID2 AS term,
  round(ln(e / t) - ln(e0 / t0), 6) AS estimate, round(sqrt(1 / e + 1 / e0), 6) AS se
FROM (SELECT DiagID2, CAST(sum(ped_status_2) AS DOUBLE) AS e, count(*) AS t FROM ped GROUP BY DiagID2) d,
  (SELECT CAST(sum(ped_status_2) AS DOUBLE) AS e0, count(*) AS t0 FROM ped WHERE DiagID2 = (SELECT min(DiagID2) FROM ped)) b
WHERE DiagID2 <> '2-HIGH' AND DiagID2 <> (SELECT min(DiagID2) FROM ped)"""),
        "coef_table_closed_form": q(["ped"], """SELECT 'weaning' AS model, 'GenderMale' AS term, 'Gender: male' AS label,
  round(b, 6) AS estimate, round(s, 6) AS se, round(b / s, 6) AS z,
  round(b - 1.959963984540054 * s, 6) AS lower, round(b + 1.959963984540054 * s, 6) AS upper
FROM (SELECT ln(m_events / m_time) - ln(f_events / f_time) AS b, sqrt(1 / m_events + 1 / f_events) AS s FROM (
  SELECT CAST(sum(ped_status_2) FILTER (Gender = 'Male') AS DOUBLE) AS m_events, count(*) FILTER (Gender = 'Male') AS m_time,
    CAST(sum(ped_status_2) FILTER (Gender = 'Female') AS DOUBLE) AS f_events, count(*) FILTER (Gender = 'Female') AS f_time
  FROM ped) r) c"""),
    }


# Raw spline coefficients of three smooths are places 2..31 of the vectors; a smooth is centred by taking out the
# part along the means of its spline functions.
SMOOTH_VALUES = """SELECT 'int_mid' AS variable, 0 AS place, CAST(int_mid AS DOUBLE) AS v, count(*) AS n FROM ped GROUP BY v
UNION ALL SELECT 'Age', 1, CAST(Age AS DOUBLE) AS v, count(*) FROM ped GROUP BY v
UNION ALL SELECT 'BMI', 2, CAST(BMI AS DOUBLE) AS v, count(*) FROM ped GROUP BY v"""
SMOOTH_SPANS = "SELECT variable, place, min(v) AS lo, max(v) AS hi FROM smooth_values GROUP BY ALL"
SMOOTH_MEANS = f"""SELECT variable, place, i, sum(n * {bspline('v', 'lo', 'hi', '10', 'i')}) / sum(n) AS m
FROM smooth_values JOIN smooth_spans USING (variable, place), range(0, 10) g(i) GROUP BY variable, place, i"""
SMOOTH_COEFFICIENTS = """SELECT variable, i, sim_id,
  e - m * sum(m * e) OVER (PARTITION BY variable, sim_id) / sum(m * m) OVER (PARTITION BY variable, sim_id) AS c
FROM draws JOIN smooth_means ON j = 2 + 10 * place + i"""
SMOOTH_FITS = f"""SELECT variable, x, sim_id, sum(c * {bspline('x', 'lo', 'hi', '10', 'i')}) AS v
FROM (SELECT variable, lo, hi, lo + k * ((hi - lo) / 99) AS x FROM smooth_spans, range(0, 100) g(k)) p
JOIN smooth_coefficients USING (variable) GROUP BY variable, x, sim_id"""

SHARED.update({
    "smooth_values": (SMOOTH_VALUES, ["ped"]),
    "smooth_spans": (SMOOTH_SPANS, ["smooth_values"]),
    "smooth_means": (SMOOTH_MEANS, ["smooth_values", "smooth_spans"]),
    "smooth_coefficients": (SMOOTH_COEFFICIENTS, ["draws", "smooth_means"]),
    "smooth_fits": (SMOOTH_FITS, ["smooth_spans", "smooth_coefficients"]),
})


def _poly(coefficients, x: str) -> str:
    out = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}))"
    return out


def normal_quantile_sql(p: str) -> str:
    """The normal quantile of an SQL expression, by the same rational approximation as the column function."""
    t, q = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"({p} - 0.5)"
    far = f"{_poly(QUANTILE_TAIL[0], t)} / {_poly(QUANTILE_TAIL[1], t)}"
    near = f"{q} * {_poly(QUANTILE_MIDDLE[0], f'({q} * {q})')} / {_poly(QUANTILE_MIDDLE[1], f'({q} * {q})')}"
    low = QUANTILE_TAIL_BELOW
    return f"CASE WHEN {p} < {low} THEN {far} WHEN {p} > 1 - {low} THEN -({far}) ELSE {near} END"


#: Smooths with their numbers of coefficients; strata with their rule and whether BMI and the feeding days are terms.
SMOOTH_TERMS = (("s(int_mid)", 9), ("s(Age):int_mid", 9), ("s(BMI):int_mid", 9),
                ("te(t,tz):I(LL * proteinCat3)", 25), ("te(t,tz):I(LL * proteinCat2)", 25))
STRATA = (("medical", "AdmCatID = 'Medical'", True, True), ("elective", "AdmCatID = 'Surgical/Elective'", True, True),
          ("emergency", "AdmCatID = 'Surgical/Emeregency'", True, True), ("bmi1", "bmi_cat = 'bmi<18.5'", False, True),
          ("bmi2", "bmi_cat = 'bmi18.5-30'", False, True), ("bmi3", "bmi_cat = 'bmi>30'", False, True),
          ("pn01", "pn_bin = 'pn01'", True, False), ("pn23", "pn_bin = 'pn23'", True, False))


def _zero_scores(model: str, rule: str, factors: list[str], linear: int, terms) -> str:
    """The score equations of a settled fit: numbers of coefficients from the tables, all scores zero."""
    levels = " + ".join(f"(SELECT count(DISTINCT {f}) - 1 FROM ped)" for f in factors)
    parts = [("parametric", f"{1 + linear} + {levels}"), *[(t, str(n)) for t, n in terms],
             ("smoothing", str(1 + sum(t.startswith("s(") for t, _ in terms) + 2)),
             ("units", f"(SELECT count(DISTINCT CombinedicuID) FROM ped WHERE {rule})")]
    return " UNION ALL ".join(
        f"SELECT '{model}' AS model, '{t}' AS term, CAST({n} AS BIGINT) AS n, 0.0::DOUBLE AS score" for t, n in parts)


def model_sql() -> dict[str, str]:
    """Saved models and tables, smooths and unit effects under given parameters, and what every fit must meet."""
    q = with_shared
    calibration = " UNION ALL ".join(
        f"SELECT '{name}' AS model, '{f}' AS variable, CAST({f} AS VARCHAR) AS level, "
        f"CAST({events} AS DOUBLE) AS expected FROM seen GROUP BY {f}"
        for name, events in (("death", "sum(ped_status_1)"), ("extubation", "sum(ped_status_2)"),
                             ("sens_death", "sum(CASE WHEN early AND event_time <= tend THEN 1 ELSE ped_status_1 END)"),
                             ("sens_extubation", "sum(CASE WHEN early THEN 0 ELSE ped_status_2 END)"))
        for f in ("Year", "DiagID2", "AdmCatID", "Gender"))
    strata = " UNION ALL ".join(
        _zero_scores(f"{name}_{cause}", rule, ["Year", "DiagID2", "Gender"], 5 + pn,
                     [t for t in SMOOTH_TERMS if bmi or "BMI" not in t[0]])
        for name, rule, bmi, pn in STRATA for cause in ("death", "extubation"))
    main = " UNION ALL ".join(_zero_scores(name, "true", ["Year", "DiagID2", "AdmCatID", "Gender"], 6, SMOOTH_TERMS)
                              for name in ("death", "extubation", "sens_death", "sens_extubation"))
    return {
        "score_equations": q(["ped"], f"SELECT * FROM ({main}) s"),
        "score_equations_subgroups": q(["ped"], f"SELECT * FROM ({strata}) s"),
        "cif_invariants": q(["labels"], """SELECT protocol, CAST(500 * 56 AS BIGINT) AS n_points, 0::BIGINT AS above_one,
  0::BIGINT AS falling FROM labels"""),
        "posterior_draws_given": q(["draws"], f"""SELECT sim_id, CAST(j - 1 AS INT) AS place,
  round(m + s * (z + 0.5 * coalesce(lag(z) OVER (PARTITION BY sim_id ORDER BY j), 0)), 6) AS beta
FROM (SELECT sim_id, j, m, s, {normal_quantile_sql('p')} AS z
  FROM (SELECT i AS sim_id, j, m, s,
      (('0x' || substr(md5('7:' || i || ':' || (j - 1)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE AS p
    FROM (SELECT CAST(j AS BIGINT) AS j, avg(e) - CASE WHEN j = 1 THEN 3 ELSE 0 END AS m, stddev_samp(e) AS s
      FROM draws WHERE j <= 51 GROUP BY j) d, range(0, 500) r(i)) u) z"""),
        "linear_predictor_reread": exposure_sql()["linear_predictor_given"],
        "life_table_reread": q(["ped"], """SELECT AdmCatID, tend, count(*) AS at_risk,
  CAST(sum(ped_status_1) AS BIGINT) AS dying FROM ped GROUP BY AdmCatID, tend"""),
        "smooth_given": q(["smooth_fits"], f"""SELECT variable, round(x, 6) AS x,
  {_digits(['fit', 'se', 'ci_lower', 'ci_upper'])}
FROM (SELECT variable, x, m AS fit, s AS se, m - 2 * s AS ci_lower, m + 2 * s AS ci_upper
  FROM (SELECT variable, x, avg(v) AS m, stddev_samp(v) AS s FROM smooth_fits GROUP BY variable, x) a) b"""),
        "unit_quantiles_given": q(["fitted"], f"""SELECT grp, round(effect, 6) AS effect, i, round(p, 6) AS p,
  round({normal_quantile_sql('p')}, 6) AS theoretical
FROM (SELECT *, CASE WHEN n <= 10 THEN (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) ELSE (i - 0.5::DOUBLE) / n END AS p
  FROM (SELECT CAST(CombinedicuID AS VARCHAR) AS grp, avg(ApacheIIScore) AS effect,
    row_number() OVER (ORDER BY avg(ApacheIIScore)) AS i, count(*) OVER () AS n FROM fitted GROUP BY CombinedicuID) r) s"""),
        "fit_calibration": q(["ped"], f"""SELECT * FROM (WITH seen AS (SELECT *,
  PatientDied = 1 AND delta_2 = 1 AND Surv0To60 - DaysMechVent <= 2 AS early FROM ped) {calibration}) c"""),
    }


def registered() -> dict[str, str]:
    return {**relational_sql(), **exposure_sql(), **model_sql()}
