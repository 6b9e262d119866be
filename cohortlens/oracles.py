"""The same results in DuckDB SQL, for the queries SQL can express."""

from __future__ import annotations

from cohortlens.operators.profile import KPI_MEASURES, MEASURES, SCORE_MEASURES, column_name
from cohortlens.schema import ATTR_COLS, ATTRIBUTES, BAND_COLS, BANDS, BASE_SCORES, COURSES, FEATURES, GLOBAL

COHORT = 1998
TARGETS = ["c_cert", "grade"]
ATTRS = ", ".join(ATTR_COLS)


def _attr(k: int, name: str) -> str:
    value = (
        "CAST(greatest(1.0e0, least(10.0e0, floor(5.5e0 + 16.0e0 * CAST(e.embedding"
        f"[{k + 1}] AS DOUBLE)))) AS INT)"
    )
    if name in ("attr_A", "attr_B"):
        value = f"CASE WHEN o_orderkey % 33 <> {k} THEN {value} END"
    return f"{value} AS {name}"


FACTS = f"""facts AS MATERIALIZED (
  SELECT o_orderkey AS student_id, CAST(o_orderkey AS VARCHAR) AS student_key,
         CASE WHEN o_orderkey % 20 <> 0 THEN o_custkey END AS group_id,
         CAST(year(o_orderdate) AS INT) AS cohort_id,
         CASE WHEN o_orderkey % 2 = 0 THEN 'BSCS' ELSE 'BSIT' END AS course,
         CASE WHEN o_orderkey % 50 = 0 THEN 'M'
              ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'H' WHEN '2' THEN 'AA'
                   WHEN '3' THEN 'A' WHEN '4' THEN 'BA' ELSE 'L' END END AS cfit,
         1 + o_totalprice / 125000 AS grade, q.c_cert,
         {", ".join(_attr(k, a) for k, a in enumerate(ATTR_COLS))}
  FROM orders
  LEFT JOIN (SELECT l_orderkey, CAST(floor(avg(l_quantity) * 1.6e0) AS INT) AS c_cert
             FROM lineitem GROUP BY l_orderkey) q ON q.l_orderkey = o_orderkey
  JOIN embeddings e ON e.vec_id = o_orderkey % (SELECT count(*) FROM embeddings))"""

FIXED = """sizes AS (
  SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) + 0.001e0 AS s1, abs(CAST(embedding[2] AS DOUBLE)) + 0.001e0 AS s2,
         abs(CAST(embedding[3] AS DOUBLE)) + 0.001e0 AS s3, abs(CAST(embedding[4] AS DOUBLE)) + 0.001e0 AS s4
  FROM embeddings),
shares AS (
  SELECT vec_id, CAST(vec_id % 3 AS INT) AS label, CAST(vec_id % 5 AS INT) AS fold, s1 / (s1 + s2 + s3) AS fail,
         s2 / (s1 + s2 + s3) AS pass, s3 / (s1 + s2 + s3) AS success, 100 * s4 AS weighted, 100 * s1 AS prediction
  FROM sizes),
fixed AS (
  SELECT *, CASE WHEN fail >= pass AND fail >= success THEN 0 WHEN pass >= success THEN 1 ELSE 2 END AS best,
         CASE label WHEN 0 THEN fail WHEN 1 THEN pass ELSE success END AS own
  FROM shares)"""
GROUPS = "grp AS (SELECT c_custkey AS id, c_name AS name FROM customer)"
COHORTS = (
    "cohorts AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS id, "
    "CAST(year(o_orderdate) AS VARCHAR) AS name FROM orders WHERE year(o_orderdate) <= 2000)"
)
SPELLED = """CASE c_nationkey WHEN 0 THEN 'University of Cebu - ' || c_name
     WHEN 1 THEN 'univ-ty of san carlos ' || c_name WHEN 2 THEN 'Unity of San Jose ' || c_name
     WHEN 3 THEN 'The University of Cebu ' || c_name ELSE c_name END"""
CANONICAL = f"""regexp_replace(regexp_replace(regexp_replace({SPELLED},
     '(?i)^Un.*ty of Cebu.*', 'UNIVERSITY OF CEBU'),
     '(?i)^Un.*ty of San Carlos.*', 'UNIVERSITY OF SAN CARLOS'),
     '(?i)^Un.*ty of San Jose.*', 'UNIVERSITY OF SAN JOSE RECOLETOS')"""
PROFILE = f"""prof AS MATERIALIZED (
  SELECT f.student_id AS row_no, f.student_key AS id_number, {SPELLED} AS previous_school,
         {CANONICAL} AS canonical_school, f.course, f.cfit, f.cohort_id, {ATTRS}
  FROM facts f LEFT JOIN customer ON c_custkey = f.group_id)"""
RESULTS = """res AS MATERIALIZED (
  SELECT f.student_key AS id_number, f.c_cert,
         o_orderstatus = 'P' AS is_inc,
         CASE WHEN o_orderstatus <> 'P' AND f.student_id % 40 <> 7 THEN f.grade END AS grade
  FROM facts f JOIN orders ON o_orderkey = f.student_id)"""
CLEAN = (
    "clean AS (SELECT id_number, c_cert, grade FROM res WHERE c_cert IS NOT NULL AND NOT is_inc)"
)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _scorecard(cohort: int | None) -> str:
    where = "" if cohort is None else f" AND cohort_id = {cohort}"
    return f"""raw AS (
  SELECT group_id, grp.name, CAST(count(*) AS BIGINT) AS student_count,
         avg(CASE WHEN grade >= 3 THEN grade END) / 5 AS g,
         sum(CASE WHEN grade >= 3 THEN 1 ELSE 0 END) / count(*) * 100 AS r,
         avg(c_cert) / 80 AS c
  FROM facts JOIN grp ON grp.id = group_id
  WHERE TRUE{where} GROUP BY group_id, grp.name HAVING count(*) > 3),
card AS (
  SELECT group_id, name, student_count, round(g * 100, 2) AS avg_passing_grade,
         round(r, 2) AS passing_rate, round(c * 100, 2) AS avg_cert_grade,
         round((0.5e0 * g + 0.3e0 * r / 100 + 0.2e0 * c) * 100, 2) AS weighted_score
  FROM raw)"""


def _card(cohort: int | None) -> str:
    return _with(FACTS, GROUPS, _scorecard(cohort))


def _band(default: str) -> str:
    return (
        "CASE cfit WHEN 'L' THEN 2 WHEN 'BA' THEN 4 WHEN 'A' THEN 6 WHEN 'AA' THEN 8 "
        f"WHEN 'H' THEN 10 ELSE {default} END"
    )


def _measure_sql(measure: str) -> str:
    if measure == "Total Count":
        return "CAST(count(*) AS DOUBLE)"
    if measure.endswith(" Count"):
        return f"CAST(count(CASE WHEN course = '{measure[:4]}' THEN 1 END) AS DOUBLE)"
    if measure == "CFIT":
        return f"avg({_band('NULL')})"
    if measure == "C Cert":
        return "avg(c_cert)"
    if measure == "Average Passing Grade":
        return "avg(CASE WHEN grade >= 3 THEN grade END)"
    if measure == "Passing Rate":
        return "avg(CASE WHEN grade >= 3 THEN 1 ELSE 0 END) * 100"
    return f"avg(attr_{measure})"


MEASURE_COLS = [column_name(m) for m in MEASURES]
_AGGS = ", ".join(f'{_measure_sql(m)} AS "{column_name(m)}"' for m in MEASURES)
STAR = """star AS (
  SELECT f.*, grp.name FROM facts f JOIN grp ON grp.id = f.group_id JOIN cohorts ON cohorts.id = f.cohort_id
  WHERE cfit IN ('L', 'BA', 'A', 'AA', 'H'))"""
PROFILES = f"profiles AS (SELECT group_id, name, {_AGGS} FROM star GROUP BY group_id, name)"
OVERALL = f"overall AS (SELECT {_AGGS} FROM star)"
_STAR_WITH = (FACTS, GROUPS, COHORTS, STAR)
SCORE_COLS = [column_name(m) for m in SCORE_MEASURES]


def _rounded(columns, digits=9, source="") -> str:
    return ", ".join(f'round({source}"{c}", {digits}) AS "{c}"' for c in columns)


def _unpivoted(frame: str, columns, ids: str = "group_id") -> str:
    """Long form of a wide frame, NULLs left out."""
    lead = f"{ids}, " if ids else ""
    parts = [
        f"SELECT {lead}'{c}' AS attribute, CAST(\"{c}\" AS DOUBLE) AS value FROM {frame}" for c in columns
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL"


def _r(x: str, y: str) -> str:
    corr = f"corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))"
    return f"round(CASE WHEN isnan({corr}) THEN NULL ELSE {corr} END, 6)"


def _pairs(frame: str, pairs, x_name: str, y_name: str, extra: str = "") -> str:
    """One aggregate per pair over one scan, then one row per pair."""
    aggs = ", ".join(f"{_r(x, y)} AS r{k}" for k, (x, y) in enumerate(pairs))
    rows = " UNION ALL ".join(
        f"SELECT '{x}' AS {x_name}, '{y}' AS {y_name}, r{k} AS r{extra} FROM m"
        for k, (x, y) in enumerate(pairs)
    )
    return f"(WITH m AS (SELECT {aggs} FROM {frame}) {rows})"


def _target_pairs(columns, targets):
    return [(c, t) for t in targets for c in columns]


_ALL = ATTR_COLS + TARGETS
_COMPOSITE = "round(0.5e0 * (grade / 5) + 0.5e0 * (c_cert / 80), 2)"
COMPOSED = f"composed AS (SELECT *, {_COMPOSITE} AS weighted_score, {_band('0')} AS cfit_rank FROM facts)"


def _extremes(where: str) -> str:
    return f"""sides AS (
  SELECT * FROM (SELECT *, 'top' AS side FROM composed {where}
                 ORDER BY weighted_score DESC NULLS LAST, student_id LIMIT 30)
  UNION ALL
  SELECT * FROM (SELECT *, 'bottom' AS side FROM composed {where}
                 ORDER BY weighted_score ASC NULLS FIRST, student_id LIMIT 30))"""


_OF_COHORT = f"WHERE cohort_id = {COHORT}"
FACTORS = ["cfit_rank", *ATTR_COLS]
_ATTR_FILLED = " AND ".join(f"{a} IS NOT NULL" for a in ATTR_COLS)
EXPLORE = f"""explore AS (
  SELECT (grade - 1) / 4 * 100 AS weighted, {ATTRS}, {_band('NULL')} AS cfit, course
  FROM facts WHERE cfit IN ('L', 'BA', 'A', 'AA', 'H') AND grade IS NOT NULL AND {_ATTR_FILLED})"""


def _label(weight: str, low: str = "50", high: str = "88") -> str:
    return (
        f"CASE WHEN {weight} < {low} THEN 0 WHEN {weight} < {high} THEN 1 "
        f"WHEN {weight} <= 100 THEN 2 END"
    )


def _feature(name: str) -> str:
    if name in BAND_COLS:
        test = f"cfit = '{name[5:]}'"
    elif name.startswith("course_"):
        test = f"course = '{name[7:].upper()}'"
    else:
        return f"CAST({name} AS DOUBLE) AS {name}"
    return f"CASE WHEN {test} THEN 1.0e0 ELSE 0.0e0 END AS \"{name}\""


_SPAN = "((grade - 1) / 4 * 100)"
TRAINING = f"""training AS (
  SELECT student_id, {_SPAN} AS weighted, {_label(_SPAN)} AS label, {", ".join(_feature(f) for f in FEATURES)}
  FROM facts WHERE cohort_id IN (1995, 1996, 1997, 1998, 1999, 2000) AND {_ATTR_FILLED})"""


def _bucket(key: str) -> str:
    digits = f"substr(md5(CAST({key} AS VARCHAR)), 1, 8)"
    return f"CAST(CAST('0x' || {digits} AS BIGINT) % 5 AS INT)"


def _verdict(p: list[str]) -> str:
    fail, passing, excel = p
    order = [("Failure", fail), ("Excellence", excel), ("Passing", passing)]
    lines = [f"WHEN {v} > 0.6e0 THEN 'High Confidence in {n}'" for n, v in order]
    lines += [f"WHEN {v} > 0.3e0 THEN 'Medium Confidence in {n}'" for n, v in order]
    for n, v in order:
        others = " AND ".join(f"{v} > {w}" for m, w in order if m != n)
        lines.append(f"WHEN {others} THEN 'Low Confidence in {n}'")
    return "CASE " + " ".join(lines) + " ELSE 'No Clear Dominant Outcome - Close Call' END"


def _md5_number(key: str) -> str:
    return f"row_number() OVER (ORDER BY md5(CAST({key} AS VARCHAR)))"


_STORED_GROUPS = (
    "stored_groups AS (SELECT id, name FROM grp WHERE id IN "
    "(SELECT group_id FROM facts WHERE cohort_id = 1995))"
)
_STORED_STUDENTS = "stored AS (SELECT * FROM facts WHERE cohort_id <= 1997)"
_ASSESSED = "assessed AS (SELECT * FROM facts WHERE cohort_id < 1997)"
_METRIC_ROWS = [
    ("Total Students", "count(*)"),
    ("Average CCert", "avg(CASE WHEN grade >= 3 THEN c_cert END)"),
    ("Pass Rate (%)", "count(CASE WHEN grade >= 3 THEN 1 END) / count(*) * 100"),
    ("Average Passing Grade", "max((SELECT avg(grade) FROM cohort WHERE grade >= 3))"),
    ("Average Passing Grade ({c})", "avg(CASE WHEN grade >= 3 THEN grade END)"),
    ("Pass Rate ({c}) (%)", "count(CASE WHEN grade >= 3 THEN 1 END) / count(*) * 100"),
]


def _cohort_stats() -> str:
    rows = [
        f"SELECT '{c}' AS course, '{m.format(c=c)}' AS metric, round(CAST({v} AS DOUBLE), 6) AS value "
        f"FROM cohort WHERE course = '{c}'"
        for c in COURSES
        for m, v in _METRIC_ROWS
    ]
    return " UNION ALL ".join(rows)


def _stats_cross() -> str:
    columns = [
        "CAST(count(CASE WHEN grade >= 3 THEN 1 END) AS BIGINT) AS pass_count",
        "round(avg(CASE WHEN grade >= 3 THEN grade END), 6) AS avg_pass_grade",
    ]
    for c in COURSES:
        here = f"course = '{c}'"
        n = c.lower()
        columns += [
            f"CAST(count(CASE WHEN {here} THEN 1 END) AS BIGINT) AS total_{n}",
            f"round(avg(CASE WHEN {here} AND grade >= 3 THEN c_cert END), 6) AS avg_cert_{n}",
            f"round(avg(CASE WHEN {here} AND grade >= 3 THEN grade END), 6) AS avg_grade_{n}",
            f"CAST(count(CASE WHEN {here} AND grade >= 3 THEN 1 END) AS BIGINT) AS pass_count_{n}",
        ]
    return f"SELECT {', '.join(columns)} FROM cohort"


_COHORT_ROWS = f"cohort AS (SELECT * FROM facts {_OF_COHORT})"
_GLOBAL_LIST = ", ".join(f"'{g}'" for g in GLOBAL)
_BEST_COLS = ["performance", "name", "student_count", "avg_passing_grade", "passing_rate", "weighted_score"]


def _top_group(order: str, performance: str) -> str:
    return (
        f"SELECT group_id, name, student_count, round(avg_passing_grade * 5 / 100, 6) AS avg_passing_grade, "
        f"passing_rate, avg_cert_grade, weighted_score, '{performance}' AS performance FROM card "
        f"ORDER BY {order} LIMIT 1"
    )


def _transposed() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS metric, CAST({c} AS VARCHAR) AS value FROM best" for c in _BEST_COLS
    )
    best = (
        "best AS (SELECT *, 'Best' AS performance FROM (SELECT group_id, name, student_count, "
        "avg_passing_grade * 5 / 100 AS avg_passing_grade, passing_rate, weighted_score FROM card "
        "ORDER BY weighted_score DESC NULLS LAST, group_id LIMIT 1))"
    )
    return _with(FACTS, GROUPS, _scorecard(COHORT), best) + parts


def _group_vs_overall() -> str:
    columns = ["group_id", "name"]
    for m in MEASURE_COLS:
        columns += [
            f'round(p."{m}", 8) AS "{m}"',
            f'round(o."{m}", 8) AS "{m}_average"',
            f'round(CASE WHEN o."{m}" <> 0 THEN (p."{m}" - o."{m}") / o."{m}" * 100 END, 8) AS "{m}_difference"',
        ]
    return _with(*_STAR_WITH, PROFILES, OVERALL) + f"SELECT {', '.join(columns)} FROM profiles p, overall o"


def _kpi() -> str:
    rows = []
    for m in [column_name(k) for k in KPI_MEASURES]:
        rows.append(
            f"SELECT '{m}' AS attribute, round(p.\"{m}\", 6) AS group_value, round(o.\"{m}\", 6) AS overall_value, "
            f"round(CASE WHEN o.\"{m}\" <> 0 THEN (p.\"{m}\" - o.\"{m}\") / o.\"{m}\" * 100 END, 6) AS difference "
            "FROM one p, overall o"
        )
    one = f"one AS (SELECT {_AGGS} FROM star WHERE group_id = 1)"
    return _with(*_STAR_WITH, OVERALL, one) + " UNION ALL ".join(rows)


def _sql() -> dict[str, str]:
    f = _with(FACTS)
    q: dict[str, str] = {}
    # Sources and sinks
    q["scan_profile"] = _with(FACTS, PROFILE) + (
        f"SELECT id_number, previous_school, course, cfit, {ATTRS} FROM prof"
    )
    q["scan_results"] = _with(FACTS, RESULTS) + (
        "SELECT id_number, c_cert, CASE WHEN is_inc THEN TRUE WHEN grade IS NOT NULL THEN FALSE END AS is_open, "
        "round(grade, 6) AS grade FROM res"
    )
    q["scan_csv"] = _with(FACTS, RESULTS) + "SELECT id_number, c_cert FROM res"
    q["scan_facts"] = f + (
        f"SELECT student_id, student_key, group_id, cohort_id, course, cfit, round(grade, 6) AS grade, c_cert, {ATTRS} "
        f"FROM facts WHERE group_id IS NOT NULL AND c_cert IS NOT NULL AND {_ATTR_FILLED}"
    )
    q["list_groups"] = _with(GROUPS) + "SELECT id, name FROM grp"
    q["list_cohorts"] = _with(COHORTS) + "SELECT id, name FROM cohorts"
    q["scan_score_input"] = _with(FACTS, PROFILE) + (
        f"SELECT id_number, cfit, {ATTRS} FROM prof WHERE {_ATTR_FILLED}"
    )
    q["sink_csv"] = _card(COHORT) + "SELECT * FROM card"
    q["metrics_log"] = f + (
        "SELECT 'passers' AS metric, CAST(count(*) AS DOUBLE) AS value FROM facts WHERE grade >= 3 AND cohort_id = 2000 "
        "UNION ALL SELECT 'mean', round(avg(grade), 6) FROM facts WHERE grade >= 3 AND cohort_id = 2000"
    )
    codes = " UNION ALL ".join(
        f"SELECT '{a}' AS code, CAST(count(attr_{a}) AS BIGINT) AS n_values, round(avg(attr_{a}), 6) AS mean_value FROM facts"
        for a in ATTRIBUTES
    )
    q["factor_dim_join"] = f + (
        f"SELECT CASE WHEN code IN ({_GLOBAL_LIST}) THEN 'global' ELSE 'primary' END AS factor_group, * FROM ({codes})"
    )
    # Projections, filters, predicates
    q["positional_rename"] = f + f"SELECT student_id, {ATTRS} FROM facts"
    q["not_null_filter"] = _with(FACTS, RESULTS) + "SELECT id_number, c_cert FROM res WHERE c_cert IS NOT NULL"
    q["null_safe_ne"] = _with(FACTS, RESULTS) + (
        "SELECT id_number, grade IS NULL AS is_missing FROM res WHERE NOT is_inc"
    )
    q["strict_cast"] = _with(FACTS, RESULTS, CLEAN) + "SELECT id_number, round(grade, 6) AS grade FROM clean"
    q["coerce_cast"] = _with(FACTS, RESULTS) + "SELECT id_number, round(grade, 6) AS grade FROM res"
    q["dropna_any"] = f + (
        "SELECT student_id, attr_A, attr_B, c_cert, group_id FROM facts WHERE attr_A IS NOT NULL "
        "AND attr_B IS NOT NULL AND c_cert IS NOT NULL AND group_id IS NOT NULL"
    )
    q["filter_in"] = f + (
        "SELECT student_id, cohort_id, cfit FROM facts WHERE cohort_id IN (1995, 1996, 1997, 1998, 1999, 2000) "
        "AND cfit IN ('L', 'BA', 'A', 'AA', 'H')"
    )
    q["filter_cohort"] = f + f"SELECT student_id, group_id, round(grade, 6) AS grade FROM facts {_OF_COHORT}"
    q["filter_courses"] = _with(FACTS, EXPLORE) + (
        "SELECT round(weighted, 6) AS weighted, attr_A, attr_B, course FROM explore WHERE course IN ('BSCS')"
    )
    q["ordinal_encode"] = f + (
        f"SELECT student_id, {_band('NULL')} AS band_or_null, {_band('0')} AS band_or_zero FROM facts"
    )
    q["indicator_cols"] = f + (
        "SELECT student_id, CASE WHEN course = 'BSCS' THEN 1 ELSE 0 END AS course_bscs, "
        "CASE WHEN course = 'BSIT' THEN 1 ELSE 0 END AS course_bsit FROM facts"
    )
    q["discretize"] = f + (
        f"SELECT student_id, {_label(_SPAN)} AS label, {_label(_SPAN, high='85')} AS label_85, "
        f"{_label(_SPAN, high='95')} AS label_95, {_label('(grade / 5 * 100 * 1.1e0)')} AS label_over FROM facts"
    )
    q["normalize_grade"] = f + (
        f"SELECT student_id, round({_SPAN}, 6) AS span, round(grade / 5 * 100, 6) AS share, "
        "round(grade / 5 * 70 + c_cert / 80 * 30, 6) AS blend FROM facts"
    )
    q["composite_score"] = f + f"SELECT student_id, {_COMPOSITE} AS weighted_score FROM facts"
    q["percent_difference"] = f + (
        "SELECT group_id, round((rate - overall) / overall * 100, 6) AS from_overall, "
        "round((rate - bsit) / nullif(bsit, 0) * 100, 6) AS from_bsit FROM ("
        "SELECT group_id, sum(CASE WHEN grade >= 3 THEN 1 ELSE 0 END) / count(*) * 100 AS rate, "
        "sum(CASE WHEN grade >= 3 AND course = 'BSIT' THEN 1 ELSE 0 END) "
        "/ nullif(count(*) FILTER (course = 'BSIT'), 0) * 100 AS bsit, "
        "(SELECT sum(CASE WHEN grade >= 3 THEN 1 ELSE 0 END) / count(*) * 100 FROM facts "
        "WHERE group_id IS NOT NULL) AS overall "
        "FROM facts WHERE group_id IS NOT NULL GROUP BY group_id)"
    )
    q["unpivot_attributes"] = _with(*_STAR_WITH, PROFILES) + (
        "SELECT group_id, attribute, round(value, 6) AS value FROM (" + _unpivoted("profiles", SCORE_COLS) + ")"
    )
    q["transpose_metrics"] = _transposed()
    q["domain_violations"] = f + (
        "SELECT cfit, CAST(count(*) AS BIGINT) AS n_rows FROM facts WHERE cfit IS NULL OR cfit NOT IN "
        "('A', 'AA', 'BA', 'H', 'L') GROUP BY cfit"
    )
    # Joins
    q["merge_results"] = _with(FACTS, PROFILE, RESULTS, CLEAN) + (
        "SELECT id_number, canonical_school AS previous_school, attr_C, c_cert, round(grade, 6) AS grade "
        "FROM prof JOIN clean USING (id_number)"
    )
    q["merge_cert"] = _with(FACTS, PROFILE, RESULTS) + (
        "SELECT id_number, course, c_cert FROM prof JOIN res USING (id_number) WHERE c_cert IS NOT NULL"
    )
    q["join_facts"] = f + (
        "SELECT s.student_id, s.student_key, s.cohort_id, a.c_cert, round(a.grade, 6) AS grade "
        "FROM facts s JOIN facts a ON a.student_id = s.student_id"
    )
    q["join_star3"] = _with(FACTS, GROUPS) + (
        "SELECT s.student_id, s.group_id, grp.name AS group_name, s.cohort_id, a.c_cert FROM facts s "
        "JOIN facts a ON a.student_id = s.student_id JOIN grp ON grp.id = s.group_id"
    )
    q["join_star4"] = _with(FACTS, GROUPS, COHORTS) + (
        "SELECT s.student_id, grp.name AS group_name, cohorts.name AS cohort_name, s.course FROM facts s "
        "JOIN facts a ON a.student_id = s.student_id JOIN grp ON grp.id = s.group_id "
        "JOIN cohorts ON cohorts.id = s.cohort_id"
    )
    q["left_join_reduced"] = f + (
        "SELECT a.student_id, s.cohort_id, a.c_cert, round(a.grade, 6) AS grade FROM facts a "
        f"LEFT JOIN facts s ON s.student_id = a.student_id WHERE s.cohort_id = {COHORT}"
    )
    q["stats_cross"] = _with(FACTS, _COHORT_ROWS) + _stats_cross()
    q["lookup_group_id"] = _with(FACTS, PROFILE, GROUPS) + (
        "SELECT id_number, grp.id AS group_id FROM prof LEFT JOIN grp ON grp.name = prof.previous_school"
    )
    q["anti_existing"] = _with(FACTS, _STORED_STUDENTS, _ASSESSED) + (
        "SELECT student_key, cohort_id FROM facts WHERE student_key NOT IN "
        "(SELECT s.student_key FROM stored s JOIN assessed a ON a.student_id = s.student_id)"
    )
    q["resolve_students"] = _with(FACTS, _STORED_STUDENTS) + (
        "SELECT f.student_key AS id_number, s.student_id FROM facts f "
        "LEFT JOIN stored s ON s.student_key = f.student_key"
    )
    q["expand_courses"] = f + (
        "SELECT student_id, cfit, c.course FROM (SELECT student_id, cfit FROM facts) x, "
        "(VALUES ('BSCS'), ('BSIT')) c(course)"
    )
    q["compare_long"] = _with(*_STAR_WITH, PROFILES, OVERALL) + (
        "SELECT g.group_id, g.attribute, round(g.value, 6) AS group_value, round(o.value, 6) AS overall_value FROM ("
        + _unpivoted("profiles", SCORE_COLS) + ") g JOIN (" + _unpivoted("overall", SCORE_COLS, "")
        + ") o ON o.attribute = g.attribute"
    )
    # Aggregations
    q["group_scorecard"] = _card(COHORT) + "SELECT * FROM card"
    q["group_scorecard_all"] = _card(None) + "SELECT * FROM card"
    q["conditional_aggs"] = f + (
        "SELECT cohort_id, course, CAST(count(*) AS BIGINT) AS student_count, "
        "CAST(sum(CASE WHEN grade >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS pass_count, "
        "round(avg(CASE WHEN grade >= 3 THEN grade END), 6) AS mean_passing_grade, "
        "round(sum(CASE WHEN grade >= 3 THEN 1 ELSE 0 END) / count(*) * 100, 6) AS passing_rate, "
        "round(avg(c_cert), 6) AS mean_cert FROM facts GROUP BY cohort_id, course"
    )
    q["cohort_stats"] = _with(FACTS, _COHORT_ROWS) + _cohort_stats()
    q["group_profile"] = _with(*_STAR_WITH, PROFILES) + (
        f"SELECT group_id, name, {_rounded(MEASURE_COLS)} FROM profiles"
    )
    q["group_profile_one"] = _with(*_STAR_WITH) + (
        f"SELECT {_rounded(MEASURE_COLS)} FROM (SELECT {_AGGS} FROM star WHERE group_id = 1)"
    )
    q["overall_profile"] = _with(*_STAR_WITH, OVERALL) + f"SELECT {_rounded(MEASURE_COLS)} FROM overall"
    q["group_vs_overall"] = _group_vs_overall()
    q["kpi_comparison"] = _kpi()
    q["corr_matrix"] = _with(FACTS, _COHORT_ROWS) + (
        "SELECT * FROM " + _pairs("cohort", [(x, y) for x in _ALL for y in _ALL], "x", "y")
    )
    q["corr_targets"] = _with(FACTS, _COHORT_ROWS) + (
        "SELECT * FROM " + _pairs("cohort", _target_pairs(ATTR_COLS, TARGETS), "attribute", "target")
    )
    q["corr_extremes"] = _with(FACTS, COMPOSED, _extremes(_OF_COHORT)) + " UNION ALL ".join(
        "SELECT * FROM "
        + _pairs(
            f"(SELECT * FROM sides WHERE side = '{side}')",
            _target_pairs(ATTR_COLS, TARGETS),
            "attribute",
            "target",
            f", '{side}' AS side",
        )
        for side in ("top", "bottom")
    )
    q["corr_by_attribute"] = _with(FACTS, EXPLORE) + (
        "SELECT * FROM " + _pairs("explore", _target_pairs([*ATTR_COLS, "cfit"], ["weighted"]), "attribute", "target")
    )
    q["sort_by_attribute"] = _with(FACTS, EXPLORE) + (
        "SELECT round(weighted, 6) AS weighted, attr_A, course FROM explore ORDER BY attr_A"
    )
    q["grade_summary"] = _with(FACTS, EXPLORE) + (
        "SELECT round(avg(weighted), 6) AS mean, round(median(weighted), 6) AS median, "
        "round(min(weighted), 6) AS minimum, round(max(weighted), 6) AS maximum FROM explore"
    )
    top = _with(FACTS, COMPOSED, _extremes(""))
    q["factor_means"] = top + " UNION ALL ".join(
        f"SELECT '{c}' AS factor, round(avg({c}), 6) AS mean FROM sides WHERE side = 'top'" for c in FACTORS
    )
    diffs = " UNION ALL ".join(
        f"SELECT '{c}' AS factor, avg(CASE WHEN side = 'top' THEN {c} END) - "
        f"avg(CASE WHEN side = 'bottom' THEN {c} END) AS d FROM sides"
        for c in FACTORS
    )
    q["factor_contrast"] = top + (
        "SELECT factor, round(sign(p) * p * p, 6) AS contrast FROM "
        f"(SELECT factor, d + 0.1e0 * sign(d) AS p FROM ({diffs}))"
    )
    q["distinct_groups"] = _with(FACTS, PROFILE) + (
        "SELECT DISTINCT canonical_school AS name FROM prof WHERE canonical_school IS NOT NULL"
    )
    # Ranks, top-k, set operations
    q["group_rank"] = _card(None) + (
        "SELECT group_id, name, student_count, weighted_score, CAST(CASE WHEN weighted_score IS NOT NULL THEN "
        "dense_rank() OVER (ORDER BY weighted_score DESC NULLS LAST) END AS INT) AS rank FROM card"
    )
    q["best_group"] = _card(COHORT) + _top_group("weighted_score DESC NULLS LAST, group_id", "Best")
    q["worst_group"] = _card(COHORT) + _top_group("weighted_score ASC NULLS FIRST, group_id", "Worst")
    q["top10_groups"] = _card(COHORT) + (
        "SELECT group_id, name, student_count, round_even(avg_passing_grade * 5 / 100 * 100, 0) / 100 AS avg_passing_grade, "
        "passing_rate, avg_cert_grade, weighted_score FROM card "
        "ORDER BY weighted_score DESC NULLS LAST, group_id LIMIT 10"
    )
    q["top10_students"] = _with(FACTS, GROUPS, COMPOSED) + (
        "SELECT student_key, course, grp.name AS group_name, c_cert, round(grade, 6) AS grade, weighted_score "
        "FROM composed JOIN grp ON grp.id = group_id "
        "ORDER BY weighted_score DESC NULLS LAST, student_key LIMIT 10"
    )
    q["extremes_cohort"] = _with(FACTS, COMPOSED, _extremes(_OF_COHORT)) + (
        "SELECT side, student_id, c_cert, round(grade, 6) AS grade, weighted_score FROM sides"
    )
    q["extremes_union"] = top + f"SELECT student_key, weighted_score, cfit_rank, {ATTRS}, side FROM sides"
    q["append_courses"] = f + (
        "SELECT student_key AS id_number, course, CASE course WHEN 'BSCS' THEN 0 ELSE 1 END AS course_order FROM facts"
    )
    # Scalar functions
    q["str_trim"] = _with(FACTS, PROFILE) + "SELECT id_number, previous_school FROM prof"
    q["canonicalize_names"] = f"SELECT c_custkey AS id, {CANONICAL} AS name FROM customer"
    q["rounding"] = (
        "SELECT o_orderkey AS student_id, round(o_totalprice / 7, 2) AS half_up, "
        "round_even(o_totalprice / 7, 2) AS half_even, "
        "round_even(o_totalprice / 7 * 100, 0) / 100 AS binary FROM orders"
    )
    q["log_target"] = f + (
        "SELECT student_id, round(w, 6) AS weighted, round(ln(w), 6) AS log_target, "
        "round(exp(ln(w)), 6) AS restored FROM (SELECT student_id, grade / 5 * 100 AS w FROM facts)"
    )
    q["pct_format"] = (
        "SELECT o_orderkey AS student_id, CAST(round_even(o_totalprice / 500000 * 100 * 100, 0) / 100 AS VARCHAR) || '%' AS confidence "
        "FROM orders"
    )
    q["name_pattern"] = _with(GROUPS) + "SELECT id, name FROM grp WHERE NOT regexp_matches(name, '0[1-4]|99')"
    q["concat_rows"] = _with(FACTS, TRAINING) + 'SELECT student_id, attr_C, "cfit_H", label FROM training'
    # Repeatable load
    q["upsert_groups"] = _with(FACTS, PROFILE, GROUPS, _STORED_GROUPS) + (
        f"SELECT (SELECT max(id) FROM stored_groups) + {_md5_number('name')} AS id, name FROM "
        "(SELECT DISTINCT canonical_school AS name FROM prof WHERE canonical_school IS NOT NULL "
        "AND canonical_school NOT IN (SELECT name FROM stored_groups))"
    )
    q["upsert_students"] = _with(FACTS, PROFILE, GROUPS, _STORED_STUDENTS) + (
        f"SELECT (SELECT max(student_id) FROM stored) + {_md5_number('id_number')} AS id, id_number AS student_key, "
        f"grp.id AS group_id, CAST({COHORT} AS BIGINT) AS cohort_id, course FROM prof "
        "LEFT JOIN grp ON grp.name = canonical_school "
        "WHERE id_number NOT IN (SELECT student_key FROM stored)"
    )
    q["append_assessments"] = _with(FACTS, PROFILE, RESULTS, CLEAN, _STORED_STUDENTS, _ASSESSED) + (
        f"SELECT (SELECT max(student_id) FROM assessed) + {_md5_number('row_no')} AS id, student_id, cfit, "
        f"{ATTRS}, c_cert, round(grade, 6) AS grade FROM (SELECT p.*, c.c_cert, c.grade, s.student_id "
        "FROM prof p JOIN clean c USING (id_number) JOIN (SELECT student_key, student_id FROM stored) s "
        "ON s.student_key = id_number WHERE id_number NOT IN (SELECT student_key FROM assessed))"
    )
    empty = ", ".join(f"CAST(NULL AS INT) AS {a}" for a in ATTR_COLS)
    q["conform_columns"] = f + (
        f"SELECT student_id AS id, student_id, cfit, {empty}, CAST(NULL AS INT) AS c_cert, round(grade, 6) AS grade FROM facts"
    )
    for name in ("load_twice", "load_committed", "load_arriving"):
        q[name] = _with(FACTS, PROFILE, RESULTS, CLEAN) + (
            "SELECT id_number AS student_key, course, canonical_school AS group_name, '2000' AS cohort_name, cfit, "
            f"{ATTRS}, c.c_cert, round(c.grade, 6) AS grade FROM prof JOIN clean c USING (id_number)"
        )
    # Features and labels
    q["one_hot_fixed"] = f + (
        "SELECT student_id, "
        + ", ".join(f"CASE WHEN cfit = '{x}' THEN 1 ELSE 0 END AS \"cfit_{x}\"" for x in BANDS)
        + " FROM facts"
    )
    t = _with(FACTS, TRAINING)
    q["training_features"] = t + "SELECT * REPLACE (round(weighted, 6) AS weighted) FROM training"
    q["binary_targets"] = t + (
        "SELECT student_id, label, CAST(label = 0 AS DOUBLE) AS target_fail, CAST(label = 1 AS DOUBLE) AS target_pass, "
        "CAST(label = 2 AS DOUBLE) AS target_success FROM training"
    )
    q["one_hot_label"] = t + (
        "SELECT student_id, "
        + ", ".join(f"CASE WHEN label = {k} THEN 1 ELSE 0 END AS label_{k}" for k in range(3))
        + " FROM training"
    )
    q["split_hash"] = t + f"SELECT student_id, {_bucket('student_id')} = 0 AS is_test FROM training"
    held = _bucket("'held-out-' || student_id")
    q["held_out_rows"] = t + f"SELECT student_id, {held} = 0 AS is_held_out FROM training"
    q["fold_assign"] = t + f"SELECT student_id, {_bucket('student_id')} AS fold FROM training"
    q["vector_cells"] = t + " UNION ALL ".join(
        f'SELECT student_id, {k} AS position, "{name}" AS value FROM training' for k, name in enumerate(FEATURES)
    )
    q["oversample_counts"] = t + (
        "SELECT label, max(count(*)) OVER () AS n_rows, max(count(*)) OVER () - count(*) AS n_new "
        "FROM training WHERE label IS NOT NULL GROUP BY label"
    )
    q["probability_sums"] = t + (
        f"SELECT student_id, 3 AS n_classes, 1.0e0 AS total FROM training WHERE {_bucket('student_id')} = 0"
    )
    q["scored_students"] = f + f"SELECT student_key AS id_number, TRUE AS has_verdicts FROM facts WHERE {_ATTR_FILLED}"
    fixed = _with(FIXED)
    right = "CAST(best = label AS DOUBLE)"
    by_fold = f"SELECT fold, avg({right}) AS accuracy, avg(-ln(greatest(own, 1e-15))) AS loss FROM fixed GROUP BY fold"
    q["fixed_metrics"] = fixed + f"SELECT fold, round(accuracy, 6) AS accuracy, round(loss, 6) AS loss FROM ({by_fold})"
    q["fixed_fold_summary"] = fixed + (
        "SELECT round(avg(accuracy), 6) AS mean_accuracy, round(avg(loss), 6) AS mean_loss, "
        f"round(stddev_pop(accuracy), 6) AS std_accuracy, round(stddev_pop(loss), 6) AS std_loss FROM ({by_fold})"
    )
    q["fixed_classes"] = fixed + "SELECT vec_id, label, best AS predicted FROM fixed"
    q["fixed_audit"] = fixed + (
        "SELECT vec_id, round(fail, 6) AS confidence_to_fail, round(pass, 6) AS confidence_to_pass, "
        "round(success, 6) AS confidence_to_excel, round(weighted / 100 * 5, 6) AS original FROM fixed"
    )
    q["fixed_corr_scores"] = fixed + (
        "SELECT * FROM " + _pairs("fixed", [(x, y) for x in BASE_SCORES for y in BASE_SCORES], "x", "y")
    )
    q["fixed_base_metrics"] = fixed + " UNION ALL ".join(
        f"SELECT '{name}' AS model, round(avg(CAST(({name} >= 0.5e0) = (label = {k}) AS DOUBLE)), 6) AS accuracy, "
        f"round(avg(-ln(greatest(CASE WHEN label = {k} THEN {name} ELSE 1 - {name} END, 1e-15))), 6) AS loss FROM fixed"
        for k, name in enumerate(BASE_SCORES)
    )
    q["fixed_errors"] = fixed + (
        "SELECT fold, round(avg((weighted - prediction) * (weighted - prediction)), 6) AS loss, "
        "round(avg(abs(weighted - prediction)), 6) AS mae FROM fixed GROUP BY fold"
    )
    q["fixed_gaps"] = fixed + " UNION ALL ".join(
        f"SELECT model AS fold, '{name}' AS measure, round(train, 6) AS train, round(validation, 6) AS validation, "
        f"round(train - validation, 6) AS gap FROM (SELECT model, avg({value}) FILTER (fold <> model) AS train, "
        f"avg({value}) FILTER (fold = model) AS validation "
        "FROM fixed CROSS JOIN (SELECT CAST(unnest(range(5)) AS INT) AS model) GROUP BY model)"
        for name, value in (("accuracy", right), ("mae", "abs(weighted - prediction)"))
    )
    q["model_store"] = t + "SELECT student_id, TRUE AS is_same FROM training"
    ordinal = (
        f" FROM facts WHERE cohort_id BETWEEN 1995 AND 2000 AND cfit IN ('L', 'BA', 'A', 'AA', 'H') AND {_ATTR_FILLED}"
    )
    q["forest_test_rows"] = (
        f"{f}SELECT student_id, round(grade / 5 * 100, 6) AS actual{ordinal} AND grade > 0 "
        f"AND {_bucket('student_id')} = 0"
    )
    q["audit_originals"] = f"{f}SELECT student_id, round(grade, 6) AS original{ordinal}"
    q["rank_of_one_group"] = _card(None) + (
        "SELECT * FROM (SELECT group_id, CASE WHEN weighted_score IS NOT NULL THEN CAST(dense_rank() OVER "
        "(ORDER BY weighted_score DESC NULLS LAST) AS INT) END AS rank FROM card) WHERE group_id = 1"
    )
    q["compare_one_group"] = _with(*_STAR_WITH, PROFILES, OVERALL) + (
        "SELECT g.attribute, round(g.value, 6) AS group_value, round(o.value, 6) AS overall_value FROM ("
        + _unpivoted("profiles", SCORE_COLS) + ") g JOIN (" + _unpivoted("overall", SCORE_COLS, "")
        + ") o ON o.attribute = g.attribute WHERE g.group_id = 1"
    )
    q["rejected_rows"] = _with(FACTS, _STORED_STUDENTS) + (
        "SELECT student_key, course FROM facts WHERE student_key NOT IN (SELECT student_key FROM stored)"
    )
    q["text_cells"] = (
        "SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN '  ' || c_name || ' ' || chr(9) "
        "WHEN 1 THEN c_name || '\"quoted\", with a comma' WHEN 2 THEN c_name || chr(10) || 'second line' "
        "WHEN 3 THEN '' WHEN 4 THEN NULL ELSE c_name || chr(92) END AS cell FROM customer"
    )
    e = [f"abs(CAST(embedding[{k + 1}] AS DOUBLE))" for k in range(6)]
    total = f"({e[0]} + {e[1]} + {e[2]})"
    q["verdict"] = (
        f"SELECT vec_id, {_verdict([f'{e[k]} / {total}' for k in range(3)])} AS verdict_of_shares, "
        f"{_verdict([f'{e[k]} * 4' for k in range(3, 6)])} AS verdict_of_free FROM embeddings"
    )
    return q


ORACLES = _sql()
