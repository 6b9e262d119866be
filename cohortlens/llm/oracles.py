"""DuckDB SQL for the quality rules: the base figures and the estimates, step by step."""

from __future__ import annotations

import math

from cohortlens.llm import outliers as o

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEYS = "lang, own, source"


def _same(left: str, right: str, keys: str = _KEYS) -> str:
    return " AND ".join(f"{left}.{k} IS NOT DISTINCT FROM {right}.{k}" for k in keys.split(", "))


def _base() -> str:
    words, lines = o.USUAL_WORDS, o.USUAL_LINES
    chars = f"(word_chars + {o.USUAL_LENGTH * words}::DOUBLE)"
    share = f"(n_words + {words})"
    values = {
        "x_length": f"ln({chars} / {share})",
        "x_symbols": f"ln(1 + n_symbols / {share})",
        "x_lines": f"sqrt(n_dup_lines / (n_lines + {lines}))",
        "x_repeats": f"sqrt(n_repeat_words / {share})",
        "x_upper": f"sqrt(n_upper / {chars})",
    }
    vector = ", ".join(f"CAST(round({o.UNIT} * {v}) AS BIGINT) AS {k}" for k, v in values.items())
    return f"""docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS said, trim(coalesce(text, ''), {_BLANKS}) AS inner_text FROM documents),
worded AS (SELECT *, CASE WHEN inner_text = '' THEN []::VARCHAR[]
    ELSE string_split_regex(inner_text, '[ \\t\\n\\x0b\\x0c\\r]+') END AS words FROM docs),
runs AS (SELECT doc_id, i, array_to_string(words[i:i + {o.WINDOW - 1}], ' ') AS run
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - {o.WINDOW - 2})) AS i FROM worded)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS c FROM runs) WHERE c > 1),
covered AS (SELECT doc_id, sum(least({o.WINDOW}, coalesce(after - i, {o.WINDOW}))) AS n
    FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM twice) GROUP BY doc_id),
lined AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(said, chr(10))) AS line FROM docs) WHERE trim(line, {_BLANKS}) <> ''
    GROUP BY doc_id),
base AS (SELECT doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(said, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(said, '[^A-Z]', '', 'g')) AS n_upper,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM worded LEFT JOIN covered USING (doc_id) LEFT JOIN lined USING (doc_id)),
measured AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {vector} FROM base),
large AS (SELECT lang, source FROM measured WHERE NOT base_failed GROUP BY ALL HAVING count(*) >= {o.MIN_GROUP}),
placed AS (SELECT m.* EXCLUDE (source), l.n IS NOT NULL AS own, CASE WHEN l.n IS NOT NULL THEN m.source END AS source
    FROM measured m LEFT JOIN (SELECT *, 1 AS n FROM large) l ON {_same("m", "l", "lang, source")}),
enough AS (SELECT {_KEYS} FROM placed WHERE NOT base_failed GROUP BY ALL HAVING count(*) >= {o.MIN_GROUP}),
vectors AS (SELECT p.* FROM placed p JOIN enough e ON {_same("p", "e")} WHERE NOT base_failed)"""


def _grade(value: str) -> str:
    return f"CAST(floor(256 * log2(1 + {value})) AS INT)"


def _starts() -> str:
    quartiles = ", ".join(f"quantile_cont({d}, [0.25, 0.5, 0.75]) AS q_{d}" for d in o.DIMS)
    scaled = [
        f"pow(({d} - q_{d}[2]) / greatest((q_{d}[3] - q_{d}[1]) / 1.349::DOUBLE, {floor}.0::DOUBLE), 2)"
        for d, floor in o.FLOORS.items()
    ]
    total, most = " + ".join(scaled), f"greatest({', '.join(scaled)})"
    return f"""middle AS (SELECT {_KEYS}, {quartiles} FROM vectors GROUP BY ALL),
rows_0 AS (SELECT v.*, start, CASE start WHEN 0 THEN {_grade(f"({total})")} ELSE {_grade(most)} END AS grade
    FROM vectors v JOIN middle m ON {_same("v", "m")}, (VALUES (0), (1)) s(start))"""


def _solved(rows: str, facts: str, keys: str, columns: str, scale: str = "1.0::DOUBLE") -> str:
    """``rows`` with their squared distance by their group's mean and factor."""
    query = f"SELECT r.*, {', '.join(f'f.m_{d}' for d in o.DIMS)}, " + ", ".join(
        f"f.l_{a}_{b} * {scale} AS l_{a}_{b}" for i, a in enumerate(o.DIMS) for b in o.DIMS[: i + 1]
    )
    query += f" FROM {rows} r LEFT JOIN {facts} f ON {_same('r', 'f', keys)}"
    for i, a in enumerate(o.DIMS):
        below = "".join(f" - l_{a}_{b} * y_{b}" for b in o.DIMS[:i])
        query = f"SELECT *, ({a} - m_{a}{below}) / l_{a}_{a} AS y_{a} FROM ({query})"
    return f"SELECT {columns}, {' + '.join(f'y_{a} * y_{a}' for a in o.DIMS)} AS d2 FROM ({query})"


def _step(number: int) -> str:
    keys = f"{_KEYS}, start"
    sums = ", ".join(f"sum({d}) / count(*) AS m_{d}" for d in o.DIMS)
    products = ", ".join(
        f"sum({a} * {b}) / count(*) - (sum({a}) / count(*)) * (sum({b}) / count(*))"
        + (f" + {o.FLOORS[a] ** 2}.0::DOUBLE" if a == b else "")
        + f" AS c_{a}_{b}"
        for i, a in enumerate(o.DIMS)
        for b in o.DIMS[: i + 1]
    )
    query = f"SELECT {keys}, {sums}, {products} FROM near_{number} GROUP BY ALL"
    for j, b in enumerate(o.DIMS):
        rest = "".join(f" - l_{b}_{c} * l_{b}_{c}" for c in o.DIMS[:j])
        query = f"SELECT *, sqrt(greatest(c_{b}_{b}{rest}, 1.0::DOUBLE)) AS l_{b}_{b} FROM ({query})"
        for a in o.DIMS[j + 1 :]:
            rest = "".join(f" - l_{a}_{c} * l_{b}_{c}" for c in o.DIMS[:j])
            query = f"SELECT *, (c_{a}_{b}{rest}) / l_{b}_{b} AS l_{a}_{b} FROM ({query})"
    logs = " + ".join(f"ln(l_{a}_{a})" for a in o.DIMS)
    text = f"""cut_{number} AS (SELECT {keys}, quantile_cont(grade, {o.SUBSET}) AS cut FROM rows_{number} GROUP BY ALL),
near_{number} AS (SELECT r.* FROM rows_{number} r JOIN cut_{number} c ON {_same("r", "c", keys)} WHERE grade <= cut),
factor_{number} AS (SELECT *, 2 * ({logs}) AS log_det FROM ({query}))"""
    if number + 1 < o.STEPS:
        columns = f"{keys}, {', '.join(o.DIMS)}"
        solved = _solved(f"rows_{number}", f"factor_{number}", keys, columns)
        text += f",\nrows_{number + 1} AS (SELECT * EXCLUDE (d2), {_grade('d2')} AS grade FROM ({solved}))"
    return text


def quality_rules() -> str:
    last = o.STEPS - 1
    dims = len(o.DIMS)
    scale = math.sqrt(o.SUBSET / o.chi_square_share(o.chi_square_cut(o.SUBSET, dims), dims + 2))
    cut = math.sqrt(o.chi_square_cut(1 - o.TAIL, dims))
    base = ", ".join(o.BASE)
    solved = _solved("placed", "best", _KEYS, f"doc_id, {base}, base_failed", f"{scale!r}::DOUBLE")
    steps = ",\n".join(_step(k) for k in range(o.STEPS))
    return f"""WITH {_base()},
{_starts()},
{steps},
best AS (SELECT * FROM factor_{last} QUALIFY row_number() OVER (PARTITION BY {_KEYS} ORDER BY log_det, start) = 1)
SELECT doc_id, {base}, base_failed, round(sqrt(d2), 6) AS distance,
    NOT base_failed AND coalesce(sqrt(d2) <= {cut!r}::DOUBLE, TRUE) AS kept
FROM ({solved})"""
