"""SQL that states the reading of timestamps, numbers, units and names independently of the operators."""

from __future__ import annotations

from vitalframe import dims
from vitalframe.operators.timestamps import ABBREVIATIONS, MONTHS
from vitalframe.operators.units import PARTS, PLAIN, SCIENTIFIC, SPELLINGS


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _lookup(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_quoted(k)} THEN {v}" for k, v in table.items()) + " END"


_MONTH_FIRST = r"^([A-Za-zäÄ]{3,})\.?,? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(.*)$"
_DAY_FIRST = r"^(?:[A-Za-z]{2,}\.?, ?)?(\d{1,2})(?:\.|st|nd|rd|th)? ([A-Za-zäÄ]{3,})\.?,? (\d{4})(.*)$"
_MONTH_ONLY = r"^([A-Za-zäÄ]{3,})\.?,? (\d{4})$"


def _worded(pattern: str, month: int, day: int) -> str:
    part = lambda i: f"regexp_extract(t, '{pattern}', {i})"
    return f"{part(3)} || '-' || ({_lookup(f'lower(substr({part(month)}, 1, 3))', MONTHS)}) || '-' || {part(day)} || {part(4)}"


def stamps(source: str, name: str = "stamps") -> str:
    """CTEs from ``source`` (any columns, text, site_id) to ``name`` with utc_time, utc_date, written_date, is_instant,
    is_epoch, zone_from and the parts that tell of the zone (wall_time, off)."""
    n = name
    return rf"""
{n}_1 AS (SELECT s.*, tz, lower(date_order) AS ord, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM {source} s LEFT JOIN dim_sites USING (site_id)),
{n}_2 AS (SELECT *, regexp_extract(t, '^(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}|\d{{2}})([^\d./-].*)?$', ['a', 'b', 'y', 'rest']) AS x, regexp_matches(t, '^(\d{{10}}|\d{{13}})$') AS epoch FROM {n}_1),
{n}_3 AS (SELECT *, CASE WHEN regexp_matches(t, '^\d{{4}}-\d{{1,2}}-') THEN t WHEN epoch THEN NULL
  WHEN regexp_matches(t, '^\d{{14}}') THEN regexp_replace(t, '^(\d{{4}})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)', '\1-\2-\3 \4:\5:\6')
  WHEN regexp_matches(t, '^(19|20)\d{{6}}$') THEN regexp_replace(t, '^(\d{{4}})(\d\d)(\d\d)$', '\1-\2-\3')
  WHEN regexp_matches(t, '^(19|20)\d{{10}}$') THEN regexp_replace(t, '^(\d{{4}})(\d\d)(\d\d)(\d\d)(\d\d)$', '\1-\2-\3 \4:\5')
  WHEN regexp_matches(t, '^\d{{1,2}}[./-]') THEN CASE WHEN x.y = '' THEN t ELSE (CASE WHEN length(x.y) = 2 THEN '20' ELSE '' END) || x.y || '-' ||
    (CASE WHEN (ord = 'mdy' AND TRY_CAST(x.a AS INT) <= 12) OR (coalesce(ord, 'dmy') <> 'mdy' AND TRY_CAST(x.b AS INT) > 12) THEN x.a || '-' || x.b ELSE x.b || '-' || x.a END) || x.rest END
  WHEN regexp_matches(t, '^\d{{4}}[./]\d{{1,2}}[./]\d{{1,2}}') THEN regexp_replace(t, '^(\d{{4}})[./](\d{{1,2}})[./](\d{{1,2}})', '\1-\2-\3')
  WHEN regexp_matches(t, '^\d{{4}}-\d{{1,2}}$') THEN t || '-1' WHEN regexp_matches(t, '^(19|20)\d{{2}}$') THEN t || '-1-1'
  WHEN regexp_matches(t, '{_MONTH_FIRST}') THEN {_worded(_MONTH_FIRST, 1, 2)} WHEN regexp_matches(t, '{_DAY_FIRST}') THEN {_worded(_DAY_FIRST, 2, 1)}
  WHEN regexp_matches(t, '{_MONTH_ONLY}') THEN regexp_extract(t, '{_MONTH_ONLY}', 2) || '-' || ({_lookup(f"lower(substr(regexp_extract(t, '{_MONTH_ONLY}', 1), 1, 3))", MONTHS)}) || '-1' END AS plain FROM {n}_2),
{n}_4 AS (SELECT *, regexp_extract(trim(plain), '^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[T ]+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}(?:[.,]\d+)?))?)?\s*([A-Za-z]{{0,5}}|[+-]\d{{2}}:?\d{{2}})$', ['yy', 'mo', 'dd', 'hh', 'mi', 'ss', 'zz']) AS p FROM {n}_3),
{n}_5 AS (SELECT *, upper(p.zz) AS rest, p.hh <> '' AS clock, CASE WHEN p.yy <> '' THEN TRY_CAST(p.yy || '-' || lpad(p.mo, 2, '0') || '-' || lpad(p.dd, 2, '0') || ' ' || CASE WHEN p.hh = '' THEN '00:00:00' ELSE lpad(p.hh, 2, '0') || ':' || p.mi || ':' || CASE WHEN p.ss = '' THEN '00' ELSE replace(p.ss, ',', '.') END END AS TIMESTAMP) END AS stamp FROM {n}_4),
{n}_6 AS (SELECT *, CASE WHEN rest IN ('', 'AM', 'PM') THEN NULL WHEN regexp_matches(rest, '^[+-]') THEN (CASE WHEN rest[1] = '-' THEN -1 ELSE 1 END) * (TRY_CAST(substr(rest, 2, 2) AS INT) * 60 + TRY_CAST(right(rest, 2) AS INT)) ELSE {_lookup('rest', ABBREVIATIONS)} END AS written FROM {n}_5),
{n}_7 AS (SELECT *, CASE WHEN epoch THEN 0 ELSE written END AS off, epoch OR (clock AND plain IS NOT NULL) AS timed,
  CASE WHEN epoch THEN TIMESTAMP '1970-01-01' + to_microseconds(TRY_CAST(t AS BIGINT) * CASE WHEN length(t) = 10 THEN 1000000 ELSE 1000 END)
    WHEN (rest IN ('', 'AM', 'PM') OR written IS NOT NULL) AND (rest NOT IN ('AM', 'PM') OR hour(stamp) BETWEEN 1 AND 12) THEN stamp + to_hours(CASE WHEN rest = 'PM' AND hour(stamp) < 12 THEN 12 WHEN rest = 'AM' AND hour(stamp) = 12 THEN -12 ELSE 0 END) END AS wall_time FROM {n}_6),
{n}_8 AS (SELECT *, {wall_to_utc('wall_time', "coalesce(tz, 'UTC')")} AS by_zone FROM {n}_7),
{n} AS (SELECT *, CASE WHEN timed THEN CASE WHEN off IS NOT NULL THEN wall_time - to_minutes(off) ELSE by_zone END END AS utc_time, coalesce(CASE WHEN timed THEN CASE WHEN off IS NOT NULL THEN wall_time - to_minutes(off) ELSE by_zone END END, wall_time)::DATE AS utc_date,
  CASE WHEN NOT epoch THEN wall_time::DATE END AS written_date, coalesce(timed, false) AND wall_time IS NOT NULL AS is_instant, coalesce(epoch, false) AND wall_time IS NOT NULL AS is_epoch,
  CASE WHEN NOT coalesce(timed, false) OR wall_time IS NULL THEN 'none' WHEN off IS NOT NULL THEN 'text' WHEN tz IS NOT NULL THEN 'site' ELSE 'none' END AS zone_from FROM {n}_8)"""


def wall_to_utc(wall: str, zone: str) -> str:
    """A wall time of a zone in UTC; of a repeated hour the earlier instant."""
    later = f"timezone('UTC', timezone({zone}, {wall}))"
    return f"CASE WHEN timezone({zone}, timezone('UTC', {later} - INTERVAL 1 HOUR)) = {wall} THEN {later} - INTERVAL 1 HOUR ELSE {later} END"


def fold_unit(column: str) -> str:
    """One spelling for the usual ways of writing a unit; null where it is null or blank."""
    bare = f"lower(translate({column}, ' \t ', ''))"
    out = rf"regexp_replace(regexp_replace(lower({column}), '\s+per\s+', '/', 'g'), '\s+', '', 'g')"
    for pattern, by in PARTS:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    return f"CASE WHEN {column} IS NULL OR {bare} = '' THEN NULL WHEN {bare} IN ({', '.join(map(_quoted, PLAIN))}) THEN {bare} ELSE {out} END"


_DOUBLE = "TRY_CAST({} AS DOUBLE)"


def _number(raw: str, near: str) -> str:
    comma = _DOUBLE.format(f"replace(replace({raw}, '.', ''), ',', '.')")
    thousands = _DOUBLE.format(f"replace({raw}, ',', '')")
    either = f"CASE WHEN regexp_matches({raw}, '^[+-]?0') THEN {comma} WHEN {near} > 0 AND {comma} > 0 AND {thousands} > 0 AND abs(ln({comma} / {near})) < abs(ln({thousands} / {near})) THEN {comma} ELSE {thousands} END"
    return rf"""CASE WHEN regexp_matches({raw}, '^[+-]?\d+(\.\d+)?$') THEN {_DOUBLE.format(raw)} WHEN regexp_matches({raw}, '^[+-]?\d{{1,3}},\d{{3}}$') THEN {either} WHEN regexp_matches({raw}, '^[+-]?\d+,\d+$') THEN {comma}
  WHEN regexp_matches({raw}, '^[+-]?\d{{1,3}}(,\d{{3}})+(\.\d+)?$') THEN {thousands} WHEN regexp_matches({raw}, '^[+-]?\d{{1,3}}(\.\d{{3}})+(,\d+)?$') THEN {comma} END"""


_SPAN = r"([\d.,]+)\s*(?:-|–|—|to)\s*([\d.,]+)"
_TEXT_NUMBER = r"^(?:[<>≤≥=~≈]+\s*)?([+-]?\d[\d.,''’]*(?:[  ]\d{3})*)(.*)$"


def converted(source: str, name: str = "converted") -> str:
    """CTEs from ``source`` (rows of clean_observations, of which canonical_name counts) to ``name``: the rows whose
    unit is written, with recorded, from_unit, converted, common_unit, common_low, common_high, unit_factor,
    unit_shift."""
    pairs = [(base, key) for base, keys in SPELLINGS.items() for key in keys]
    ref = "reference_text"
    span = f"regexp_matches({ref}, '\\d\\s*(?:-|–|—|to)\\s*\\d')"
    bound = lambda i: _DOUBLE.format(f"replace(regexp_extract({ref}, '{_SPAN}', {i}), ',', '')")
    most = _DOUBLE.format(rf"replace(regexp_extract({ref}, '[<≤]=?\s*([\d.,]+)', 1), ',', '')")
    n = name
    return rf"""
{n}_units AS (SELECT canonical_name, unit AS code, 1.0::DOUBLE AS factor, 0.0::DOUBLE AS shift FROM dim_tests UNION SELECT canonical_name, from_unit, factor, coalesce(shift, 0) FROM dim_unit_factors JOIN dim_tests t USING (canonical_name) WHERE to_unit = t.unit),
{n}_codes AS (SELECT *, {fold_unit('code')} AS base FROM {n}_units),
{n}_keys AS (SELECT canonical_name, base AS key, 0 AS r, code, factor, shift FROM {n}_codes UNION ALL SELECT canonical_name, s.key, 1, code, factor, shift FROM {n}_codes JOIN {dims.values(pairs, 's', 'base, key')} USING (base)),
{n}_spelled AS (SELECT canonical_name, key, min((r, code, factor, shift)) AS b, arg_min(code, (r, code, factor, shift)) AS code, arg_min(factor, (r, code, factor, shift)) AS factor, arg_min(shift, (r, code, factor, shift)) AS shift FROM {n}_keys GROUP BY ALL),
{n}_1 AS (SELECT s.*, t.unit AS common_unit, coalesce(reference_low, CASE WHEN {span} THEN {bound(1)} END) AS lo, coalesce(reference_high, CASE WHEN {span} THEN {bound(2)} WHEN regexp_matches({ref}, '^\s*[<≤]') THEN {most} END) AS hi FROM {source} s JOIN dim_tests t USING (canonical_name)),
{n}_2 AS (SELECT *, regexp_replace(trim(value_text), '^[<>≤≥=~≈]+\s*', '') AS bare, CASE WHEN lo > 0 AND hi > 0 THEN sqrt(lo * hi) WHEN hi > 0 THEN hi END AS near, regexp_replace(regexp_extract(trim(value_text), '{_TEXT_NUMBER}', 1), '[''’  ]', '', 'g') AS raw, nullif(trim(regexp_extract(trim(value_text), '{_TEXT_NUMBER}', 2)), '') AS behind,
  regexp_extract({ref}, '(?:-|–|—|to|<|≤)\s*[\d.,]+\)?\s*((?:x?10[*^eE]|/|[A-Za-z%°µμ]).*)$', 1) AS beside FROM {n}_1),
{n}_3 AS (SELECT *, coalesce(value, CASE WHEN regexp_matches(bare, '{SCIENTIFIC}') THEN TRY_CAST(bare AS DOUBLE) ELSE {_number('raw', 'near')} END) AS recorded, CASE WHEN trim(coalesce(unit, '')) <> '' THEN unit WHEN value IS NULL AND behind IS NOT NULL AND NOT regexp_matches(bare, '{SCIENTIFIC}') THEN behind WHEN trim(beside) <> '' THEN beside END AS told FROM {n}_2),
{n} AS (SELECT x.*, s.code AS from_unit, recorded * factor + shift AS converted, lo * factor + shift AS common_low, hi * factor + shift AS common_high, factor AS unit_factor, shift AS unit_shift FROM (SELECT *, {fold_unit('told')} AS key FROM {n}_3 WHERE recorded IS NOT NULL) x JOIN {n}_spelled s USING (canonical_name, key))"""


FOLD = r"CASE WHEN regexp_matches({0}, '(?i)^\W*n\W+a\W*$') THEN '' ELSE regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g') END"


def named(source: str, name: str = "named") -> str:
    """CTEs from ``source`` to ``name``: canonical_name as listed, else of the one entry whose folded label is that of
    canonical_name, else of test_name."""
    n = name
    return f"""
{n}_labels AS (SELECT DISTINCT canonical_name, {FOLD.format('label')} AS fold FROM (SELECT canonical_name, unnest(list_concat([canonical_name, display_name], coalesce(aliases, []))) AS label FROM dim_tests)),
{n}_one AS (SELECT fold, min(canonical_name) AS entry FROM {n}_labels WHERE fold <> '' GROUP BY fold HAVING count(DISTINCT canonical_name) = 1),
{n} AS (SELECT s.* REPLACE (coalesce(d.canonical_name, a.entry, b.entry) AS canonical_name) FROM {source} s LEFT JOIN dim_tests d ON d.canonical_name = s.canonical_name LEFT JOIN {n}_one a ON a.fold = {FOLD.format('s.canonical_name')} LEFT JOIN {n}_one b ON b.fold = {FOLD.format('s.test_name')})"""


#: Results: second deliveries once, named tests, unit written, in the common unit, by the day of collection.
RESULTS = f"""
once AS (SELECT * EXCLUDE (obs_id, triage_level, created_at), arg_min(obs_id, (created_at, obs_id)) AS obs_id, min(created_at) AS created_at FROM clean_observations GROUP BY ALL),
{named('once')},
{converted('named')},
dated AS (SELECT *, date_effective AS text FROM converted),
{stamps('dated')},
whole AS (SELECT user_id, obs_id, canonical_name, test_name, converted AS value, common_low AS low, common_high AS high, flag, from_unit AS unit, common_unit, utc_date AS day, created_at, source_doc_id FROM stamps),
res AS (SELECT * FROM whole WHERE day IS NOT NULL),
last AS (SELECT * FROM res QUALIFY row_number() OVER (PARTITION BY user_id, canonical_name ORDER BY day DESC, obs_id DESC) = 1)"""

MEDICATIONS = f"""
starting AS (SELECT *, start_date AS text FROM clean_medications),
{stamps('starting', 'started')},
meds AS (SELECT user_id, med_id, regexp_replace(lower(trim(name)), ' xr$', '') AS drug, lower(trim(status)) AS status, utc_date AS start_day, end_date, name FROM started)"""
