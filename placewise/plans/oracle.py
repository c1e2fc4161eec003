"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..operators.reconcile import CALL_FIELDS
from ..operators.types import dimension_rows
from .adapter import with_views
from .queries import CUTOFFS, NOW

ZONE = "America/Halifax"


def _local(ts: str) -> str:
    return f"timezone('{ZONE}', timezone('UTC', {ts}))"


def _r(*names: str, places: int = 6) -> str:
    return ", ".join(f"round_even({n}, {places}) AS {n}" for n in names)


def _pct(a: str, b: str, places: int = 1) -> str:
    return f"round_even(100.0::DOUBLE * ({a}) / nullif(({b})::DOUBLE, 0), {places})"


ATTRS = """attrs AS (SELECT request_id,
  max(value) FILTER (name = 'Alleged Violation') AS label, max(value) FILTER (name = 'Vehicle Was Towed') AS tow_flag,
  max(value) FILTER (name = 'Property Ownership') AS owner, max(value) FILTER (name = 'Vehicle Make') AS make,
  max(value) FILTER (name = 'Vehicle Model') AS model, max(value) FILTER (name = 'Vehicle Colour') AS colour,
  count(*) FILTER (name = 'Alleged Violation') AS label_rows FROM fields GROUP BY request_id
  HAVING count(*) FILTER (name = 'Alleged Violation') > 0)"""
LOADED = f"""loaded AS (SELECT c.*, label, tow_flag, owner, make, model, colour, {_local('date_initiated')} AS local,
  nullif(trim(regexp_replace(split_part(upper(address), ',', 1), '\\s+', ' ', 'g')), '') AS door,
  nullif(concat_ws('|', upper(trim(coalesce(make, ''))), upper(trim(coalesce(model, ''))), upper(trim(coalesce(colour, '')))), '||') AS vehicle,
  CASE tow_flag WHEN 'Y' THEN 'towed' WHEN 'N' THEN 'not_towed' ELSE 'unknown' END AS tow_status
  FROM calls c LEFT JOIN attrs USING (request_id))"""
TYPES = """types AS (SELECT request_id, arg_max(canonical_type, object_id) AS canonical_type FROM fields JOIN dim ON value = raw_label
  WHERE name = 'Alleged Violation' AND status = 'assigned' GROUP BY request_id)"""
ONE = "sel AS (SELECT *, 'all' AS canonical_type FROM loaded)"
TYPED = "sel AS (SELECT loaded.*, canonical_type FROM loaded JOIN types USING (request_id))"


def _gaps(recur: int = 365, sel: str = "sel", name: str = "gaps") -> str:
    return f"""{name} AS (SELECT *, coalesce(gap_days <= {recur}, false) AS recurs FROM (
  SELECT *, row_number() OVER w AS seq, datesub('day', local, lead(local) OVER w) AS gap_days FROM {sel}
  WHERE local IS NOT NULL AND door IS NOT NULL WINDOW w AS (PARTITION BY canonical_type, door ORDER BY local, request_id)))"""


def _doors(recency: int = 365, min_calls: int = 2, district: str | None = None, sel: str = "sel", gaps: str = "gaps", name: str = "doors") -> str:
    keep = f"AND district = '{district}'" if district else ""
    return f"""{name}_g AS (SELECT canonical_type, door AS address,
    count(*) FILTER (local >= latest - INTERVAL {recency} DAY) AS calls_12mo, count(*) AS calls_total,
    arg_max_null(district, seq) AS district, arg_max_null(community, seq) AS community, count(*) FILTER (tow_flag = 'Y') AS tows,
    count(vehicle) AS vehicles_seen, count(DISTINCT vehicle) AS vehicles_distinct, count(*) FILTER (recurs) AS repeat_calls,
    median(gap_days) AS median_gap_days, strftime(max(local), '%Y-%m-%d') AS last_call, median(nullif(latitude, 0)) AS lat,
    median(nullif(longitude, 0)) AS lon, min(request_id) AS first_seen
  FROM {gaps} JOIN (SELECT canonical_type, max(local) AS latest FROM {sel} GROUP BY 1) USING (canonical_type) GROUP BY 1, 2),
{name}_l AS (SELECT *, tows / calls_total AS tow_rate,
    nullif(trim(regexp_replace(regexp_replace(address, '^[0-9]+[A-Z]?\\s+', ''), '(?s)\\s*&.*$', '')), '') AS street
  FROM {name}_g WHERE calls_12mo > 0 AND calls_12mo >= {min_calls} {keep}),
{name}_o AS (SELECT canonical_type, door AS address, owner FROM (SELECT canonical_type, door, owner,
    row_number() OVER (PARTITION BY canonical_type, door ORDER BY count(*) DESC, min(seq)) AS r FROM {gaps} GROUP BY 1, 2, 3) WHERE r = 1),
{name}_p AS (SELECT canonical_type, address, min(dauid) AS block FROM (
    SELECT l.canonical_type, l.address, a.dauid FROM {name}_l l JOIN areas a ON lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat
    JOIN edges e ON e.dauid = a.dauid WHERE lat <> 0 AND lon <> 0 GROUP BY 1, 2, 3
    HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) / nullif(y2 - y1, 0) * (x2 - x1) THEN 1 ELSE 0 END) % 2 = 1) GROUP BY 1, 2),
{name} AS (SELECT l.*, owner, block, dwellings AS block_dwellings,
    row_number() OVER (PARTITION BY l.canonical_type ORDER BY calls_12mo * (1 - tow_rate) DESC, first_seen) AS rank
  FROM {name}_l l LEFT JOIN {name}_o o ON o.canonical_type = l.canonical_type AND o.address = l.address
  LEFT JOIN {name}_p p ON p.canonical_type = l.canonical_type AND p.address = l.address LEFT JOIN areas ON dauid = block)"""


def _blocks(least: int = 2, doors: str = "doors", name: str = "blks") -> str:
    return f"""{name}_s AS (SELECT canonical_type, block, string_agg(street, ' / ' ORDER BY n DESC, r, street) AS streets FROM (
    SELECT canonical_type, block, street, sum(calls_12mo) AS n, min(rank) AS r,
      row_number() OVER (PARTITION BY canonical_type, block ORDER BY sum(calls_12mo) DESC, min(rank), street) AS k
    FROM {doors} WHERE block IS NOT NULL AND street IS NOT NULL GROUP BY 1, 2, 3) WHERE k <= 2 GROUP BY 1, 2),
{name}_d AS (SELECT canonical_type, block, district FROM (SELECT canonical_type, block, district,
    row_number() OVER (PARTITION BY canonical_type, block ORDER BY count(*) DESC, min(rank)) AS k FROM {doors} WHERE block IS NOT NULL GROUP BY 1, 2, 3) WHERE k = 1),
{name}_g AS (SELECT canonical_type, block, count(*) AS doorways, sum(calls_12mo)::BIGINT AS calls_12mo, sum(calls_total)::BIGINT AS calls_total,
    sum(tows)::BIGINT AS tows, coalesce(max(block_dwellings), 0) AS dwellings, arg_min(address, (-calls_12mo, rank)) AS worst_doorway,
    string_agg(address, '; ' ORDER BY address) AS addresses, min(rank) AS first_rank FROM {doors} WHERE block IS NOT NULL GROUP BY 1, 2),
{name} AS (SELECT g.*, coalesce(streets, '') AS streets, district,
    round_even(1000.0::DOUBLE * calls_12mo / nullif(dwellings, 0)::DOUBLE, 1) AS calls_per_1k_dwellings,
    row_number() OVER (PARTITION BY g.canonical_type ORDER BY doorways DESC,
      coalesce(round_even(1000.0::DOUBLE * calls_12mo / nullif(dwellings, 0)::DOUBLE, 1), 0) DESC, first_rank) AS rank
  FROM {name}_g g LEFT JOIN {name}_s s ON s.canonical_type = g.canonical_type AND s.block = g.block
  LEFT JOIN {name}_d d ON d.canonical_type = g.canonical_type AND d.block = g.block WHERE doorways >= {least})"""


NB = "nb AS (SELECT doors.*, coalesce(doorways, 1) AS block_doorways_calling FROM doors LEFT JOIN (SELECT block, doorways FROM blks) USING (block))"
DOOR = """rank, address, calls_12mo, calls_total, district, community, owner, tows, round_even(tow_rate, 6) AS tow_rate, vehicles_seen, vehicles_distinct,
  repeat_calls, round_even(median_gap_days, 6) AS median_gap_days, last_call, street, block, block_dwellings::DOUBLE AS block_dwellings, round_even(lat, 6) AS lat, round_even(lon, 6) AS lon"""
BLOCK = "rank, block, streets, doorways, calls_12mo, calls_total, tows, dwellings, calls_per_1k_dwellings, district, worst_doorway, addresses"
BASE = (ATTRS, LOADED, ONE, _gaps(), _doors())
ALL = (ATTRS, LOADED, TYPES, TYPED, _gaps(), _doors())
PAGE = (*BASE, _blocks(), NB)
FLAGS = (ATTRS, LOADED, TYPES, TYPED, _gaps())
TALLY = """t AS (SELECT canonical_type, door, count(*) FILTER (tow_status = 'towed') AS tn, count(*) FILTER (tow_status = 'towed' AND recurs) AS tr,
  count(*) FILTER (tow_status = 'not_towed') AS nn, count(*) FILTER (tow_status = 'not_towed' AND recurs) AS nr FROM gaps GROUP BY 1, 2)"""
TOTALS = "totals AS (SELECT canonical_type, sum(tn)::BIGINT AS tn, sum(tr)::BIGINT AS tr, sum(nn)::BIGINT AS nn, sum(nr)::BIGINT AS nr FROM t GROUP BY 1)"
#: The normal quantile of a 95 per cent interval.
Z95 = 1.959963984540054
WALD = f"""wald AS (SELECT *, 100 * (p1 - p2) AS difference, 100 * (p1 - p2 - {Z95} * se) AS wald_lo, 100 * (p1 - p2 + {Z95} * se) AS wald_hi FROM (
  SELECT *, sqrt(p1 * (1 - p1) / nullif(tn, 0) + p2 * (1 - p2) / nullif(nn, 0)) AS se FROM (
    SELECT *, tr / nullif(tn, 0) AS p1, nr / nullif(nn, 0) AS p2 FROM totals)))"""
def _mix(source: str, c: str) -> str:
    """Column c of the source as another number below 2 ** 32."""
    for _ in range(2):
        source = f"(SELECT * REPLACE ((xor({c}, {c} >> 16) * 73244475) & 4294967295 AS {c}) FROM {source})"
    return f"(SELECT * REPLACE (xor({c}, {c} >> 16) AS {c}) FROM {source})"


def _draws(source: str, part: str, k: str) -> str:
    """Rows of the source, which has rep, times the draws in the list k, with the draw u."""
    first = _mix(f"(SELECT *, (20260101 + rep) & 4294967295 AS s FROM {source})", "s")
    stream = _mix(f"(SELECT * REPLACE ((s + {part}) & 4294967295 AS s) FROM {first})", "s")
    other = _mix(f"(SELECT *, xor(s, 2654435769) AS b FROM {stream})", "b")
    both = _mix(f"(SELECT * REPLACE ((b + k) & 4294967295 AS b), xor(s, k) AS a FROM (SELECT *, unnest({k}) AS k FROM {other}))", "b")
    return f"(SELECT *, (a + b) & 4294967295 AS u FROM {_mix(both, 'a')})"


BOOT = f"""num AS (SELECT *, row_number() OVER (PARTITION BY canonical_type ORDER BY ('0x' || substr(md5(door), 1, 8))::BIGINT % 1024, door) - 1 AS idx,
  count(*) OVER (PARTITION BY canonical_type) AS n FROM t),
sized AS (SELECT canonical_type, n, r.rep FROM (SELECT DISTINCT canonical_type, n FROM num), (SELECT unnest(range(0, 2000)) AS rep) r),
fallen AS (SELECT canonical_type, n, rep, 0 AS block, n AS m FROM sized WHERE n <= 1024
  UNION ALL SELECT canonical_type, n, rep, u % n // 1024, count(*) FROM {_draws('(SELECT * FROM sized WHERE n > 1024)', '0', 'range(0, n)')} GROUP BY 1, 2, 3, 4),
draws AS (SELECT canonical_type, rep, block * 1024 + u % least(1024, n - 1024 * block) AS idx FROM {_draws('fallen', '(block + 1)', 'range(0, m)')}),
reps AS (SELECT canonical_type, rep, 100 * (sum(tr) / sum(tn) - sum(nr) / sum(nn)) AS d FROM draws JOIN num USING (canonical_type, idx) GROUP BY 1, 2
  HAVING sum(tn) > 0 AND sum(nn) > 0),
boot AS (SELECT canonical_type, len(d) AS replicates, d[1 + round_even(0.025 * (len(d) - 1), 0)::INT] AS boot_lo,
  d[1 + round_even(0.975 * (len(d) - 1), 0)::INT] AS boot_hi FROM (SELECT canonical_type, list(d ORDER BY d) AS d FROM reps GROUP BY 1))"""
BOUND = """bound AS (SELECT canonical_type, tn, tr, nn, nr, tn > 0 AND nn > 0 AS comparable, round_even(difference, 2) AS difference,
  round_even(wald_lo, 1) AS wald_lo, round_even(wald_hi, 1) AS wald_hi, round_even(boot_lo, 1) AS boot_lo, round_even(boot_hi, 1) AS boot_hi,
  CASE WHEN wald_lo IS NOT NULL THEN round_even(greatest(0, -wald_lo), 1) END AS wald_rules_out,
  CASE WHEN boot_lo IS NOT NULL THEN round_even(greatest(0, -boot_lo), 1) END AS boot_rules_out
  FROM wald LEFT JOIN boot USING (canonical_type))"""
VERDICT = """verdict AS (SELECT *, CASE WHEN tn < 30 OR nn < 30 THEN 'sample_too_small' WHEN boot_hi < 0 THEN 'tow_lower' WHEN boot_lo > 0 THEN 'tow_higher'
  ELSE 'no_difference' END AS tow_verdict FROM bound)"""
VEHICLES = """vehicles AS (SELECT *, CASE WHEN seen < 30 THEN 'sample_too_small' WHEN share >= 0.9 THEN 'mostly_distinct' WHEN share <= 0.7 THEN 'substantial_repeat'
  ELSE 'mixed' END AS vehicle_verdict FROM (SELECT *, round_even("distinct" / nullif(seen, 0), 3) AS share FROM (
  SELECT canonical_type, sum(vehicles_seen)::BIGINT AS seen, sum(vehicles_distinct)::BIGINT AS "distinct", count(*) AS doorways FROM doors GROUP BY 1)))"""
STATS = (*FLAGS, TALLY, TOTALS, WALD, BOOT, BOUND, VERDICT)
URGENT = "ids AS (SELECT DISTINCT request_id FROM fields WHERE name = 'Alleged Violation' AND value IN (SELECT raw_label FROM dim WHERE canonical_type = 'Urgent or high'))"
SELECTED = (ATTRS, LOADED, URGENT, "sel AS (SELECT *, 'all' AS canonical_type FROM loaded WHERE request_id IN (SELECT request_id FROM ids) AND request_id % 9 <> 0)", _gaps(),
            _doors(district="1"), _blocks())
HEADLINE = f"""SELECT * FROM (SELECT count(*) AS calls, count(*) FILTER (tow_flag = 'Y') AS tows, {_pct("count(*) FILTER (tow_flag = 'Y')", 'count(*)')} AS tow_pct,
  {_pct("count(*) FILTER (tow_status = 'unknown')", 'count(*)')} AS no_outcome_pct FROM sel),
 (SELECT count(*) AS addresses, coalesce(sum(vehicles_seen), 0)::BIGINT AS seen, coalesce(sum(vehicles_distinct), 0)::BIGINT AS "distinct",
  {_pct('sum(vehicles_distinct)', 'sum(vehicles_seen)', 0)} AS unique_pct FROM nb)"""


def _title(x: str) -> str:
    runs = f"regexp_extract_all(lower({x}), '(\\p{{L}}+|[^\\p{{L}}]+)', 1)"
    return f"array_to_string(list_transform({runs}, lambda y: upper(y[1]) || y[2:]), '')"


def _hist(name: str, local: str, channel: str, source: str) -> str:
    return f"{name} AS (SELECT coalesce({channel}, '(none)') AS channel, hour({local})::INT AS hour, count(*) AS calls FROM {source} WHERE {local} IS NOT NULL GROUP BY 1, 2)"


def _points(scale: int = 1) -> str:
    return f"""pts AS (SELECT request_id, nullif(trim(regexp_replace(split_part(upper(address), ',', 1), '\\s+', ' ', 'g')), '') AS door,
  (longitude / {scale}) * 111320.0 * cos(radians(44.65)) AS x, (latitude / {scale}) * 111320.0 AS y FROM calls WHERE latitude <> 0 AND longitude <> 0)"""


def _spread(source: str = "pts") -> str:
    return f"""u AS (SELECT DISTINCT door, x, y FROM {source} WHERE door IS NOT NULL),
far AS (SELECT a.door, max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS spread FROM u a JOIN u b ON a.door = b.door GROUP BY 1),
sp AS (SELECT door, count(*) AS calls, any_value(spread) AS spread FROM {source} JOIN far USING (door) GROUP BY 1)"""


def _near(metres: float) -> str:
    return f"""mid AS (SELECT door, list_sort(list(x))[len(list(x)) // 2 + 1] AS x, list_sort(list(y))[len(list(y)) // 2 + 1] AS y FROM pts WHERE door IS NOT NULL GROUP BY 1),
near AS (SELECT a.door AS a, b.door AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS metres FROM mid a JOIN mid b ON a.door < b.door
  AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {metres})"""


def _snapshots() -> tuple[str, ...]:
    out = [ATTRS, LOADED, TYPES, TYPED]
    for i, day in enumerate(CUTOFFS, 1):
        out += [f"sel{i} AS (SELECT * FROM sel WHERE local < TIMESTAMP '{day}')", _gaps(sel=f"sel{i}", name=f"gaps{i}"),
                _doors(sel=f"sel{i}", gaps=f"gaps{i}", name=f"d{i}")]
    rows = " UNION ALL ".join(
        f"SELECT {i} AS snapshot_id, TIMESTAMP '{d}' AS derived_at, canonical_type AS violation_type, address, rank, calls_12mo, calls_total FROM d{i}" for i, d in enumerate(CUTOFFS, 1)
    )
    heads = " UNION ALL ".join(f"SELECT {i} AS snapshot_id, TIMESTAMP '{d}' AS derived_at" for i, d in enumerate(CUTOFFS, 1))
    return (*out, f"snaps AS ({rows})", f"""heads AS (SELECT h.*, canonical_type AS violation_type,
      (SELECT count(*) FROM snaps s WHERE s.snapshot_id = h.snapshot_id AND s.violation_type = canonical_type) AS listed
      FROM ({heads}) h, (SELECT DISTINCT canonical_type FROM dim WHERE status = 'assigned'))""")  # fmt: skip


def _at(day: str, i: int) -> tuple[str, ...]:
    return (f"sel{i} AS (SELECT * FROM sel WHERE local < TIMESTAMP '{day}')", _gaps(sel=f"sel{i}", name=f"gaps{i}"),
            _doors(60, 3, sel=f"sel{i}", gaps=f"gaps{i}", name=f"d{i}"), _blocks(1, f"d{i}", f"b{i}"))


SHIFTED = """shifted AS (SELECT * REPLACE (CASE WHEN request_id % 3 = 0 THEN object_id ELSE object_id + 1000000 END AS object_id) FROM calls WHERE request_id % 13 <> 0),
old AS (SELECT request_id::VARCHAR AS business_key, object_id AS was FROM calls WHERE request_id % 8 = 0),
new AS (SELECT request_id::VARCHAR AS business_key, object_id AS now FROM shifted WHERE request_id % 8 = 0)"""
ALTERED = """altered AS (SELECT * REPLACE (CASE WHEN request_id % 31 = 0 THEN NULL ELSE community END AS community,
  CASE WHEN request_id % 29 = 0 THEN '9' ELSE district END AS district, CASE WHEN request_id % 37 = 0 THEN date_closed + INTERVAL 1 SECOND ELSE date_closed END AS date_closed,
  CASE WHEN request_id % 43 = 0 AND latitude >= 1 THEN latitude + 0.5 ELSE latitude END AS latitude, CASE WHEN request_id % 47 = 0 THEN NULL ELSE longitude END AS longitude,
  CASE WHEN request_id % 53 = 0 THEN 'W' ELSE work_order END AS work_order, CASE WHEN request_id % 59 = 0 THEN 'X' ELSE status END AS status)
  FROM calls WHERE request_id % 17 <> 0)"""


def _diff(a: str, b: str, keys: list[str], fields: list[str], name: str) -> str:
    on = " AND ".join(f"x.{k} IS NOT DISTINCT FROM y.{k}" for k in keys)
    ks = ", ".join(f"coalesce(x.{k}, y.{k}) AS {k}" for k in keys)
    k0 = keys[0]
    changed = " UNION ALL ".join(
        f"SELECT {', '.join('x.' + k for k in keys)}, 'changed', '{f}', x.{f}::VARCHAR, y.{f}::VARCHAR FROM {a} x JOIN {b} y ON {on} WHERE x.{f} IS DISTINCT FROM y.{f}" for f in fields
    )
    return f"""{name} AS (SELECT {ks}, CASE WHEN y.{k0} IS NULL THEN 'only_a' ELSE 'only_b' END AS change, NULL::VARCHAR AS field, NULL::VARCHAR AS a, NULL::VARCHAR AS b
  FROM {a} x FULL JOIN {b} y ON {on} WHERE x.{k0} IS NULL OR y.{k0} IS NULL UNION ALL {changed})"""


ROW_DIFF = _diff("calls", "altered", ["request_id"], CALL_FIELDS, "rd")
FIELD_DIFF = """f2 AS (SELECT * REPLACE (CASE WHEN request_id % 23 = 0 THEN NULL ELSE value END AS value) FROM fields WHERE request_id % 19 <> 0),
""" + _diff("fields", "f2", ["request_id", "field_id"], ["name", "value"], "fd")
PULLED = """st AS (SELECT layer, max(source_last_edit) AS source_last_edit, min(full_load_completed_at) AS done FROM layer_state GROUP BY 1),
newest AS (SELECT layer, arg_max(source_edit, (finished_at, run_id)) AS e FROM runs WHERE kind IN ('full_load', 'reload') AND error IS NULL AND finished_at IS NOT NULL GROUP BY 1),
pulled AS (SELECT layer, coalesce(e, CASE WHEN done IS NOT NULL THEN source_last_edit END) AS pulled FROM st LEFT JOIN newest USING (layer))"""
LAYERS = """lay AS (SELECT *, coalesce(source_last_edit > pulled, source_last_edit IS NOT NULL) AND NOT static AS behind,
  CASE WHEN static THEN 'static' WHEN coalesce(source_last_edit > pulled, source_last_edit IS NOT NULL) THEN 'this_system' ELSE 'source' END AS "limit"
  FROM layer_state LEFT JOIN pulled USING (layer))"""
READY = """ready AS (SELECT store, count(full_load_completed_at) AS loaded, count(*) AS layers, CASE WHEN count(full_load_completed_at) = 0 THEN 'uninitialised'
  WHEN count(full_load_completed_at) < count(*) THEN 'not_ready' ELSE 'ready' END AS readiness FROM layer_state GROUP BY 1)"""
RECONCILED = """rec AS (SELECT layer, r AS reconciled FROM (SELECT DISTINCT layer FROM layer_state) LEFT JOIN
  (SELECT layer, arg_max(reconciled, started_at) AS r FROM runs WHERE error IS NULL AND reconciled IS NOT NULL GROUP BY 1) USING (layer))"""
INTERVALS = """iv AS (SELECT *, date_diff('microsecond', lag(edited_at) OVER (PARTITION BY layer ORDER BY edited_at), edited_at) / 1000000 AS seconds FROM (
  SELECT DISTINCT event_type AS layer, date_trunc('day', ts)::TIMESTAMP AS edited_at FROM events))"""
GOOD = """good AS (SELECT *, coalesce(nullif(trim(role), ''), 'unspecified') AS r, nullif(trim(note), '') AS n FROM decisions
  WHERE coalesce(scope IN ('doorway', 'block'), false) AND coalesce(trim(item_key), '') <> '' AND coalesce(trim(decision), '') <> '')"""

PUBLISHED = (
    "tab(raw_label, canonical_type, status, n, i) AS (VALUES " + ", ".join(
        "({}, {}, '{}', {}::BIGINT, {})".format(*["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in r[:2]], r[2], r[3], i)
        for i, r in enumerate(dimension_rows())) + ")",
    f"""pub AS (SELECT request_id, CASE k WHEN {len(dimension_rows()) + 1} THEN 'no parking sign' WHEN {len(dimension_rows()) + 2} THEN 'Unheard of' ELSE raw_label END AS label
      FROM (SELECT request_id, request_id * 31 % {len(dimension_rows()) + 3} AS k FROM fields WHERE name = 'Alleged Violation') LEFT JOIN tab ON i = k)""",
)

TOUCHED = """touched AS (SELECT * REPLACE (CASE WHEN request_id % 4999 = 0 THEN 'X' ELSE status END AS status) FROM calls WHERE request_id <> 77
  UNION ALL SELECT * REPLACE (-1 AS request_id) FROM calls WHERE request_id = 33)"""

DELTAS = """SELECT object_id, request_id, field_id, name, value, written FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY written DESC) AS r FROM (
        SELECT *, 2 AS written FROM fields WHERE request_id % 5 <> 0 UNION ALL SELECT object_id, request_id, field_id, name, upper(value), 3 FROM fields WHERE request_id % 1000 < 100
        UNION ALL SELECT object_id, request_id, field_id, name, 'stale', 1 FROM fields WHERE request_id % 7 = 0)) WHERE r = 1"""

ORACLE_SQL: dict[str, str] = {
    "recent_watchlist": with_views(
        "SELECT rank, address, calls_12mo, calls_total, tows, round_even(tow_rate, 6) AS tow_rate, repeat_calls, round_even(median_gap_days, 6) AS median_gap_days, last_call FROM doors", *BASE
    ),
    "crowded_doorways": with_views(f"SELECT {DOOR} FROM doors", ATTRS, LOADED,
        "sel AS (SELECT * REPLACE (CASE WHEN request_id % 2 = 0 THEN '1 CROWDED ST' ELSE door END AS door), 'all' AS canonical_type FROM loaded)", _gaps(), _doors()),
    "doorways_full": with_views(f"SELECT {DOOR} FROM doors", *BASE),
    "blocks": with_views(f"SELECT {BLOCK} FROM blks", *BASE, _blocks()),
    "watchlist_with_neighbours": with_views(f"SELECT {DOOR}, block_doorways_calling FROM nb", ATTRS, LOADED, ONE, _gaps(), _doors(district="1"), _blocks(), NB),
    "doorways_all_types": with_views(f"SELECT canonical_type, {DOOR} FROM doors", *ALL),
    "blocks_all_types": with_views(f"SELECT canonical_type, {BLOCK} FROM blks", *ALL, _blocks()),
    "recency_window": with_views(f"SELECT {DOOR} FROM doors", ATTRS, LOADED, ONE, _gaps(30), _doors(30, 1)),
    "label_substring": with_views(
        "SELECT request_id, door, label, tow_status, local FROM loaded WHERE request_id IN (SELECT request_id FROM fields WHERE name = 'Alleged Violation' AND upper(value) LIKE '%I%H%')", ATTRS, LOADED
    ),
    "label_canonical": with_views(
        "SELECT request_id, door, label, owner, upper(trim(make)) AS make FROM loaded WHERE request_id IN (SELECT request_id FROM fields JOIN dim ON value = raw_label WHERE name = 'Alleged Violation' AND canonical_type = 'Medium or low')",
        ATTRS, LOADED,
    ),
    "matched_labels": with_views("SELECT DISTINCT value AS raw_label FROM fields WHERE name = 'Alleged Violation' AND upper(value) LIKE '%I%H%'"),
    "eav_pivot": with_views("SELECT * FROM attrs", ATTRS),
    "missing_ids": with_views("SELECT request_id FROM ids WHERE request_id NOT IN (SELECT request_id FROM calls WHERE request_id % 9 <> 0)", URGENT),
    "point_in_polygon": with_views(
        "SELECT point, min(dauid) AS block FROM p LEFT JOIN hit USING (point) GROUP BY 1",
        "p AS (SELECT request_id AS point, longitude AS lon, latitude AS lat FROM calls WHERE latitude <> 0 AND longitude <> 0)",
        """hit AS (SELECT point, dauid FROM (SELECT p.point, a.dauid FROM p JOIN areas a ON lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat
          JOIN edges e ON e.dauid = a.dauid GROUP BY 1, 2 HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) / nullif(y2 - y1, 0) * (x2 - x1)
          THEN 1 ELSE 0 END) % 2 = 1))""",
    ),
    "recurrence_by_tow": with_views(
        f"""SELECT canonical_type, tow_status, coalesce(calls, 0) AS calls, coalesce(recurring, 0) AS recurring, {_pct('recurring', 'calls')} AS pct
        FROM (SELECT * FROM (SELECT DISTINCT canonical_type FROM gaps), (VALUES ('towed'), ('not_towed'), ('unknown')) s(tow_status))
        LEFT JOIN (SELECT canonical_type, tow_status, count(*) AS calls, count(*) FILTER (recurs) AS recurring FROM gaps GROUP BY 1, 2) USING (canonical_type, tow_status)""", *FLAGS
    ),
    "tow_tallies": with_views("SELECT door, tn, tr, nn, nr FROM t", ATTRS, LOADED, ONE, _gaps(), TALLY),
    "wald_interval": with_views(f"SELECT canonical_type, tn, tr, nn, nr, {_r('difference', 'wald_lo', 'wald_hi')} FROM wald", *FLAGS, TALLY, TOTALS, WALD),
    "cluster_bootstrap": with_views(f"SELECT canonical_type, replicates, {_r('boot_lo', 'boot_hi')} FROM boot", *FLAGS, TALLY, BOOT),
    "unit_bootstrap": with_views(f"SELECT canonical_type, replicates, {_r('boot_lo', 'boot_hi')} FROM boot", ATTRS, LOADED, TYPES,
        "sel AS (SELECT loaded.* REPLACE (door || ' unit ' || (request_id % 7) AS door), canonical_type FROM loaded JOIN types USING (request_id))", _gaps(), TALLY, BOOT),
    "effect_bound": with_views("SELECT * FROM bound", *STATS),
    "tow_verdict": with_views("SELECT canonical_type, tow_verdict FROM verdict", *STATS),
    "vehicle_verdict": with_views("SELECT * FROM vehicles", *ALL, VEHICLES),
    "type_record": with_views(
        """SELECT canonical_type, coalesce(tn, 0) AS tn, coalesce(tr, 0) AS tr, coalesce(nn, 0) AS nn, coalesce(nr, 0) AS nr, coalesce(comparable, false) AS comparable,
        difference, wald_lo, wald_hi, boot_lo, boot_hi, wald_rules_out, boot_rules_out, coalesce(tow_verdict, 'sample_too_small') AS tow_verdict, coalesce(seen, 0) AS seen,
        coalesce("distinct", 0) AS "distinct", coalesce(doorways, 0) AS doorways, share, coalesce(vehicle_verdict, 'sample_too_small') AS vehicle_verdict,
        canonical_type || '; tows: ' || coalesce(tow_verdict, 'sample_too_small') || '; vehicles: ' || coalesce(vehicle_verdict, 'sample_too_small') AS conclusion
        FROM (SELECT DISTINCT canonical_type FROM dim WHERE status = 'assigned') LEFT JOIN verdict USING (canonical_type) LEFT JOIN vehicles USING (canonical_type)""",
        *STATS, _doors(), VEHICLES,
    ),
    "response_time": with_views(
        """SELECT canonical_type, round_even(median(date_diff('microsecond', date_initiated, date_closed) / 60000000), 6) AS median_minutes,
        count(date_closed) FILTER (date_initiated IS NOT NULL) AS closed, count(*) FILTER (date_closed IS NULL) AS never_closed
        FROM sel WHERE local < TIMESTAMP '2000-07-01' GROUP BY 1""", ATTRS, LOADED, TYPES, TYPED
    ),
    "denominators": with_views(
        """SELECT 'selection' AS name, count(*) AS count FROM q UNION ALL SELECT 'as_of', count(*) FROM q WHERE local < TIMESTAMP '2000-01-01'
        UNION ALL SELECT 'tow_cohort', count(*) FROM q WHERE local IS NOT NULL AND door IS NOT NULL AND tow_status = 'towed'
        UNION ALL SELECT 'known_status', count(*) FROM q WHERE local IS NOT NULL AND door IS NOT NULL AND tow_status <> 'unknown'
        UNION ALL SELECT 'excluded', count(*) FROM q WHERE local IS NOT NULL AND door IS NOT NULL AND tow_status = 'unknown'
        UNION ALL SELECT 'label:' || value, count(DISTINCT request_id) FROM fields WHERE name = 'Alleged Violation' AND request_id IN (SELECT request_id FROM ids) GROUP BY value""",
        ATTRS, LOADED, URGENT, "q AS (SELECT * FROM loaded WHERE request_id IN (SELECT request_id FROM ids))",
    ),
    "headline": with_views(HEADLINE, *PAGE),
    "page_summary": with_views(
        f'SELECT tow_pct, unique_pct, "distinct", seen, with_neighbour FROM ({HEADLINE}), (SELECT count(*) AS with_neighbour FROM nb WHERE block_doorways_calling >= 2)', *PAGE
    ),
    "block_headline": with_views(
        """SELECT * FROM (SELECT count(*) AS blocks, coalesce(sum(doorways), 0)::BIGINT AS doorways_held FROM blks),
        (SELECT count(*) AS doorways_listed, count(*) FILTER (block IS NULL) AS unplaced FROM nb)""", *PAGE
    ),
    "top_doorways": with_views(
        "SELECT rank, address, district, calls_12mo, calls_total, tows, vehicles_distinct, round_even(median_gap_days, 6) AS median_gap_days, last_call, block_doorways_calling FROM nb WHERE rank <= 40", *PAGE
    ),
    "top_blocks": with_views(
        """SELECT rank, streets, doorways, calls_12mo, tows, dwellings, CASE WHEN coalesce(calls_per_1k_dwellings, 0) = 0 THEN '-' ELSE format('{:.1f}', calls_per_1k_dwellings) END AS rate,
        district, worst_doorway FROM blks WHERE rank <= 30""", *PAGE
    ),
    "display_doorways": with_views(
        f"""SELECT rank - 1 AS i, {_title('address')} AS a, coalesce(district, '?') AS d, {_title("coalesce(community, '')")} AS c, {_title("coalesce(street, '')")} AS st,
        coalesce(block, '') AS bk, block_doorways_calling AS nb, calls_12mo AS m, calls_total AS t, tows AS w, vehicles_distinct AS vd, vehicles_seen AS vs, repeat_calls AS rp,
        round_even(median_gap_days, 0)::BIGINT AS g, last_call AS l, coalesce(owner, '') AS o, {_r('lat', 'lon')} FROM nb""", *PAGE
    ),
    "display_blocks": with_views(
        f"""SELECT rank - 1 AS i, block AS bk, {_title('streets')} AS s, doorways AS n, calls_12mo AS m, calls_total AS t, tows AS w, dwellings AS dw, calls_per_1k_dwellings AS r,
        coalesce(district, '?') AS d, {_title('worst_doorway')} AS worst, replace({_title('addresses')}, '; ', '|') AS addrs FROM blks""", *PAGE
    ),
    "export_rows": with_views(
        f"""SELECT {_title('address')} AS "Address", coalesce(district, '?') AS "District", {_title("coalesce(community, '')")} AS "Community", {_title("coalesce(street, '')")} AS "Street",
        coalesce(block, '') AS "Block", block_doorways_calling AS "Doorways Calling On Block", calls_12mo AS "Calls (12mo)", calls_total AS "Calls (Total)", repeat_calls AS "Repeat Calls",
        tows AS "Tows", vehicles_distinct AS "Vehicles Distinct", vehicles_seen AS "Vehicles Seen", round_even(median_gap_days, 0)::BIGINT AS "Median Gap Days", last_call AS "Last Call",
        coalesce(owner, '') AS "Owner", round_even(lat, 6) AS "Latitude", round_even(lon, 6) AS "Longitude", 'Any of these!' AS "Violation Type", 'any-of-these' AS slug,
        strftime((SELECT max(date_closed) FROM sel), '%Y-%m-%d %H:%M:%S') AS derived_at, 'unknown' AS last_sync,
        strftime((SELECT max(local) FROM sel), '%Y-%m-%d %H:%M:%S') AS latest_call FROM nb""", *PAGE
    ),
    "export_blocks": with_views(
        f"""SELECT block AS "Block", {_title('streets')} AS "Streets", doorways AS "Doorways", calls_12mo AS "Calls (12mo)", calls_total AS "Calls (Total)", tows AS "Tows",
        dwellings AS "Dwellings", calls_per_1k_dwellings AS "Calls per 1,000 Dwellings", coalesce(district, '?') AS "District", {_title('worst_doorway')} AS "Worst Doorway",
        {_title('addresses')} AS "Addresses", 'Any of these!' AS "Violation Type" FROM blks""", *PAGE
    ),
    "derive_summary": with_views(
        """SELECT (SELECT count(*) FROM doors) AS doorways, (SELECT count(*) FROM doors WHERE block IS NULL) AS unplaced, (SELECT count(*) FROM blks) AS blocks,
        (SELECT count(*) FROM ids WHERE request_id % 9 = 0) AS missing, (SELECT max(local) FROM sel) AS latest""", *SELECTED
    ),
    "export_preamble": with_views(
        """SELECT 'violation_type' AS key, 'Urgent or high' AS value UNION ALL SELECT 'slug', 'urgent-or-high' UNION ALL SELECT 'doorway_count', (SELECT count(*) FROM doors)::VARCHAR
        UNION ALL SELECT 'block_count', (SELECT count(*) FROM blks)::VARCHAR UNION ALL SELECT 'latest_call_date', (SELECT strftime(max(local), '%Y-%m-%d') FROM sel)
        UNION ALL SELECT 'filter: ' || k, v FROM (VALUES ('district', '1'), ('min_calls', '2'), ('min_doorways', '2'), ('recur_days', '365'), ('recency_days', '365')) f(k, v)
        UNION ALL SELECT 'filters_in_effect', 'district = 1, min_calls = 2, min_doorways = 2, recency_days = 365, recur_days = 365'""", *SELECTED
    ),
    "run_metadata": with_views(
        f"""SELECT TIMESTAMP '{NOW}' AS derived_at, (SELECT min(s) FROM (SELECT max(last_success_at) AS s FROM layer_state WHERE layer IN ('click', 'purchase') GROUP BY layer)) AS last_sync,
        (SELECT max(date_initiated) FROM calls) AS newest_call, (SELECT bool_and(coalesce(r, false)) FROM (VALUES ('click'), ('purchase')) l(layer) LEFT JOIN
          (SELECT layer, arg_max(reconciled, started_at) AS r FROM runs WHERE error IS NULL AND reconciled IS NOT NULL GROUP BY 1) USING (layer)) AS reconciled"""
    ),
    "version_map": with_views(
        """SELECT '{' || string_agg('"' || layer || '":' || coalesce('"' || strftime(e, '%Y-%m-%dT%H:%M:%S') || '"', 'null'), ',' ORDER BY layer) || '}' AS version_json, count(*)::INT AS layers
        FROM (VALUES ('view'), ('click'), ('never published')) l(layer) LEFT JOIN (SELECT layer, max(source_last_edit) AS e FROM layer_state GROUP BY 1) USING (layer)"""
    ),
    "hour_histogram": with_views("SELECT * FROM h", _hist("h", _local("ts"), "nullif(event_type, 'click')", "events")),
    "hour_summary": with_views(
        f"""SELECT channel, sum(calls)::BIGINT AS total, arg_max(hour, (calls, -hour)) AS peak_hour,
        {_pct('sum(CASE WHEN hour >= 21 OR hour < 7 THEN calls ELSE 0 END)', 'sum(calls)')} AS night_pct FROM h GROUP BY 1""",
        _hist("h", _local("date_initiated"), "initiated_by", "calls"),
    ),
    "hour_delta": with_views(
        "SELECT channel, hour, coalesce(y.calls, 0) - coalesce(x.calls, 0) AS delta FROM x FULL JOIN y USING (channel, hour) WHERE coalesce(y.calls, 0) <> coalesce(x.calls, 0)",
        _hist("x", _local("date_initiated"), "initiated_by", "calls"), _hist("y", "(date_initiated - INTERVAL 3 HOUR)", "initiated_by", "calls"),
    ),
    "coverage": with_views(
        """SELECT count(*) AS total, count(*) FILTER (value IS NULL) AS n_null, count(*) FILTER (status = 'excluded') AS n_excluded, count(*) FILTER (status = 'ambiguous') AS n_ambiguous,
        count(*) FILTER (value IS NOT NULL AND status IS NULL) AS n_unknown, count(*) FILTER (status = 'assigned') AS n_assigned,
        round_even(count(*) FILTER (status = 'assigned') / count(*), 6) AS assigned_share FROM fields LEFT JOIN dim ON value = raw_label WHERE name = 'Alleged Violation'"""
    ),
    "dimension_check": with_views(
        """SELECT raw_label, uses, status, canonical_type FROM (SELECT raw_label, count(*) AS uses FROM (SELECT raw_label FROM dim UNION ALL SELECT raw_label FROM dim WHERE status = 'excluded')
        GROUP BY 1 HAVING count(*) > 1) JOIN dim USING (raw_label)"""
    ),
    "dimension_totals": with_views(
        """SELECT *, entries = labels AND labels = 5 AS sound FROM (SELECT count(*) AS entries, count(DISTINCT raw_label) AS labels, count(DISTINCT canonical_type) AS types, sum(n)::BIGINT AS labelled_rows,
        coalesce(sum(n) FILTER (status = 'assigned'), 0)::BIGINT AS assigned_rows, coalesce(sum(n) FILTER (status = 'excluded'), 0)::BIGINT AS excluded_rows,
        coalesce(sum(n) FILTER (status = 'ambiguous'), 0)::BIGINT AS ambiguous_rows,
        round_even(sum(n) FILTER (status = 'assigned') / (sum(n) - coalesce(sum(n) FILTER (status = 'excluded'), 0)), 6) AS assigned_share
        FROM dim JOIN (SELECT value AS raw_label, count(*) AS n FROM fields WHERE name = 'Alleged Violation' GROUP BY 1) USING (raw_label))"""
    ),
    "published_types": with_views(
        "SELECT canonical_type, CASE WHEN label IS NULL THEN 'null' ELSE coalesce(status, 'unknown') END AS label_status, count(*) AS n FROM pub LEFT JOIN tab ON label = raw_label GROUP BY 1, 2", *PUBLISHED
    ),
    "published_coverage": with_views(
        """SELECT count(*) AS total, count(*) FILTER (label IS NULL) AS n_null, count(*) FILTER (status = 'excluded') AS n_excluded, count(*) FILTER (status = 'ambiguous') AS n_ambiguous,
        count(*) FILTER (label IS NOT NULL AND status IS NULL) AS n_unknown, count(*) FILTER (status = 'assigned') AS n_assigned,
        round_even(count(*) FILTER (status = 'assigned') / count(*), 6) AS assigned_share FROM pub LEFT JOIN tab ON label = raw_label""", *PUBLISHED
    ),
    "type_counts": with_views(
        """SELECT canonical_type, raw_label, n AS count, coalesce(live, 0) AS live FROM tab LEFT JOIN (SELECT label AS raw_label, count(*) AS live FROM pub GROUP BY 1) USING (raw_label)
        WHERE status = 'assigned'""", *PUBLISHED
    ),
    "address_spread": with_views(
        f"""SELECT * FROM (SELECT count(*) AS addresses, count(*) FILTER (calls > 1) AS multi, {_pct('count(*) FILTER (calls > 1 AND spread > 50)', 'count(*) FILTER (calls > 1)')} AS over_50_pct,
        {_pct('count(*) FILTER (calls > 1 AND spread > 200)', 'count(*) FILTER (calls > 1)')} AS over_200_pct FROM sp), (SELECT count(*) AS near_pairs FROM near),
        (SELECT count(*) AS involved FROM (SELECT a FROM near UNION SELECT b FROM near))""", _points(), _spread(), _near(30.0)
    ),
    "spread_compare": with_views(
        f"""SELECT split_part(door, '|', 1) AS canonical_type, count(*) AS addresses, count(*) FILTER (calls > 1) AS multi,
        {_pct('count(*) FILTER (calls > 1 AND spread > 200)', 'count(*) FILTER (calls > 1)')} AS over_200_pct FROM sp GROUP BY 1""",
        TYPES, _points(), "tp AS (SELECT canonical_type || '|' || door AS door, x, y FROM pts JOIN types USING (request_id))", _spread("tp"),
    ),
    "near_duplicates": with_views("SELECT a, b, round_even(metres, 6) AS metres FROM near", _points(400), _near(300.0)),
    "nearest_pairs": with_views("SELECT a, b, round_even(metres, 3) AS metres FROM near ORDER BY round_even(metres, 3), a, b LIMIT 8", _points(400), _near(300.0)),
    "crowded_pairs": with_views(
        "SELECT a, b, round_even(metres, 3) AS metres FROM near ORDER BY round_even(metres, 3), a, b LIMIT 8",
        """pts AS (SELECT request_id || ' CROWDED ST' AS door, ((request_id * 104729 % 100003 + 1) / 1e7 + -63.0::DOUBLE) * 111320.0 * cos(radians(44.65)) AS x,
  ((request_id * 7919 % 100003 + 1) / 1e7 + 44.0::DOUBLE) * 111320.0 AS y FROM calls WHERE address IS NOT NULL)""", _near(1000.0)
    ),
    "snapshot_rows": with_views(
        f"""SELECT 7 AS snapshot_id, TIMESTAMP '{CUTOFFS[2]}' AS derived_at, 'all' AS violation_type, address, rank, block, district, calls_12mo, calls_total, tows, vehicles_seen, vehicles_distinct,
        '{{"community":"' || community || '","last_call":"' || last_call || '","repeat_calls":' || repeat_calls || '}}' AS detail FROM doors""", *BASE
    ),
    "snapshot_blocks": with_views(
        f"""SELECT 7 AS snapshot_id, TIMESTAMP '{CUTOFFS[2]}' AS derived_at, canonical_type AS violation_type, block, rank, streets, district, doorways, calls_12mo, calls_total, tows, dwellings,
        '{{"worst_doorway":"' || worst_doorway || '"}}' AS detail FROM blks""", *ALL, _blocks()
    ),
    "version_headers": with_views(
        f"""SELECT 7 AS snapshot_id, TIMESTAMP '{CUTOFFS[2]}' AS derived_at, canonical_type AS violation_type, coalesce(n, 0) AS listed,
        '{{"district": null, "min_calls": 2, "min_doorways": 2, "recur_days": 90}}' AS parameters,
        (SELECT '{{' || string_agg('"' || layer || '":"' || strftime(e, '%Y-%m-%dT%H:%M:%S') || '"', ',' ORDER BY layer) || '}}' FROM (
          SELECT layer, max(source_last_edit) AS e FROM layer_state WHERE layer IN ('view', 'click') GROUP BY 1)) AS mirror_version, latest::VARCHAR AS latest_call_date
        FROM (SELECT DISTINCT canonical_type FROM dim WHERE status = 'assigned') LEFT JOIN (SELECT canonical_type, count(*) AS n FROM d0 WHERE canonical_type <> 'Urgent or high' GROUP BY 1) USING (canonical_type)
        LEFT JOIN (SELECT canonical_type, max(local)::DATE AS latest FROM sel0 GROUP BY 1) USING (canonical_type)""",
        ATTRS, LOADED, TYPES, TYPED, "sel0 AS (SELECT * FROM sel WHERE local < TIMESTAMP '1998-01-01')", _gaps(sel="sel0", name="gaps0"), _doors(sel="sel0", gaps="gaps0", name="d0"),
    ),
    "snapshot_headers": with_views("SELECT snapshot_id, derived_at, violation_type, listed FROM heads WHERE violation_type = 'Medium or low'", *_snapshots()),
    "departed": with_views(
        "SELECT address, rank, calls_12mo FROM snaps WHERE snapshot_id = 1 AND violation_type = 'Medium or low' AND address NOT IN (SELECT address FROM snaps WHERE snapshot_id = 2 AND violation_type = 'Medium or low')", *_snapshots()
    ),
    "blocks_departed": with_views("SELECT block, doorways, calls_12mo FROM b1 WHERE block NOT IN (SELECT block FROM b2)", ATTRS, LOADED, ONE, *_at(CUTOFFS[0], 1), *_at(CUTOFFS[1], 2)),
    "presence": with_views(
        """SELECT a.violation_type, a.address, h.snapshot_id, EXISTS (SELECT 1 FROM snaps s WHERE s.violation_type = a.violation_type AND s.address = a.address AND s.snapshot_id = h.snapshot_id) AS present
        FROM (SELECT DISTINCT violation_type, address FROM snaps) a JOIN heads h USING (violation_type)""", *_snapshots()
    ),
    "left_when": with_views(
        """SELECT violation_type, address, CASE WHEN l IS NULL THEN 'never_listed' WHEN l = 3 THEN 'still_listed' ELSE 'left' END AS status, h.derived_at AS last_seen_at, n.derived_at AS left_at
        FROM (SELECT violation_type, address, max(snapshot_id) AS l FROM (SELECT * FROM (SELECT DISTINCT door AS address FROM loaded WHERE door IS NOT NULL), (SELECT DISTINCT violation_type FROM heads))
          LEFT JOIN snaps USING (violation_type, address) GROUP BY 1, 2)
        LEFT JOIN (SELECT DISTINCT snapshot_id, derived_at FROM heads) h ON h.snapshot_id = l LEFT JOIN (SELECT DISTINCT snapshot_id, derived_at FROM heads) n ON n.snapshot_id = l + 1""", *_snapshots()
    ),
    "stored_figures": with_views(
        """SELECT canonical_type, version, payload, payload IS NOT NULL AS available FROM (SELECT * FROM (SELECT DISTINCT canonical_type FROM dim WHERE status = 'assigned'), (VALUES ('1997-02'), ('1997-03')) v(version))
        LEFT JOIN (SELECT canonical_type, strftime(date_initiated, '%Y-%m') AS version, count(*)::VARCHAR AS payload FROM calls JOIN types USING (request_id)
          WHERE strftime(date_initiated, '%Y-%m') <> '1997-03' GROUP BY 1, 2) USING (canonical_type, version)""", TYPES
    ),
    "missing_figures": with_views(
        """SELECT DISTINCT canonical_type FROM dim WHERE status = 'assigned' AND canonical_type NOT IN (
        SELECT canonical_type FROM calls JOIN types USING (request_id) WHERE canonical_type = 'Urgent or high')""", TYPES
    ),
    "upsert_latest": with_views(
        """SELECT object_id, request_id, field_id, name, value, written FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY written DESC) AS r FROM (
        SELECT *, 1 AS written FROM fields UNION ALL SELECT object_id, request_id, field_id, name, upper(value), 2 FROM fields WHERE request_id % 3 = 0)) WHERE r = 1"""
    ),
    "version_sample": with_views(
        f"SELECT 'service_requests' AS layer, TIMESTAMP '{CUTOFFS[0]}' AS edited_at, request_id::VARCHAR AS business_key, object_id FROM calls WHERE request_id % 128 = 0"
    ),
    "merged_deltas": with_views(DELTAS),
    "streamed_deltas": with_views(DELTAS),
    "kept_samples": with_views(
        " UNION ALL ".join(
            f"""SELECT 'service_requests' AS layer, TIMESTAMP '{d}' AS edited_at, request_id::VARCHAR AS business_key, object_id FROM calls
            WHERE request_id % 128 = 0 AND date_initiated < TIMESTAMP '{d}'""" for d in CUTOFFS[:2]
        )
    ),
    "footer_identity": with_views("SELECT count(*) AS n_rows, max(object_id) AS max_object_id, max(date_initiated) AS newest_call FROM calls"),
    "footer_counts": with_views(
        """SELECT layer, 'count_divergence' AS kind, (count(*) FILTER (layer <> 'click' OR run_id % 2 = 0))::VARCHAR AS stored, count(*)::VARCHAR AS published FROM runs GROUP BY 1
        HAVING count(*) <> count(*) FILTER (layer <> 'click' OR run_id % 2 = 0)"""
    ),
    "version_identity": with_views("SELECT count(*) AS n_rows, max(object_id) AS max_object_id FROM fields"),
    "renumbering": with_views(
        """SELECT *, CASE WHEN shared = 0 THEN 'no_shared_keys' WHEN moved = 0 THEN 'preserved' WHEN kept = 0 THEN 'reassigned' ELSE 'partially_reassigned' END AS verdict FROM (
        SELECT count(*) FILTER (was IS NOT NULL AND now IS NOT NULL) AS shared, count(*) FILTER (was = now) AS kept, count(*) FILTER (was <> now) AS moved,
        count(*) FILTER (now IS NULL) AS only_in_older, count(*) FILTER (was IS NULL) AS only_in_newer FROM old FULL JOIN new USING (business_key))""", SHIFTED
    ),
    "moved_examples": with_views("SELECT business_key, was, now FROM old JOIN new USING (business_key) WHERE was <> now ORDER BY business_key LIMIT 5", SHIFTED),
    "few_changes": with_views("SELECT * FROM td", TOUCHED, _diff("calls", "touched", ["request_id"], CALL_FIELDS, "td")),
    "copies_agree": with_views(
        """SELECT (SELECT count(*) FROM calls) AS rows_a, (SELECT count(*) FROM calls) AS rows_b, true AS agree, 'same' AS copy
        UNION ALL SELECT (SELECT count(*) FROM calls), (SELECT count(*) FROM touched), NOT EXISTS (SELECT * FROM calls EXCEPT SELECT * FROM touched), 'touched'""", TOUCHED
    ),
    "merged_runs": with_views(
        """SELECT violation_type, address, min(snapshot_id)::INT AS first_ord, max(snapshot_id)::INT AS last_ord FROM (
          SELECT *, snapshot_id - row_number() OVER (PARTITION BY violation_type, address ORDER BY snapshot_id) AS g FROM (SELECT DISTINCT violation_type, address, snapshot_id FROM snaps))
        GROUP BY 1, 2, g""", *_snapshots()
    ),
    "row_diff": with_views("SELECT * FROM rd", ALTERED, ROW_DIFF),
    "field_diff": with_views("SELECT * FROM fd", FIELD_DIFF),
    "id_diff": with_views(
        """SELECT (SELECT count(*) FROM (SELECT request_id FROM x UNION SELECT request_id FROM altered)) AS either, (SELECT count(*) FROM x WHERE request_id IN (SELECT request_id FROM altered)) AS common,
        (SELECT count(*) FROM x WHERE request_id NOT IN (SELECT request_id FROM altered)) AS only_a, (SELECT count(*) FROM altered WHERE request_id NOT IN (SELECT request_id FROM x)) AS only_b""",
        ALTERED, "x AS (SELECT * FROM calls WHERE request_id % 5 <> 0)",
    ),
    "clean_verdict": with_views("SELECT count(*) AS differences, count(*) = 0 AS clean FROM (SELECT 1 FROM rd UNION ALL SELECT 1 FROM fd)", ALTERED, ROW_DIFF, FIELD_DIFF),
    "list_diff": with_views(
        """SELECT address, CASE change WHEN 'only_a' THEN 'missing' WHEN 'only_b' THEN 'extra' ELSE 'cell' END AS change, field, a, b FROM ld
        UNION ALL SELECT address, 'reordered', 'rank', pa::VARCHAR, pb::VARCHAR FROM (SELECT address, row_number() OVER (ORDER BY x.rank) AS pa, row_number() OVER (ORDER BY y.rank) AS pb
          FROM doors x JOIN e2 y USING (address)) WHERE pa <> pb""",
        *BASE, "s2 AS (SELECT * FROM sel WHERE request_id % 41 <> 0)", _gaps(sel="s2", name="g2"), _doors(sel="s2", gaps="g2", name="e2"),
        _diff("doors", "e2", ["address"], ["calls_12mo", "calls_total", "tows"], "ld"),
    ),
    "source_intervals": with_views("SELECT layer, edited_at, round_even(seconds, 6) AS seconds FROM iv", INTERVALS),
    "source_estimate": with_views(
        f"""SELECT layer, n AS intervals, n >= 2 AS known, CASE WHEN n >= 2 THEN last + to_microseconds((m * 1000000)::BIGINT) END AS estimated_next,
        CASE WHEN n >= 2 THEN round_even(m / 86400, 1) END AS median_days, coalesce(n >= 2 AND TIMESTAMP '{NOW}' > last + to_microseconds((m * 1000000)::BIGINT), false) AS passed
        FROM (SELECT layer, count(seconds) AS n, median(seconds) AS m, max(edited_at) AS last FROM iv GROUP BY 1)""", INTERVALS
    ),
    "advanced": with_views(
        """SELECT layer, o AS observed, pulled, coalesce(o > pulled, o IS NOT NULL) AS advanced FROM (SELECT layer, max(source_last_edit) AS o FROM layer_state GROUP BY 1)
        LEFT JOIN pulled USING (layer)""", PULLED
    ),
    "reconciled": with_views("SELECT * FROM rec", RECONCILED),
    "all_reconciled": with_views("SELECT bool_and(coalesce(reconciled, false)) AS reconciled FROM rec", RECONCILED),
    "may_derive": with_views(
        "SELECT count(*) FILTER (ok) = 2 AS may_derive FROM (SELECT layer, arg_max(error IS NULL, started_at) AS ok FROM runs WHERE layer IN ('click', 'purchase') GROUP BY 1)"
    ),
    "count_check": with_views(
        """SELECT layer, 'count_divergence' AS kind, count(*)::VARCHAR AS stored, (count(*) FILTER (layer = 'click' OR error IS NULL))::VARCHAR AS published FROM runs GROUP BY 1
        HAVING count(*) <> count(*) FILTER (layer = 'click' OR error IS NULL)"""
    ),
    "republished": with_views(
        """SELECT layer, b AS before, a AS after FROM (SELECT layer, max(source_edit) AS b FROM runs WHERE layer <> 'click' GROUP BY 1)
        FULL JOIN (SELECT layer, min(source_edit) AS a FROM runs WHERE error IS NULL AND run_id % 2 = 0 GROUP BY 1) USING (layer) WHERE a IS DISTINCT FROM b"""
    ),
    "readiness": with_views("SELECT * FROM ready", READY),
    "freshness_rows": with_views(
        f"""SELECT store, last_success_at, last_attempt_at, next_due_at, behind, readiness, strftime(newest, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS newest_call, true AS call_known,
        age > 21 AS stale, round_even(age, 1) AS days_old, readiness = 'ready' AS due_known, readiness = 'ready' AND TIMESTAMP '{NOW}' > next_due_at AS due_passed, overdue,
        CASE WHEN overdue THEN floor(late)::DOUBLE END AS seconds_overdue, CASE WHEN overdue THEN round_even(late / 86400, 1) END AS days_overdue,
        CASE WHEN behind THEN 'this_system' WHEN overdue THEN 'unknown' ELSE 'source' END AS lag_owner FROM (
        SELECT *, date_diff('microsecond', newest, TIMESTAMP '{NOW}') / 86400000000 AS age,
          readiness = 'ready' AND TIMESTAMP '{NOW}' > next_due_at + INTERVAL 1 DAY AND NOT coalesce(last_success_at >= next_due_at, false) AS overdue,
          date_diff('microsecond', next_due_at + INTERVAL 1 DAY, TIMESTAMP '{NOW}') / 1000000 AS late
        FROM (SELECT store, min(last_success_at) AS last_success_at, max(last_attempt_at) AS last_attempt_at, min(next_due_at) AS next_due_at, bool_or(behind) AS behind
          FROM lay WHERE NOT static GROUP BY 1) JOIN ready USING (store)
        LEFT JOIN (SELECT 'store' || (user_id % 7) AS store, min(ts) AS newest FROM events GROUP BY 1) USING (store))""", PULLED, LAYERS, READY
    ),
    "layer_limits": with_views('SELECT store, layer, behind, "limit" FROM lay', PULLED, LAYERS),
    "newest_call": with_views("SELECT max(date_initiated) AS newest_call FROM calls"),
    "current_decisions": with_views(
        """SELECT scope, item_key, arg_max(decision, changed_at) AS decision, arg_max(r, changed_at) AS role, coalesce(arg_max_null(n, changed_at), '') AS note FROM good
        WHERE violation_type = 'Urgent or high' GROUP BY 1, 2""", GOOD
    ),
    "rejected_decisions": with_views(
        """SELECT CASE WHEN NOT coalesce(scope IN ('doorway', 'block'), false) THEN 'unknown scope' WHEN coalesce(trim(item_key), '') = '' THEN 'no item'
        WHEN coalesce(trim(decision), '') = '' THEN 'no decision' END AS reason, count(*) AS n FROM decisions
        WHERE NOT coalesce(scope IN ('doorway', 'block'), false) OR coalesce(trim(item_key), '') = '' OR coalesce(trim(decision), '') = '' GROUP BY 1"""
    ),
    "retained_versions": with_views(
        """SELECT *, row_number() OVER (PARTITION BY layer ORDER BY edited_at NULLS FIRST, version_id)::INT AS position FROM (
        SELECT layer, run_id AS version_id, CASE WHEN error IS NULL THEN source_edit END AS edited_at FROM runs WHERE kind = 'full_load')"""
    ),
    "landed_calls": with_views(
        f"SELECT object_id, request_id, {', '.join(CALL_FIELDS)} FROM calls"
    ),
    "landed_fields": with_views("SELECT object_id, request_id, field_id, name, value FROM fields"),
    "landed_areas": with_views(
        """SELECT dauid::BIGINT AS object_id, dauid, NULL::INT AS people, nullif(dwellings, 0) AS dwellings, 'part ' || dauid AS subdivision, 'whole' AS division,
        CASE WHEN dauid <> '24' THEN min_lon END AS min_lon, CASE WHEN dauid <> '24' THEN min_lat END AS min_lat, CASE WHEN dauid <> '24' THEN max_lon END AS max_lon,
        CASE WHEN dauid <> '24' THEN max_lat END AS max_lat FROM areas"""
    ),
    "scanned_areas": with_views("SELECT dauid, dwellings, 0 AS people, min_lon, min_lat, max_lon, max_lat FROM areas WHERE dauid <> '24'"),
    "area_edges": with_views("SELECT dauid, x1, y1, x2, y2 FROM edges WHERE dauid <> '24'"),
    "scanned_calls": with_views("SELECT object_id, request_id, date_initiated, date_closed, address, community, district, latitude, longitude, initiated_by FROM calls"),
    "epoch_times": with_views("SELECT event_id, epoch_ms(ts) AS ms, CASE WHEN event_id % 10 <> 0 THEN make_timestamp(epoch_ms(ts) * 1000) END AS back FROM events"),
    "replaced_snapshot": with_views("SELECT run_id, layer, started_at FROM runs WHERE layer <> 'click'"),
    "landed_stream": with_views("SELECT run_id, layer, started_at FROM runs WHERE run_id % 2 = 1"),
    "listed_as_text": with_views("SELECT rank::VARCHAR AS rank, address, calls_12mo::VARCHAR AS calls_12mo, calls_total::VARCHAR AS calls_total, tows::VARCHAR AS tows, last_call FROM doors", *BASE),
    "lists_by_type": with_views(
        "SELECT canonical_type, rank::VARCHAR AS rank, address, calls_total::VARCHAR AS calls_total, replace(lower(canonical_type), ' ', '-') AS slug FROM doors", *ALL
    ),
    "retained_snapshots": with_views(
        """SELECT i AS snapshot_id, canonical_type AS violation_type, coalesce(d, 0) AS listed, coalesce(d, 0) AS doorways, coalesce(b, 0) AS blocks
        FROM (SELECT DISTINCT canonical_type FROM dim WHERE status = 'assigned') CROSS JOIN (VALUES (1), (2)) v(i)
        LEFT JOIN (SELECT 1 AS i, canonical_type, count(*) AS d FROM d1 GROUP BY 2 UNION ALL SELECT 2, canonical_type, count(*) FROM d2 GROUP BY 2) USING (i, canonical_type)
        LEFT JOIN (SELECT 1 AS i, canonical_type, count(*) AS b FROM b1 GROUP BY 2 UNION ALL SELECT 2, canonical_type, count(*) FROM b2 GROUP BY 2) USING (i, canonical_type)""",
        ATTRS, LOADED, TYPES, TYPED,
        *[c for i in (1, 2) for c in (f"sel{i} AS (SELECT * FROM sel WHERE local < TIMESTAMP '{CUTOFFS[i - 1]}')", _gaps(sel=f"sel{i}", name=f"gaps{i}"),
                                      _doors(sel=f"sel{i}", gaps=f"gaps{i}", name=f"d{i}"), _blocks(2, f"d{i}", f"b{i}"))],
    ),
    "derived_versions": with_views(
        """SELECT i AS snapshot_id, canonical_type AS violation_type, '{"custom_fields":"2024-0' || i || '","service_requests":"2024-0' || i || '"}' AS mirror_version,
          coalesce(d, 0) AS listed, coalesce(d, 0) AS doorways, coalesce(b, 0) AS blocks, tn, closed, selection, labels
        FROM (SELECT DISTINCT canonical_type FROM dim WHERE status = 'assigned') CROSS JOIN (VALUES (1), (2)) v(i)
        LEFT JOIN (SELECT 1 AS i, canonical_type, count(*) AS d FROM d1 GROUP BY 2 UNION ALL SELECT 2, canonical_type, count(*) FROM d2 GROUP BY 2) USING (i, canonical_type)
        LEFT JOIN (SELECT 1 AS i, canonical_type, count(*) AS b FROM b1 GROUP BY 2 UNION ALL SELECT 2, canonical_type, count(*) FROM b2 GROUP BY 2) USING (i, canonical_type)
        LEFT JOIN (SELECT i, canonical_type, count(*) FILTER (door IS NOT NULL AND local IS NOT NULL AND tow_status = 'towed') AS tn,
            count(*) FILTER (date_initiated IS NOT NULL AND date_closed IS NOT NULL) AS closed, count(*) AS selection,
            count(DISTINCT label) AS labels FROM (SELECT 1 AS i, * FROM sel1 UNION ALL SELECT 2, * FROM sel2) GROUP BY 1, 2) USING (i, canonical_type)""",
        ATTRS, LOADED, TYPES, TYPED,
        *[c for i in (1, 2) for c in (f"sel{i} AS (SELECT * FROM sel WHERE date_initiated < TIMESTAMP '{CUTOFFS[i - 1]}')", _gaps(sel=f"sel{i}", name=f"gaps{i}"),
                                      _doors(sel=f"sel{i}", gaps=f"gaps{i}", name=f"d{i}"), _blocks(2, f"d{i}", f"b{i}"))],
    ),
    "kept_figures": with_views(
        """SELECT canonical_type, 'v1' AS version, '{}' AS parameters, CASE canonical_type WHEN 'Urgent or high' THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS stored_at,
        '{"nn":' || nn || ',"nr":' || nr || ',"tn":' || CASE canonical_type WHEN 'Urgent or high' THEN tn ELSE 0 END || ',"tr":' || tr || '}' AS payload FROM totals""", *FLAGS, TALLY, TOTALS
    ),
}
