"""The registered queries of the incident model; their SQL twins are in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import derive, figures, freshness, geo, history, places, reconcile, select, triage, types
from ..sources.layers import settled
from .adapter import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KIND = "canonical_type"
NOW = "2024-02-20 12:00:00"
CUTOFFS = ("1998-01-01", "1999-06-01", "2001-06-01")
DOOR = ["rank", "address", "calls_12mo", "calls_total", "district", "community", "owner", "tows", "tow_rate", "vehicles_seen", "vehicles_distinct",
        "repeat_calls", "median_gap_days", "last_call", "street", "block", "block_dwellings", "lat", "lon"]
BLOCK = ["rank", "block", "streets", "doorways", "calls_12mo", "calls_total", "tows", "dwellings", "calls_per_1k_dwellings", "district", "worst_doorway",
         "addresses"]


def query(f):
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Inputs(spark, sf_dir))

    QUERIES[f.__name__] = run
    return run


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that engines that sum in other orders agree."""
    if "block_dwellings" in df.columns:
        df = df.withColumn("block_dwellings", F.col("block_dwellings").cast("double"))
    return df.select(*[F.bround(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def everything(t: Inputs) -> DataFrame:
    return select.load(t.calls, t.fields)


def typed(t: Inputs) -> DataFrame:
    return everything(t).join(select.canonical_types(t.fields, t.dim), "request_id")


def doors_of(t: Inputs, loaded: DataFrame, **kw) -> DataFrame:
    return places.doorways(loaded, t.covered, **{"busy": t.busy, **kw})


def watched(t: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    loaded = everything(t)
    doors = places.neighbours(doors_of(t, loaded))
    return loaded, doors, places.blocks(doors)


@query
def recent_watchlist(t):
    rows = places.doorways(everything(t), busy=t.busy)
    return rounded(rows.select("rank", "address", "calls_12mo", "calls_total", "tows", "tow_rate", "repeat_calls", "median_gap_days", "last_call"))


@query
def doorways_full(t):
    return rounded(doors_of(t, everything(t)).select(*DOOR))


def crowded(t) -> DataFrame:
    """Half of all calls at one doorway."""
    return everything(t).withColumn("door", F.when(F.col("request_id") % 2 == 0, "1 CROWDED ST").otherwise(F.col("door")))


@query
def crowded_doorways(t):
    """A doorway with half of all calls is cut into runs by time."""
    busy = settled(crowded(t).groupBy("door").agg(F.count("*").alias("calls")).filter("calls > 1000"), "busy")
    return rounded(doors_of(t, crowded(t), busy=busy).select(*DOOR))


@query
def blocks(t):
    return rounded(places.blocks(doors_of(t, everything(t))).select(*BLOCK))


@query
def watchlist_with_neighbours(t):
    doors = doors_of(t, everything(t), district="1")
    return rounded(places.with_neighbours(doors, places.blocks(doors)).select(*DOOR, "block_doorways_calling"))


@query
def doorways_all_types(t):
    return rounded(doors_of(t, typed(t), by=[KIND]).select(KIND, *DOOR))


@query
def blocks_all_types(t):
    return rounded(places.blocks(doors_of(t, typed(t), by=[KIND]), by=[KIND]).select(KIND, *BLOCK))


@query
def recency_window(t):
    return rounded(doors_of(t, everything(t), recency_days=30, min_calls=1, recur_days=30).select(*DOOR))


@query
def label_substring(t):
    ids = select.ids_by_substring(t.fields, "i%h")
    return select.load(t.calls, t.fields, ids).select("request_id", "door", "label", "tow_status", "local")


@query
def label_canonical(t):
    ids = select.ids_by_type(t.fields, t.dim, "Medium or low")
    return select.load(t.calls, t.fields, ids).select("request_id", "door", "label", "owner", F.col("vehicle.make").alias("make"))


@query
def matched_labels(t):
    return select.matched_labels(t.fields, "i%h")


@query
def eav_pivot(t):
    return select.pivot_attributes(t.fields)


@query
def missing_ids(t):
    return select.missing_ids(select.ids_by_type(t.fields, t.dim, "Urgent or high"), t.calls.filter("request_id % 9 <> 0"))


@query
def point_in_polygon(t):
    points = t.calls.filter("latitude <> 0 and longitude <> 0").select(
        F.col("request_id").alias("point"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat")
    )
    return geo.containing_area(points, t.covered)


@query
def recurrence_by_tow(t):
    flags = figures.recurrence_flags(typed(t), by=[KIND], busy=t.busy)
    return figures.recurrence_by_tow(flags, [KIND])


@query
def tow_tallies(t):
    return figures.tallies(figures.recurrence_flags(everything(t), busy=t.busy))


def type_tallies(t) -> DataFrame:
    return figures.tallies(figures.recurrence_flags(typed(t), by=[KIND], busy=t.busy), [KIND])


@query
def wald_interval(t):
    return rounded(figures.wald_interval(figures.group_totals(type_tallies(t), [KIND])))


@query
def cluster_bootstrap(t):
    return rounded(figures.cluster_bootstrap(settled(type_tallies(t), "tallies"), [KIND]))


@query
def unit_bootstrap(t):
    """Doorways told apart by unit, of which a type has thousands."""
    units = typed(t).withColumn("door", F.concat("door", F.lit(" unit "), (F.col("request_id") % 7).cast("string")))
    return rounded(figures.cluster_bootstrap(settled(figures.tallies(figures.recurrence_flags(units, by=[KIND]), [KIND]), "tallies"), [KIND]))


@query
def effect_bound(t):
    return figures.effect_bound(type_tallies(t), [KIND])


@query
def tow_verdict(t):
    return figures.tow_verdict(figures.effect_bound(type_tallies(t), [KIND])).select(KIND, "tow_verdict")


@query
def vehicle_verdict(t):
    return figures.vehicle_verdict(figures.vehicle_totals(doors_of(t, typed(t), by=[KIND]), [KIND]))


@query
def type_record(t):
    return figures.type_record(places.door_measures(typed(t), by=[KIND], busy=t.busy), t.dim)


@query
def response_time(t):
    kinds = select.canonical_types(t.fields, t.dim)
    calls = t.calls.join(kinds, "request_id").withColumn("local", C.to_local(F.col("date_initiated")))  # no attribute is needed
    return rounded(figures.response_time(calls, "2000-06-30", [KIND]))


@query
def denominators(t):
    ids = select.ids_by_type(t.fields, t.dim, "Urgent or high")
    return figures.denominators(select.load(t.calls, t.fields, ids), t.fields, ids, "1999-12-31")


@query
def headline(t):
    loaded, doors, _ = watched(t)
    return places.headline(loaded, doors)


@query
def page_summary(t):
    loaded, doors, _ = watched(t)
    return places.page_summary(loaded, doors)


@query
def block_headline(t):
    _, doors, rows = watched(t)
    return places.block_headline(rows, doors)


@query
def top_doorways(t):
    _, doors, _ = watched(t)
    cols = ["rank", "address", "district", "calls_12mo", "calls_total", "tows", "vehicles_distinct", "median_gap_days", "last_call", "block_doorways_calling"]
    return rounded(doors.filter("rank <= 40").select(*cols))


@query
def top_blocks(t):
    _, _, rows = watched(t)
    rate = F.when(F.coalesce("calls_per_1k_dwellings", F.lit(0.0)) == 0, "-").otherwise(F.format_string("%.1f", "calls_per_1k_dwellings"))
    return rows.filter("rank <= 30").select("rank", "streets", "doorways", "calls_12mo", "tows", "dwellings", rate.alias("rate"), "district", "worst_doorway")


@query
def display_doorways(t):
    return places.display_doorways(watched(t)[1])


@query
def display_blocks(t):
    rows = places.display_blocks(watched(t)[2])
    return rows.withColumn("addrs", F.array_join("addrs", "|"))


FILTERS = {**history.PARAMETERS, "recency_days": places.RECENCY_DAYS}


@query
def export_rows(t):
    loaded, doors, _ = watched(t)
    clocks = loaded.agg(F.max("date_closed").alias("derived_at"), F.lit(None).cast("timestamp_ntz").alias("last_sync"), F.max("local").alias("latest_call"))
    return places.stamp(places.export_doorways(doors, "Any of these!").withColumn("slug", C.slug(F.col("Violation Type"))), clocks)


@query
def export_blocks(t):
    return places.export_blocks(watched(t)[2], "Any of these!")


def derived_of(t, **filters) -> derive.Derived:
    """The lists of one type in one district, some of its selected calls missing from the table."""
    ids = select.ids_by_type(t.fields, t.dim, "Urgent or high")
    return derive.derive(t.calls.filter("request_id % 9 <> 0"), t.fields, t.covered, ids, **filters)


@query
def derive_summary(t):
    return derived_of(t, district="1").summary()


@query
def export_preamble(t):
    return derive.export_lists(derived_of(t, district="1"), "Urgent or high", {**FILTERS, "district": "1"})[0]


@query
def run_metadata(t):
    state = t.layer_state.groupBy("layer").agg(F.max("last_success_at").alias("last_success_at"))
    return derive.run_metadata(t.calls, t.runs, state, ["click", "purchase"], NOW)


@query
def version_map(t):
    return history.version_map(t.layer_state, ["view", "click", "never published"]).select(F.col("version_json"), F.size("version").alias("layers"))


@query
def hour_histogram(t):
    events = t.events.select(C.to_local(F.col("ts")).alias("local"), F.nullif("event_type", F.lit("click")).alias("channel"))
    return geo.hour_histogram(events)


@query
def hour_summary(t):
    calls = t.calls.select(C.to_local(F.col("date_initiated")).alias("local"), F.col("initiated_by").alias("channel"))
    return geo.hour_summary(geo.hour_histogram(calls))


@query
def hour_delta(t):
    one = lambda c: geo.hour_histogram(t.calls.select(c.alias("local"), F.col("initiated_by").alias("channel")))
    at = F.col("date_initiated")
    return geo.hour_delta(one(C.to_local(at)), one(C.to_fixed_offset(at)))


@query
def coverage(t):
    return select.coverage(t.fields, t.dim)


@query
def dimension_check(t):
    twice = t.dim.unionByName(t.dim.filter("status = 'excluded'"))
    return select.dimension_faults(twice).join(t.dim, "raw_label").select("raw_label", "uses", "status", "canonical_type")


def counted_dim(t) -> DataFrame:
    """The dimension with the rows that each label has."""
    live = t.fields.filter(F.col("name") == select.LABEL).groupBy(F.col("value").alias("raw_label")).agg(F.count("*").alias("frozen_count"))
    return t.dim.join(live, "raw_label")


@query
def dimension_totals(t):
    return types.dimension_totals(counted_dim(t), 5, None)


def published(t) -> DataFrame:
    """Calls under published labels, in turn; some without one, some under a label that is unknown."""
    labels = [row[0] for row in types.dimension_rows()] + [None, "no parking sign", "Unheard of"]
    numbered = t.spark.createDataFrame(list(enumerate(labels)), "i int, label string")
    calls = t.fields.filter(F.col("name") == select.LABEL).select("request_id", (F.col("request_id") * 31 % len(labels)).cast("int").alias("i"))
    return calls.join(F.broadcast(numbered), "i").drop("i")


@query
def published_types(t):
    found = types.type_of(published(t), types.type_dimension(t.spark))
    return found.groupBy("canonical_type", "label_status").agg(F.count("*").alias("n"))


@query
def published_coverage(t):
    rows = published(t).select(F.col("label").alias("value"), F.lit(select.LABEL).alias("name"))
    return select.coverage(rows, types.type_dimension(t.spark))


@query
def type_counts(t):
    live = published(t).groupBy(F.col("label").alias("raw_label")).agg(F.count("*").alias("live"))
    return types.type_counts(types.type_dimension(t.spark)).join(live, "raw_label", "left").fillna(0, ["live"])


@query
def address_spread(t):
    return rounded(geo.spread_report(t.calls))


@query
def spread_compare(t):
    return geo.spread_by(t.calls.join(select.canonical_types(t.fields, t.dim), "request_id"), KIND)


def jittered(t) -> DataFrame:
    """Calls drawn close together, so that neighbouring addresses come within metres."""
    return t.calls.withColumn("latitude", F.col("latitude") / 400).withColumn("longitude", F.col("longitude") / 400)


@query
def near_duplicates(t):
    return rounded(geo.near_pairs(jittered(t), 300.0))


@query
def nearest_pairs(t):
    return geo.nearest_pairs(jittered(t), 300.0)


@query
def crowded_pairs(t):
    """Every request an address of its own, all within little more than the asked distance."""
    own = t.calls.filter("address is not null").withColumn("address", F.concat(F.col("request_id").cast("string"), F.lit(" crowded st")))
    at = lambda c, by: (F.col("request_id") * by % 100003 + 1) / F.lit(1e7) + F.lit(c)
    return geo.nearest_pairs(own.withColumns({"latitude": at(44.0, 7919), "longitude": at(-63.0, 104729)}), 1000.0)


def heads_of(t, rows: DataFrame) -> DataFrame:
    """The headers of the three versions, their lists counted from the rows."""
    heads = [history.snapshot_headers(t.dim, i, day, rows.filter(F.col("snapshot_id") == i)) for i, day in enumerate(CUTOFFS, 1)]
    return heads[0].unionByName(heads[1]).unionByName(heads[2])


def snapshots(t) -> tuple[DataFrame, DataFrame]:
    """Headers and doorway rows of three versions, the calls before each cutoff: the version is one more grouping key."""
    at = F.array(*[F.struct(F.lit(i).alias("snapshot_id"), F.lit(day).cast("timestamp_ntz").alias("day")) for i, day in enumerate(CUTOFFS, 1)])
    loaded = typed(t).withColumn("v", F.explode(F.filter(at, lambda v: F.col("local") < v["day"]))).withColumn("snapshot_id", F.col("v.snapshot_id"))
    doors = places.doorways(loaded.drop("v"), by=[KIND, "snapshot_id"])
    rows = settled(doors.select("snapshot_id", F.col(KIND).alias("violation_type"), "address", "rank", "calls_12mo", "calls_total", "tows"), "snapshots")
    return heads_of(t, rows), rows


@query
def snapshot_rows(t):
    doors = doors_of(t, everything(t)).select(*history.KEPT["address"], "community", "last_call", "repeat_calls")
    return history.snapshot_rows(doors, 7, CUTOFFS[2], "all")


@query
def snapshot_blocks(t):
    rows = places.blocks(doors_of(t, typed(t), by=[KIND]), by=[KIND]).select(KIND, *history.KEPT["block"], "worst_doorway")
    return history.snapshot_rows(rows, 7, CUTOFFS[2], None, "block")


@query
def snapshot_headers(t):
    return history.snapshots_of(snapshots(t)[0], "Medium or low").select("snapshot_id", "derived_at", "violation_type", "listed")


@query
def version_headers(t):
    """A version's headers with parameters, version and newest call; one type lists nothing."""
    loaded = typed(t).filter("local < timestamp_ntz'1998-01-01'")
    rows = places.doorways(loaded.filter(F.col(KIND) != "Urgent or high"), by=[KIND]).withColumn("violation_type", F.col(KIND))
    version = history.version_map(t.layer_state, ["view", "click"])
    heads = history.snapshot_headers(t.dim, 7, CUTOFFS[2], rows, {"recur_days": 90}, version, loaded)
    return heads.withColumn("latest_call_date", F.col("latest_call_date").cast("string"))


@query
def departed(t):
    _, rows = snapshots(t)
    one = lambda i: rows.filter((F.col("snapshot_id") == i) & (F.col("violation_type") == "Medium or low"))
    return history.departed(one(1), one(2)).select("address", "rank", "calls_12mo")


@query
def blocks_departed(t):
    loaded = everything(t)
    at = lambda day: places.blocks(doors_of(t, loaded.filter(F.col("local") < F.lit(day).cast("timestamp_ntz")), min_calls=3, recency_days=60), 1)
    return history.departed(at(CUTOFFS[0]), at(CUTOFFS[1]), "block").select("block", "doorways", "calls_12mo")


@query
def presence(t):
    heads, rows = snapshots(t)
    asked = rows.select("violation_type", "address").distinct()
    return history.presence(heads, rows, asked).select("violation_type", "address", "snapshot_id", "present")


@query
def left_when(t):
    heads, rows = snapshots(t)
    asked = everything(t).filter("door is not null").select(F.col("door").alias("address")).distinct()
    asked = asked.crossJoin(F.broadcast(t.dim.filter("status = 'assigned'").select(F.col(KIND).alias("violation_type")).distinct()))  # two types
    return history.left_when(heads, rows, asked.select("violation_type", "address"))


@query
def stored_figures(t):
    """Figures stored per day of calls; asked for every label of the dimension."""
    by = t.calls.join(select.canonical_types(t.fields, t.dim), "request_id")
    store = by.groupBy(KIND, F.date_format("date_initiated", "yyyy-MM").alias("version")).agg(
        F.count("*").cast("string").alias("payload"), F.max("date_initiated").alias("stored_at"), F.lit("{}").alias("parameters")
    )
    store = store.filter(F.col("version") != "1997-03")
    asked = t.dim.filter("status = 'assigned'").select(KIND).distinct()
    asked = asked.withColumn("version", F.explode(F.array(F.lit("1997-02"), F.lit("1997-03")))).withColumn("parameters", F.lit("{}"))
    return history.stored_figures(asked, store).select(KIND, "version", "payload", "available")


@query
def missing_figures(t):
    by = t.calls.join(select.canonical_types(t.fields, t.dim), "request_id").filter(f"{KIND} = 'Urgent or high'")
    store = by.select(KIND, F.lit("v1").alias("version"), F.lit("{}").alias("parameters")).distinct()
    types = t.dim.filter("status = 'assigned'").select(KIND).distinct()
    return history.missing_figures(types, store, "v1", "{}")


@query
def upsert_latest(t):
    again = t.fields.filter("request_id % 3 = 0").withColumn("value", F.upper("value")).withColumn("written", F.lit(2))
    return select.upsert_by_key(t.fields.withColumn("written", F.lit(1)).unionByName(again), "object_id", "written")


def shifted(t) -> DataFrame:
    """The calls as a later version: some gone, most renumbered."""
    return t.calls.filter("request_id % 13 <> 0").withColumn("object_id", F.expr("case when request_id % 3 = 0 then object_id else object_id + 1000000 end"))


@query
def version_sample(t):
    return reconcile.version_sample("service_requests", t.calls, CUTOFFS[0])


@query
def version_identity(t):
    return reconcile.version_identity(t.fields)


@query
def renumbering(t):
    return reconcile.renumbering(*samples(t))


def samples(t) -> tuple[DataFrame, DataFrame]:
    return tuple(reconcile.version_sample("service_requests", x, d, modulus=8) for x, d in ((t.calls, CUTOFFS[0]), (shifted(t), CUTOFFS[1])))


@query
def moved_examples(t):
    return reconcile.moved_examples(*samples(t))


def altered(t) -> DataFrame:
    """The calls as another copy has them: some gone, others with other fields, a date and coordinates among them."""
    change = {
        "community": "case when request_id % 31 = 0 then null else community end", "district": "case when request_id % 29 = 0 then '9' else district end",
        "date_closed": "case when request_id % 37 = 0 then date_closed + interval '1' second else date_closed end",
        "latitude": "case when request_id % 43 = 0 and latitude >= 1 then latitude + 0.5 else latitude end", "longitude": "case when request_id % 47 = 0 then null else longitude end",
        "work_order": "case when request_id % 53 = 0 then 'W' else work_order end", "status": "case when request_id % 59 = 0 then 'X' else status end",
    }
    return t.calls.filter("request_id % 17 <> 0").withColumns({c: F.expr(e) for c, e in change.items()})


@query
def row_diff(t):
    return reconcile.row_diff(t.calls, altered(t), ["request_id"], reconcile.CALL_FIELDS)


def touched(t) -> DataFrame:
    """The calls with few rows changed, one gone and one more."""
    rows = t.calls.filter("request_id <> 77").withColumn("status", F.expr("case when request_id % 4999 = 0 then 'X' else status end"))
    return rows.unionByName(t.calls.filter("request_id = 33").withColumn("request_id", F.lit(-1).cast("long")))


@query
def few_changes(t):
    """Of copies that are near alike, only unequal buckets are joined."""
    return reconcile.bucketed_diff(t.calls, touched(t), ["request_id"], reconcile.CALL_FIELDS)


@query
def copies_agree(t):
    same, other = (reconcile.copies_agree(t.calls, x, ["request_id"], reconcile.CALL_FIELDS) for x in (t.calls.repartition("object_id"), touched(t)))
    return same.withColumn("copy", F.lit("same")).unionByName(other.withColumn("copy", F.lit("touched")))


@query
def merged_runs(t):
    """Runs of snapshots, the last snapshot merged without reading those before."""
    heads, rows = snapshots(t)
    numbered = history.ordinals(heads)
    runs = history.runs_of(numbered, rows.filter("snapshot_id < 3"))
    return history.next_runs(runs, rows.filter("snapshot_id = 3"), 3)


@query
def field_diff(t):
    b = t.fields.filter("request_id % 19 <> 0").withColumn("value", F.expr("case when request_id % 23 = 0 then null else value end"))
    return reconcile.row_diff(t.fields, b, ["request_id", "field_id"], ["name", "value"])


@query
def id_diff(t):
    return reconcile.id_diff(t.calls.filter("request_id % 5 <> 0"), altered(t))


@query
def clean_verdict(t):
    return reconcile.clean_verdict(row_diff.__wrapped__(t), field_diff.__wrapped__(t))


@query
def list_diff(t):
    """Two runs' lists; the clocks that they carry differ on every row and are left out."""
    loaded = everything(t)
    run = lambda calls, at: places.doorways(calls).select("address", "rank", "calls_12mo", "calls_total", "tows", F.lit(at).alias("derived_at"))
    return reconcile.list_diff(run(loaded, "then"), run(loaded.filter("request_id % 41 <> 0"), "now"), "address")


@query
def retained_versions(t):
    """The loads of each layer as versions, those of failed runs without an edit time."""
    versions = t.runs.filter("kind = 'full_load'").select("layer", F.col("run_id").alias("version_id"), F.expr("case when error is null then source_edit end").alias("edited_at"))
    return reconcile.retained_versions(versions)


@query
def source_intervals(t):
    return rounded(freshness.source_intervals(history_of(t)))


def history_of(t) -> DataFrame:
    return t.events.select(F.col("event_type").alias("layer"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("edited_at"))


@query
def source_estimate(t):
    return freshness.source_estimate(freshness.source_intervals(history_of(t)), NOW)


def pulled_of(t) -> DataFrame:
    state = t.layer_state.groupBy("layer").agg(F.max("source_last_edit").alias("source_last_edit"), F.min("full_load_completed_at").alias("full_load_completed_at"))
    return reconcile.last_pulled(t.runs, state)


@query
def advanced(t):
    seen = t.layer_state.groupBy("layer").agg(F.max("source_last_edit").alias("observed"))
    return reconcile.advanced(seen, pulled_of(t))


@query
def reconciled(t):
    return reconcile.reconciled(t.runs, t.layer_state.select("layer").distinct())


@query
def all_reconciled(t):
    return reconcile.all_reconciled(reconciled.__wrapped__(t))


@query
def may_derive(t):
    return reconcile.may_derive(t.runs, ["click", "purchase"])


@query
def count_check(t):
    stored = t.runs.groupBy("layer").agg(F.count("*").alias("stored"))
    source = t.runs.filter("layer = 'click' or error is null").groupBy("layer").agg(F.count("*").alias("published"))
    return reconcile.count_check(stored, source).select("layer", "kind", F.col("detail")["stored"].alias("stored"), F.col("detail")["published"].alias("published"))


@query
def republished(t):
    before = t.runs.filter("layer <> 'click'").groupBy("layer").agg(F.max("source_edit").alias("edited_at"))
    after = t.runs.filter("error is null and run_id % 2 = 0").groupBy("layer").agg(F.min("source_edit").alias("edited_at"))
    return reconcile.republished(before, after)


@query
def readiness(t):
    return freshness.readiness(t.layer_state)


@query
def freshness_rows(t):
    layers = freshness.layer_freshness(t.layer_state, pulled_of(t))
    newest = t.events.groupBy(F.concat(F.lit("store"), (F.col("user_id") % 7).cast("string")).alias("store")).agg(F.min("ts").alias("newest_call"))
    out = freshness.freshness(layers, newest, NOW)
    out = out.withColumn("seconds_overdue", F.col("seconds_overdue").cast("double"))
    return rounded(out.withColumn("newest_call", C.utc_iso(F.col("newest_call"))).drop("loaded", "layers"))


@query
def layer_limits(t):
    return freshness.layer_freshness(t.layer_state, pulled_of(t)).select("store", "layer", "behind", "limit")


@query
def newest_call(t):
    return freshness.newest_call(t.calls)


@query
def current_decisions(t):
    good, _ = triage.validated(t.decisions)
    return triage.of_type(triage.current(good), "Urgent or high").select("scope", "item_key", "decision", "role", "note")


@query
def rejected_decisions(t):
    return triage.validated(t.decisions)[1].groupBy("reason").agg(F.count("*").alias("n"))
