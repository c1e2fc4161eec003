"""The dimension of violation types."""

from pyspark.sql import functions as F

from placewise.operators import select, types


def test_table_is_sound(spark):
    dim = types.type_dimension(spark)
    r = types.dimension_totals(dim).first()
    assert r.sound and (r.entries, r.labels, r.types) == (71, 71, 30)
    assert (r.labelled_rows, r.excluded_rows, r.ambiguous_rows) == (110_834, 7_567, 5)
    assert r.assigned_share == round(r.assigned_rows / (r.labelled_rows - r.excluded_rows), 6)
    assert select.dimension_faults(dim).count() == 0
    assert not types.dimension_totals(dim.unionByName(dim.limit(1))).first().sound
    assert set(types.REASONS) == set(types.EXCLUDED)


def test_lookup_is_exact_and_says_why_there_is_no_type(spark):
    asked = ["DRIVEWAY", "Blocking Driveway (DISPATCH)", "driveway", "Other", "LEFTRUNNING", "OVERTIME", "VIOLATION", None, "", "DRIVEWAY"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, label string")
    got = {r.i: (r.canonical_type, r.label_status) for r in types.type_of(df, types.type_dimension(spark)).collect()}
    driveway = ("Blocking Driveway", "assigned")
    assert got == {0: driveway, 1: driveway, 2: (None, "unknown"), 3: (None, "excluded"), 4: (None, "excluded"), 5: (None, "ambiguous"), 6: (None, "ambiguous"),
                   7: (None, "null"), 8: (None, "unknown"), 9: driveway}
    assert types.type_of(df.limit(0), types.type_dimension(spark)).count() == 0


def test_counts_flatten_the_table(spark):
    rows = types.type_counts(types.type_dimension(spark))
    assert rows.count() == 65
    by = {r.canonical_type: r.n for r in rows.groupBy("canonical_type").agg(F.sum("count").alias("n")).collect()}
    assert by["No Parking Sign"] == 27_669 and by["Meter Feeding"] == 5 and len(by) == 30


def test_coverage_counts_ambiguous_labels(spark):
    labels = ["DRIVEWAY", "Other", "OVERTIME", None, "new label", "DRIVEWAY"]
    fields = spark.createDataFrame([(select.LABEL, v) for v in labels] + [("Vehicle Make", "DRIVEWAY")], "name string, value string")
    r = select.coverage(fields, types.type_dimension(spark)).first()
    assert (r.total, r.n_null, r.n_excluded, r.n_ambiguous, r.n_unknown, r.n_assigned) == (6, 1, 1, 1, 1, 2)
