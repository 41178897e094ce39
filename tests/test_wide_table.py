import datetime as dt

import pytest

from lociforge.operators import wide_table

ATTRIBUTES = [("age", "host_age", "int"), ("host_age", "host_age", "int"), ("ct", "ct", "double"), ("on", "on", "date"), ("travel", "travel", "flag"), ("food", "food", "text"), ("seq_id", "seq_id", "text")]
CELLS = "cell_no long, seq_id string, attr_name string, attr_value string, entered_at timestamp, extra int"


def run(spark, rows, attributes=ATTRIBUTES):
    cells = spark.createDataFrame(rows, CELLS)
    known = spark.createDataFrame(attributes, "spelling string, attr_name string, attr_type string")
    wide = wide_table.widen(cells, known)
    return wide, known


def at(day):
    return dt.datetime(2024, 1, day)


def test_types_and_notations(spark):
    values = {
        ("int", "1,234"): 1234, ("int", "+7"): 7, ("int", "53.0"): 53, ("int", "12,34"): None, ("int", "5.5"): None, ("int", "n/a"): None, ("int", ""): None, ("int", "99999999999999999999"): None,
        ("double", "21,72"): 21.72, ("double", "1714e-2"): 17.14, ("double", " 3.500\t"): 3.5, ("double", "NaN"): None, ("double", "1e999"): None,
        ("date", "2023-03-24"): dt.date(2023, 3, 24), ("date", "20210314"): dt.date(2021, 3, 14), ("date", "14.03.2021"): dt.date(2021, 3, 14), ("date", "3/9/2021"): dt.date(2021, 3, 9),
        ("date", " 2023-09-11T05:33:00 "): dt.date(2023, 9, 11), ("date", "7 Apr 2023"): dt.date(2023, 4, 7), ("date", "31.04.2023"): None, ("date", "00.00.0000"): None, ("date", "7 Foo 2023"): None,
        ("flag", "X"): True, ("flag", "no "): False, ("flag", "0"): False, ("flag", "maybe"): None, ("text", "\tmango  cubes "): "mango  cubes", ("text", " "): None,
    }
    for kind in ("int", "double", "date", "flag", "text"):
        own = [(v, want) for (k, v), want in values.items() if k == kind]
        rows = [(i, f"s{i}", "a", v, at(1), 0) for i, (v, _) in enumerate(own)]
        wide, _ = run(spark, rows, [("a", "a", kind)])
        got = {r["seq_id"]: r["a"] for r in wide.collect()}
        assert got == {f"S{i}": want for i, (_, want) in enumerate(own)}, kind


def test_last_row_counts_and_names_match(spark):
    rows = [
        (1, " a-1 ", "Age", "5", at(2), 0), (2, "A_1", "host age ", "6", at(2), 0), (3, "A_1", "AGE", "7", at(1), 0), (4, "A_1", "age", "8", None, 0),
        (5, "A_1", "unknown", "9", at(3), 0), (6, None, "age", "9", at(3), 0), (7, "B", None, "9", at(3), 0), (8, "C", "ct", "3", at(1), 0), (9, "C", "ct", None, at(2), 0), (10, "D", "seq id", "own", at(2), 0),
    ]
    wide, known = run(spark, rows + rows)
    got = {r["seq_id"]: r.asDict() for r in wide.collect()}
    assert set(got) == {"A_1", "C", "D"}
    assert got["A_1"]["host_age"] == 6 and got["C"]["ct"] is None and got["D"]["attr_seq_id"] == "own"
    assert {tuple(r) for r in wide_table.filled_cells(wide, known).collect()} == {("A_1", "host_age", "6"), ("D", "seq_id", "own")}


def test_entities_go_on_over_batches(spark):
    rows = [(i, f"s{i // 3:04d}", ["age", "ct", "food"][i % 3], str(i), at(1), 0) for i in range(900)]
    cells = spark.createDataFrame(rows, CELLS)
    known = spark.createDataFrame(ATTRIBUTES, "spelling string, attr_name string, attr_type string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = wide_table.widen(cells, known, batch_entities=2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 300 and len({r["seq_id"] for r in got}) == 300
    for r in got:
        n = 3 * int(r["seq_id"][1:])
        assert (r["host_age"], r["ct"], r["food"]) == (n, n + 1.0, str(n + 2))


def test_empty_tables(spark):
    wide, known = run(spark, [])
    assert wide.count() == 0 and wide.columns == ["seq_id", "ct", "food", "host_age", "on", "attr_seq_id", "travel"]
    wide, known = run(spark, [(1, "a", "age", "1", at(1), 0)], [])
    assert wide.count() == 0 and wide_table.filled_cells(wide, known).count() == 0


def test_long_text_and_bad_types(spark):
    wide, _ = run(spark, [(1, "a", "food", "x" * 1_000_000, at(1), 0)])
    assert len(wide.first()["food"]) == 1_000_000
    with pytest.raises(ValueError):
        run(spark, [], [("a", "a", "blob")])
