"""Attribute-value rows into one typed row per entity.

Names are matched and values parsed by column expressions. The last row of each cell is picked by a partial
aggregate, so an entity with a third of all rows reaches the shuffle with at most one row per attribute and task.
The surviving cells are sorted by entity and streamed through Arrow batches: attributes are column indices, and each
column fills one typed buffer with a validity mask. No task holds more than one output batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociforge.functions.identifiers import attribute_key, clean_id

#: Spark and Arrow type of each attribute type.
TYPES = {
    "int": (T.LongType(), pa.int64(), "v_int", np.int64),
    "double": (T.DoubleType(), pa.float64(), "v_double", np.float64),
    "date": (T.DateType(), pa.date32(), "v_date", np.int32),
    "flag": (T.BooleanType(), pa.bool_(), "v_flag", np.bool_),
    "text": (T.StringType(), pa.string(), "v_text", object),
}
MAX_ATTRIBUTES = 10_000
BATCH_ENTITIES = 4096


def _blank_trim(col: Column) -> Column:
    return F.btrim(col, F.lit(" \t\r\n"))


def parse_int(col: Column) -> Column:
    """Whole numbers with an optional sign, thousands commas and an all-zero fraction; else null."""
    text = _blank_trim(col)
    plain = F.when(text.rlike(r"^[+-]?(\d+|\d{1,3}(,\d{3})+)(\.0*)?$"), F.regexp_replace(F.regexp_replace(text, ",", ""), r"\..*$", ""))
    return plain.try_cast("bigint")


def parse_double(col: Column) -> Column:
    """Decimal numbers with point or comma and an optional exponent; else null. NaN and infinities are unreadable."""
    text = F.translate(_blank_trim(col), ",", ".")
    value = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?$"), text).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def parse_date(col: Column) -> Column:
    """``yyyy-MM-dd`` (also before ``T`` or a blank and a time), ``yyyyMMdd``, ``dd.MM.yyyy``, ``MM/dd/yyyy``, ``d Mon yyyy``.

    Days that the calendar lacks are unreadable.
    """
    text = _blank_trim(col)

    def pieces(pattern: str, y: int, m: int, d: int) -> Column:
        got = [F.regexp_extract(text, pattern, k) for k in (y, m, d)]
        return F.when(text.rlike(pattern), F.concat_ws("-", F.lpad(got[0], 4, "0"), F.lpad(got[1], 2, "0"), F.lpad(got[2], 2, "0")))

    named = r"^(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4})$"
    position = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.regexp_extract(text, named, 2)))
    by_name = F.when(
        text.rlike(named) & (position % 3 == 1),
        F.concat_ws("-", F.regexp_extract(text, named, 3), F.lpad(((position + 2) / 3).cast("int").cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, named, 1), 2, "0")),
    )
    iso = F.coalesce(
        pieces(r"^(\d{4})-(\d{1,2})-(\d{1,2})([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?Z?)?$", 1, 2, 3),
        pieces(r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3),
        pieces(r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", 3, 2, 1),
        pieces(r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 1, 2),
        by_name,
    )
    return F.when(~iso.startswith("0000"), iso).try_cast("date")


def parse_flag(col: Column) -> Column:
    text = F.lower(_blank_trim(col))
    return F.when(text.isin("x", "true", "t", "yes", "y", "1"), F.lit(True)).when(text.isin("false", "f", "no", "n", "0"), F.lit(False))


def last_cells(cells: DataFrame, attributes: DataFrame) -> DataFrame:
    """``(seq_id, attr_name, attr_type, col_idx, value)``: the row that counts for each cell, as typed by hand.

    ``col_idx`` is the attribute's place in alphabetical order. Rows without an entity or of an unknown attribute are
    left out. A cell's last row is that with the greatest ``entered_at`` (null first), then the greatest ``cell_no``.
    """
    names = attributes.select(
        F.col("spelling").alias("_key"), F.col("attr_name").alias("_name"), F.col("attr_type").alias("_type")
    ).distinct()
    order = F.struct(F.col("entered_at").isNotNull(), F.coalesce(F.col("entered_at").cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")), F.col("cell_no"))
    own = cells.select(
        clean_id("seq_id").alias("seq_id"), attribute_key("attr_name").alias("_key"), F.col("attr_value").alias("_value"), order.alias("_order")
    ).filter("seq_id is not null and seq_id <> ''")
    joined = own.join(F.broadcast(names), "_key")
    return joined.groupBy("seq_id", F.col("_name").alias("attr_name"), F.col("_type").alias("attr_type")).agg(
        F.max_by(F.struct(F.col("_value").alias("v")), "_order").getField("v").alias("value")
    )


def attribute_kinds(attributes: DataFrame) -> dict[str, str]:
    """The type of each attribute, in the order of their columns."""
    known = [tuple(r) for r in attributes.select("attr_name", "attr_type").filter("attr_name is not null").distinct().orderBy("attr_name", "attr_type").limit(MAX_ATTRIBUTES + 1).collect()]
    if len(known) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    kinds = {}
    for name, kind in known:
        if kind not in TYPES:
            raise ValueError(f"attribute {name}: unknown type {kind}")
        if name in kinds:
            raise ValueError(f"attribute {name} has two types")
        kinds[name] = kind
    return kinds


def widen(cells: DataFrame, attributes: DataFrame, batch_entities: int = BATCH_ENTITIES) -> DataFrame:
    """One row per ``seq_id`` that has a known attribute, one typed column per attribute of ``attributes``.

    ``cells``: ``(cell_no, seq_id, attr_name, attr_value, entered_at)``; further columns are ignored. ``attributes``:
    ``(spelling, attr_name, attr_type)``, at most ``MAX_ATTRIBUTES`` rows (a dimension; checked, as it is broadcast and
    gives the result's schema). Blank or unreadable last values leave the cell null; an entity whose cells are all
    empty keeps its row of nulls. Empty tables give an empty result with the full schema. An attribute named
    ``seq_id`` becomes ``attr_seq_id``; attributes equal but for case are told apart by a number.
    """
    kinds = attribute_kinds(attributes)
    names, taken, columns = list(kinds), {"seq_id"}, []
    for name in names:
        column, k = (f"attr_{name}" if name.lower() == "seq_id" else name), 1
        while column.lower() in taken:
            k += 1
            column = f"{name}_{k}"
        taken.add(column.lower())
        columns.append(column)
    schema = T.StructType([T.StructField("seq_id", T.StringType())] + [T.StructField(c, TYPES[kinds[n]][0]) for n, c in zip(names, columns)])
    index = attributes.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "attr_name string, col_idx int")
    value, kind = F.col("value"), F.col("attr_type")
    text = F.btrim(value, F.lit(" \t"))
    typed = last_cells(cells, attributes).join(F.broadcast(index), "attr_name").select(
        "seq_id",
        "col_idx",
        F.when(kind == "int", parse_int(value)).alias("v_int"),
        F.when(kind == "double", parse_double(value)).alias("v_double"),
        F.when(kind == "date", parse_date(value)).alias("v_date"),
        F.when(kind == "flag", parse_flag(value)).alias("v_flag"),
        F.when((kind == "text") & (text != ""), text).alias("v_text"),
    )
    sorted_cells = typed.repartition("seq_id").sortWithinPartitions("seq_id", "col_idx")
    plan = [TYPES[kinds[n]] for n in names]
    out_names = ["seq_id", *columns]

    def build(ids: list[str], rows: list[np.ndarray], cols: list[np.ndarray], values: dict[str, list[pa.Array]]) -> pa.RecordBatch:
        """One batch of entities: scatter the cells of each column into its buffer and mask."""
        row, col = np.concatenate(rows), np.concatenate(cols)
        by_col = np.argsort(col, kind="stable")
        ends = np.searchsorted(col[by_col], np.arange(len(plan) + 1))
        whole = {k: pa.concat_arrays(v) for k, v in values.items()}
        arrays: list[pa.Array] = [pa.array(ids, pa.string())]
        for c, (_, arrow, source, kind) in enumerate(plan):
            at = by_col[ends[c] : ends[c + 1]]
            cell = whole[source].take(pa.array(at))
            filled = ~np.asarray(cell.is_null())
            missing = np.ones(len(ids), bool)
            missing[row[at[filled]]] = False
            buffer = np.full(len(ids), None, object) if kind is object else np.zeros(len(ids), kind)
            got = cell.filter(pa.array(filled))
            buffer[row[at[filled]]] = got.cast(pa.int32()).to_numpy() if source == "v_date" else got.to_numpy(zero_copy_only=False)
            if source == "v_date":
                arrays.append(pa.array(buffer, pa.int32(), mask=missing).cast(arrow))
            else:
                arrays.append(pa.array(buffer, arrow, mask=missing))
        return pa.RecordBatch.from_arrays(arrays, names=out_names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[str] = []
        rows: list[np.ndarray] = []
        cols: list[np.ndarray] = []
        values: dict[str, list[pa.Array]] = {k[2]: [] for k in TYPES.values()}

        def add(part: pa.RecordBatch) -> None:
            key = part.column("seq_id").to_pylist()
            row = np.empty(len(key), np.int64)
            for i, s in enumerate(key):
                if not ids or ids[-1] != s:
                    ids.append(s)
                row[i] = len(ids) - 1
            rows.append(row)
            cols.append(part.column("col_idx").to_numpy(zero_copy_only=False))
            for k in values:
                values[k].append(part.column(k))

        for batch in batches:
            while batch.num_rows:
                add(batch)
                batch = batch.slice(batch.num_rows)
            if len(ids) > batch_entities:  # the last entity may go on in the next batch
                row = np.concatenate(rows)
                keep = int(np.searchsorted(row, len(ids) - 1))
                col, whole = np.concatenate(cols), {k: pa.concat_arrays(v) for k, v in values.items()}
                yield build(ids[:-1], [row[:keep]], [col[:keep]], {k: [v.slice(0, keep)] for k, v in whole.items()})
                ids[:] = ids[-1:]
                rows[:], cols[:] = [np.zeros(len(row) - keep, np.int64)], [col[keep:]]
                for k in values:
                    values[k] = [whole[k].slice(keep)]
        if ids:
            yield build(ids, rows, cols, values)

    return sorted_cells.mapInArrow(stream, schema)


def filled_cells(wide: DataFrame, attributes: DataFrame) -> DataFrame:
    """``(seq_id, attr_name, cell_value)`` of each filled cell: plain digits, two decimals, ISO dates, true/false, text.

    ``wide`` is ``widen``'s result for these ``attributes``; a column that had to be renamed comes out by its attribute's name.
    """
    parts = []
    for name, field in zip(attribute_kinds(attributes), wide.schema.fields[1:]):
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            shown = F.round(col.cast("decimal(38,12)"), 2).cast("decimal(38,2)").cast("string")
        elif isinstance(field.dataType, T.DateType):
            shown = F.date_format(col, "yyyy-MM-dd")
        else:
            shown = col.cast("string")
        parts.append(F.struct(F.lit(name).alias("attr_name"), shown.alias("cell_value")))
    if not parts:
        return wide.select("seq_id", F.lit("").alias("attr_name"), F.lit("").alias("cell_value")).limit(0)
    return wide.select("seq_id", F.explode(F.array(*parts)).alias("c")).select("seq_id", "c.attr_name", "c.cell_value").filter("cell_value is not null")
