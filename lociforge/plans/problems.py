"""The general problems as queries over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.operators import orphans as orphan_ops
from lociforge.operators import wide_table
from lociforge.session import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    attributes = table(spark, folder, "sheet_attributes")
    wide = wide_table.widen(table(spark, folder, "sheet_cells"), attributes)
    return wide_table.filled_cells(wide, attributes)


def p2_wide(spark: SparkSession, folder: str) -> DataFrame:
    return wide_table.widen(table(spark, folder, "sheet_cells"), table(spark, folder, "sheet_attributes"))


def _dangling(spark: SparkSession, folder: str) -> DataFrame:
    refs = orphan_ops.references(table(spark, folder, "gold"), "gold", "row_no", ["seq_id"], "labelled_at").unionByName(
        orphan_ops.references(table(spark, folder, "distances"), "distances", "row_no", ["i", "j"], "computed_at")
    )
    return orphan_ops.orphans(refs, table(spark, folder, "specimens"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _dangling(spark, folder).select("ref_table", orphan_ops.period_of(F.col("at")).alias("period"), "row_no", "seq_id").distinct()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_ops.orphan_report(_dangling(spark, folder)).drop("n_never_known")


_CLEAN = "upper(replace(trim({0}, ' ' || chr(9)), '-', '_'))"

_P2_CELLS = f"""
named as (
  select {_CLEAN.format('c.seq_id')} as seq_id, a.attr_name, a.attr_type, c.attr_value, c.entered_at, c.cell_no
  from sheet_cells c join (select distinct * from sheet_attributes) a
    on a.spelling = regexp_replace(lower(trim(c.attr_name, ' ' || chr(9))), '[^\\p{{L}}\\p{{N}}]+', '_', 'g')),
ranked as (
  select *, row_number() over (partition by seq_id, attr_name order by entered_at desc nulls last, cell_no desc) as rn,
         trim(attr_value, ' ' || chr(9)) as v
  from named where seq_id <> ''),
typed as (
  select seq_id, attr_name, case
    when attr_type = 'int' and regexp_full_match(v, '[+-]?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)([.]0*)?')
      then cast(try_cast(split_part(replace(v, ',', ''), '.', 1) as bigint) as varchar)
    when attr_type = 'double' and regexp_full_match(v, '[+-]?([0-9]+[.,]?[0-9]*|[.,][0-9]+)([eE][+-]?[0-9]+)?')
      then cast(cast(round(try_cast(replace(v, ',', '.') as double), 2) as decimal(38,2)) as varchar)
    when attr_type = 'date' then strftime(coalesce(
      case when regexp_full_match(v, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}([T ][0-9]{{1,2}}:[0-9]{{2}}.*)?') then try_cast(v[1:10] as date) end,
      case when regexp_full_match(v, '[0-9]{{8}}') then try_cast(v[1:4] || '-' || v[5:6] || '-' || v[7:8] as date) end,
      case when regexp_full_match(v, '[0-9]+[.][0-9]+[.][0-9]{{4}}') then try_cast(try_strptime(v, '%d.%m.%Y') as date) end,
      case when regexp_full_match(v, '[0-9]+/[0-9]+/[0-9]{{4}}') then try_cast(try_strptime(v, '%m/%d/%Y') as date) end,
      case when regexp_full_match(v, '[0-9]+ [A-Za-z]{{3}} [0-9]{{4}}') then try_cast(try_strptime(v, '%d %b %Y') as date) end), '%Y-%m-%d')
    when attr_type = 'flag' then case when lower(v) in ('x','true','t','yes','y','1') then 'true' when lower(v) in ('false','f','no','n','0') then 'false' end
    when attr_type = 'text' then nullif(v, '') end as cell_value
  from ranked where rn = 1)"""

_P4 = f"""
refs as (
  select distinct 'gold' as ref_table, row_no, {_CLEAN.format('seq_id')} as seq_id, labelled_at as t from gold
  union select 'distances', row_no, {_CLEAN.format('i')}, computed_at from distances
  union select 'distances', row_no, {_CLEAN.format('j')}, computed_at from distances),
dangling as (
  select * from refs r where seq_id is not null and seq_id <> '' and not exists (
    select 1 from specimens s where {_CLEAN.format('s.seq_id')} = r.seq_id
      and (r.t is null or (s.received_at <= r.t and (s.removed_at is null or s.removed_at > r.t)))))"""

QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_report": p4_report, "p2_wide": p2_wide}

ORACLE = {
    "p2_found": f"with {_P2_CELLS} select seq_id, attr_name, cell_value from typed where cell_value is not null",
    "p4_found": f"with {_P4} select distinct ref_table, coalesce(strftime(t, '%Y-%m'), 'unknown') as period, row_no, seq_id from dangling",
    "p4_report": f"with {_P4} select ref_table, coalesce(strftime(t, '%Y-%m'), 'unknown') as period, count(*) as n_orphans, count(distinct seq_id) as n_ids from dangling group by 1, 2",
}
