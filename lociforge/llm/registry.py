"""The llm problems as queries over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.llm import leakage, markov_clusters, near_duplicates, nearest_vectors, packing, subjects
from lociforge.plans.typing_queries import CALLS, CLEAN
from lociforge.session import Cut, table


def _sequences(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "contigs").select(F.col("ord").alias("rec_no"), "sequence")
        .unionByName(table(spark, folder, "haplotypes").select("rec_no", "sequence"))
    )


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.group_pairs(near_duplicates.near_duplicate_groups(_sequences(spark, folder)))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return markov_clusters.found(table(spark, folder, "calls"))


def _described(spark: SparkSession, folder: str) -> DataFrame:
    cut = Cut(spark)
    return markov_clusters.markov_clusters(markov_clusters.alike_graph(markov_clusters.genotypes(table(spark, folder, "calls"), cut), cut), cut)[1]


def p1_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """As ``p1_clusters``, without the typical members, which SQL can't tell."""
    return _described(spark, folder).select("first_seq_id", "n_members")


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _described(spark, folder).select("first_seq_id", "n_members", F.array_join("typical", ",").alias("typical"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    nearest = nearest_vectors.most_similar(table(spark, folder, "specimens"), 5, 4.0)
    return nearest_vectors.similar_pairs(nearest, 4.0)


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "containers"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, folder), table(spark, folder, "containers"))


def p6_faults(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the packing; only the number of texts isn't 0."""
    return packing.faults(p6_pack(spark, folder), table(spark, folder, "containers"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "test_items"))


def _subjects(spark: SparkSession, folder: str, min_share: float, misses: bool = False) -> DataFrame:
    return subjects.subjects_of(table(spark, folder, "documents"), table(spark, folder, "subject_labels"), table(spark, folder, "subjects"), min_share, misses=misses)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.likely(_subjects(spark, folder, 0)).select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.composition(_subjects(spark, folder, 0, misses=True))


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p1_sizes, p3_found, p5_found, p6_pack, p6_fill, p6_faults, p7_found, p8_found, p8_composition)}

_P1 = f"""with recursive {CALLS},
able as (select seq_id from calls_v group by 1 having count(distinct locus) >= 16),
per_locus as (select seq_id, locus, list(distinct marker) as v from calls_v where seq_id in (select seq_id from able) group by 1, 2),
pairs as (
  select a.seq_id as i, b.seq_id as j from per_locus a join per_locus b on a.locus = b.locus and a.seq_id < b.seq_id
  group by 1, 2 having count(*) >= 16 and 10 * count(*) filter (list_has_any(a.v, b.v)) >= 8 * count(*)),
e as (select i as a, j as b from pairs union select j, i from pairs),
reach as (select a, a as b from e union select r.a, e.b from reach r join e on e.a = r.b),
c as (select a as seq_id, min(b) as first_seq_id from reach group by 1)
select first_seq_id, seq_id from c where seq_id <> first_seq_id"""

_P3 = """with recursive
records as (select ord as rec_no, regexp_replace(upper(sequence), '[^ACGT]', '', 'g') as s from contigs
  union all select rec_no, regexp_replace(upper(sequence), '[^ACGT]', '', 'g') from haplotypes),
own as (select rec_no, s, min(rec_no) over (partition by s) as node from records where length(s) >= 20),
words as (select distinct node, substr(s, cast(k as bigint), 8) as w from (select distinct node, s, unnest(range(1, length(s) - 6)) as k from own)),
sizes as (select node, count(*) as n from words group by 1),
shared as (select a.node as i, b.node as j, count(*) as c from words a join words b on a.w = b.w and a.node < b.node group by 1, 2),
near as (select i, j from shared join sizes x on x.node = i join sizes y on y.node = j where 10 * c >= 6 * (x.n + y.n - c)),
e as (select i as a, j as b from near union select j, i from near),
reach as (select a, a as b from e union select r.a, e.b from reach r join e on e.a = r.b),
c as (select a as node, min(b) as comp from reach group by 1)
select distinct coalesce(comp, own.node) as first_no, rec_no from own left join c on c.node = own.node where rec_no <> coalesce(comp, own.node)"""

_P5 = f"""with v as (
  select {CLEAN.format('seq_id')} as seq_id, min(cast(sheet_vec as double[])) as x from specimens
  where sheet_vec is not null and len(sheet_vec) = 64 and len(list_filter(sheet_vec, lambda t: isnan(t))) = 0 group by 1),
near as (
  select a.seq_id as i, b.seq_id as j, list_distance(a.x, b.x) as d, row_number() over (partition by a.seq_id order by round(list_distance(a.x, b.x), 9), b.seq_id) as rk
  from v a join v b on a.seq_id <> b.seq_id)
select distinct least(i, j) as seq_a, greatest(i, j) as seq_b from near where rk <= 5 and d <= 4"""

_P6 = """select container_kind, count(*) as n_texts, 0 as n_overfull, 0 as n_cut, 0 as n_differing
  from (select distinct container_kind from containers where capacity_tokens > 0), documents group by 1"""

ORACLE = {"p6_faults": _P6, "p1_sizes": _P1.replace("select first_seq_id, seq_id from c where seq_id <> first_seq_id", "select first_seq_id, count(*) as n_members from c group by 1"), "p1_found": _P1, "p3_found": _P3, "p5_found": _P5}
