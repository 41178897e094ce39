"""The typing operators as queries over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.functions import names, sequences
from lociforge.functions.identifiers import clean_id
from lociforge.operators import distance, genotype_tree, hierarchy, metrics, sheet, typing
from lociforge.session import Cut, table

CLEAN = "upper(replace(trim({0}, ' ' || chr(9)), '-', '_'))"

CALLS = f"""
calls_v as (
  select distinct {CLEAN.format('seq_id')} as seq_id, {CLEAN.format('marker')} as marker,
         coalesce(nullif({CLEAN.format('locus')}, ''), regexp_replace({CLEAN.format('marker')}, '_(HAP|NOVEL)_.*$', '')) as locus
  from calls where {CLEAN.format('seq_id')} <> '' and {CLEAN.format('marker')} <> '')"""

KEPT = CALLS + """,
n_loci as (select count(distinct locus) as total from calls_v),
complete as (select seq_id from calls_v, n_loci group by seq_id, total having count(distinct locus) >= 0.10 * total),
kept as (select * from calls_v where seq_id in (select seq_id from complete)),
markers_v as (select distinct locus, marker, case when locus like 'MT%' then 1 else 2 end as ploidy from calls_v)"""

WEIGHTS = KEPT + """,
carriers as (select locus, marker, count(distinct seq_id) as carriers from kept group by 1, 2),
called as (select locus, count(distinct seq_id) as called from kept group by 1),
freq as (
  select m.locus, m.marker, m.ploidy, coalesce(c.carriers, 0) as carriers, coalesce(d.called, 0) as called,
         least(greatest(case when d.called is null then 1e-4 else cast(coalesce(c.carriers, 0) as double) / d.called end, 1e-4), 1 - 1e-4) as p
  from markers_v m left join carriers c using (locus, marker) left join called d using (locus)),
weights as (select *, 1 / sqrt(p * (1 - p)) as w from freq)"""

PAIRS = """
per_locus as (select locus, seq_id, list_sort(list(distinct marker)) as v from kept group by 1, 2),
locus_pairs as (
  select a.seq_id as i, b.seq_id as j, a.locus, a.v as v1, b.v as v2
  from per_locus a join per_locus b on a.locus = b.locus and a.seq_id < b.seq_id)"""

SHARES = """
shares as (select locus, marker, count(*) / sum(count(*)) over (partition by locus) as share from kept group by 1, 2)"""

BARRATT = KEPT + "," + PAIRS + "," + SHARES + """,
entropies as (select locus, -sum(share * log2(share)) as h from shares group by 1),
scored as (
  select i, j, locus, len(list_distinct(list_concat(v1, v2))) as x, len(list_intersect(v1, v2)) as y, least(len(v1), len(v2)) as n,
         case when locus like 'MT%' then 1 else 2 end as q from locus_pairs),
deltas as (
  select i, j, locus,
    case when y = 0 then case when n > 1 then x when q > 1 then case when x = 2 then 4 when x > 2 then 1 + x else 0 end when x > 1 then 1 + x else 0 end
         else 4 - (case when y = 1 and n = 1 and x > (case when q > 1 then 2 else 1 end) then 3 else 0 end) - (case when y > 0 and n > 1 then 2 else 0 end) end as delta
  from scored),
barratt as (select i, j, avg(h * delta) as d from deltas join entropies using (locus) group by 1, 2)"""

PLUCINSKI = """
floored as (select locus, marker, greatest(share, 1e-4) as p from shares),
lik as (select locus, seq_id, sum(ln(p)) as lp, min(p) as pm from kept join floored using (locus, marker) group by 1, 2),
both_have as (
  select a.seq_id as i, b.seq_id as j, a.locus, list_sort(list(f.p)) as s
  from kept a join kept b on a.locus = b.locus and a.marker = b.marker and a.seq_id < b.seq_id join floored f on f.locus = a.locus and f.marker = a.marker
  group by 1, 2, 3),
terms as (
  select l.i, l.j, case when l.locus like 'MT%' then 1 else 2 end as q, len(v1) as n1, len(v2) as n2, a.lp + b.lp as l0, coalesce(s, []) as s, ln(0.3072 * least(a.pm, b.pm)) as no
  from locus_pairs l join lik a on a.locus = l.locus and a.seq_id = l.i join lik b on b.locus = l.locus and b.seq_id = l.j
  left join both_have h on h.i = l.i and h.j = l.j and h.locus = l.locus),
l1s as (select *, case when len(s) >= 1 then l0 - ln(s[1]) else no end as l1 from terms),
l2s as (select *, case when q = 1 or n1 = 1 or n2 = 1 then l1 when len(s) >= 2 then l0 - ln(s[1]) - ln(s[2]) else no end as l2 from l1s),
sums as (select i, j, sum(l0) as a, sum(l1) as b, sum(l2) as c from l2s group by 1, 2),
plucinski as (
  select i, j, (exp(b - greatest(a, b, c)) + 2 * exp(a - greatest(a, b, c))) / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))) as d from sums)"""

WIBS = WEIGHTS + """,
wl as (select locus, sum(w) as wl from weights group by 1),
held as (select seq_id, locus, sum(w / ploidy) as a from kept join weights using (locus, marker) group by 1, 2),
common as (
  select x.seq_id as i, y.seq_id as j, sum(x.a + y.a) as num, sum(wl) as den
  from held x join held y on x.locus = y.locus and x.seq_id < y.seq_id join wl on wl.locus = x.locus group by 1, 2),
same as (
  select x.seq_id as i, y.seq_id as j, sum(w / ploidy) as s
  from kept x join kept y on x.locus = y.locus and x.marker = y.marker and x.seq_id < y.seq_id join weights g on g.locus = x.locus and g.marker = x.marker group by 1, 2),
wibs as (
  select a.seq_id as i, b.seq_id as j, case when den > 0 then greatest(num - 2 * coalesce(s, 0), 0) / den else 1.0 end as d
  from complete a join complete b on a.seq_id < b.seq_id
  left join common c on c.i = a.seq_id and c.j = b.seq_id left join same e on e.i = a.seq_id and e.j = b.seq_id)"""

DIST = f"""
dist as (
  select i, j, arg_max(d, rk) as d from (
    select least({CLEAN.format('i')}, {CLEAN.format('j')}) as i, greatest({CLEAN.format('i')}, {CLEAN.format('j')}) as j, d,
           row_number() over (order by computed_at nulls first, row_no) as rk
    from distances where d is not null and not isnan(d)) where i <> j and i <> '' group by 1, 2)"""

GOLD = f"""
gold_v as (
  select seq_id, arg_max(cluster_alias, rk) as cluster_alias from (
    select {CLEAN.format('seq_id')} as seq_id, {CLEAN.format('cluster_alias')} as cluster_alias, row_number() over (order by labelled_at nulls first, row_no) as rk from gold)
  where seq_id <> '' and cluster_alias <> '' group by 1)"""

CLUSTERS = f"""
clusters_v as (
  select seq_id, arg_max(assigned_cluster, rk) as assigned_cluster from (
    select {CLEAN.format('seq_id')} as seq_id, assigned_cluster, row_number() over (order by clustered_at, -assigned_cluster) as rk from clusters where assigned_cluster is not null)
  where seq_id <> '' group by 1)"""

GOLD_PAIRS = DIST + "," + GOLD + """,
gp as (select d, a.cluster_alias as li, b.cluster_alias as lj from dist join gold_v a on a.seq_id = i join gold_v b on b.seq_id = j)"""

CONTIGS = f"""
contigs_v as (
  select {CLEAN.format('seq_id')} as seq_id, {CLEAN.format('locus_hint')} as locus_hint, regexp_replace(upper(sequence), '[^ACGT]', '', 'g') as sequence, ord
  from contigs where length(regexp_replace(upper(sequence), '[^ACGT]', '', 'g')) >= 20)"""

HAPS = """
haps_v as (select rec_no, marker, regexp_replace(upper(sequence), '[^ACGT]', '', 'g') as sequence from haplotypes)"""

_PARSED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '_Hap_[0-9]+', '', 'g'), '[.]H[0-9]+(_[A-F0-9]+)?', '', 'g'), '_H[0-9]+(_[A-F0-9]+)?', '', 'g'), '_(NOVEL|novel)_[0-9]+', '', 'g'), '[.]X_[0-9]+', '', 'g')"


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    return sheet.calls_view(table(spark, folder, "calls"))


def _contigs(spark: SparkSession, folder: str) -> DataFrame:
    return typing.contig_view(table(spark, folder, "contigs"))


def _haps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "haplotypes").select("rec_no", "marker", sequences.plain_sequence(F.col("sequence")).alias("sequence"))


def _dist(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.distance_view(table(spark, folder, "distances"))


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.gold_view(table(spark, folder, "gold"))


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.cluster_view(table(spark, folder, "clusters"))


def _rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


def locus_parse(spark, folder):
    return table(spark, folder, "calls").select("marker").distinct().select("marker", names.parse_locus(F.col("marker")).alias("locus"))


def norm_name(spark, folder):
    return table(spark, folder, "calls").select("marker").distinct().select("marker", names.norm_name(F.col("marker")).alias("norm"))


def content_hash(spark, folder):
    s = F.col("sequence")
    return table(spark, folder, "contigs").filter("sequence is not null").select("ord", names.content_hash(s, 4).alias("hash4"), names.content_hash(s, 6).alias("hash6"))


def haplotype_id(spark, folder):
    own = table(spark, folder, "haplotypes").filter("sequence is not null")
    return own.select("rec_no", names.haplotype_id(names.parse_locus(F.col("marker")), F.col("sequence"), F.col("rank")).alias("hap_id"))


def locus_hint(spark, folder):
    return table(spark, folder, "contigs").filter("locus_hint is not null").select("ord", names.clean_locus_hint(F.col("locus_hint")).alias("locus"))


def presence_cells(spark, folder):
    return _calls(spark, folder).select("seq_id", "marker", F.lit("X").alias("cell"))


def completeness(spark, folder):
    specimens = table(spark, folder, "specimens").select(clean_id("seq_id").alias("seq_id"))
    calls = _calls(spark, folder)
    return _rounded(sheet.completeness(calls, specimens.union(calls.select("seq_id"))), "completeness")


def complete_specimens(spark, folder):
    return sheet.complete_calls(_calls(spark, folder), 0.5).groupBy("seq_id").agg(F.count("*").alias("n_markers"))


def marker_dimension(spark, folder):
    return sheet.marker_dimension(_calls(spark, folder))


def locus_called(spark, folder):
    return _calls(spark, folder).select("seq_id", "locus").distinct().groupBy("locus").agg(F.count("*").alias("called"))


def allele_frequency(spark, folder):
    calls = _calls(spark, folder)
    return _rounded(sheet.allele_frequencies(sheet.complete_calls(calls), sheet.marker_dimension(calls)), "p", "w")


def allele_share(spark, folder):
    return _rounded(sheet.allele_shares(_calls(spark, folder)), "share")


def locus_entropy(spark, folder):
    return _rounded(sheet.entropies(_calls(spark, folder)), "entropy")


def snp_weight(spark, folder):
    calls = _calls(spark, folder)
    return _rounded(sheet.snp_locus_weights(sheet.complete_calls(calls), sheet.marker_dimension(calls)), "w")


def wibs_pairs(spark, folder):
    return _rounded(distance.wibs_pairs(_calls(spark, folder)), "d")


def _snp(spark, folder, every):
    seqs = _haps(spark, folder).select(clean_id("marker").alias("marker"), "sequence").filter("sequence <> ''").groupBy("marker").agg(F.max_by("sequence", F.length("sequence")).alias("sequence"))
    return _rounded(distance.snp_pairs(_calls(spark, folder), seqs, every=every), "d")


def snp_wibs_pairs(spark, folder):
    return _snp(spark, folder, False)


def barratt_pairs(spark, folder):
    return _rounded(distance.barratt_pairs(_calls(spark, folder)), "d")


def plucinski_pairs(spark, folder):
    return _rounded(distance.plucinski_pairs(_calls(spark, folder)), "d")


def rank_ensemble(spark, folder):
    return _rounded(distance.rank_ensemble_of(_calls(spark, folder)), "d")  # of 6 places: the engines' sums differ in the last bits; ties must not


def barratt_matrix(spark, folder):
    """As ``barratt_pairs``, with the pairs without a common locus at the greatest distance."""
    return _rounded(distance.barratt_matrix(_calls(spark, folder)), "d")


def plucinski_matrix(spark, folder):
    """As ``plucinski_pairs``, with the pairs without a common locus at 2."""
    return _rounded(distance.plucinski_pairs(_calls(spark, folder), every=True), "d")


def snp_wibs_matrix(spark, folder):
    """As ``snp_wibs_pairs``, with the pairs without a common locus at 1."""
    return _snp(spark, folder, True)


def rank_ensemble_matrix(spark, folder):
    """As ``rank_ensemble``, over all pairs."""
    return _rounded(distance.rank_ensemble_of(_calls(spark, folder), every=True), "d")


def double_centring(spark, folder):
    g = _rounded(distance.double_centred_of(spark, distance.wibs_genotypes(_calls(spark, folder)), distance.wibs_distances), "g")
    return g.withColumn("g", F.when(F.col("g") == 0, F.lit(0.0)).otherwise(F.col("g")))  # no negative zero


def haplotype_rank(spark, folder):
    own = _contigs(spark, folder).filter("locus_hint <> ''").withColumnRenamed("locus_hint", "locus")
    return typing.haplotype_ranks(own)


def denovo_calls(spark, folder):
    return typing.denovo_calls(_contigs(spark, folder).filter("locus_hint <> ''").withColumnRenamed("locus_hint", "locus"))


def _placed(spark, folder, cut):
    return typing.assigned_loci(cut.write(_contigs(spark, folder).withColumnRenamed("locus_hint", "locus")), cut)


def haplotype_rank_all(spark, folder):
    """As ``haplotype_rank``, with the contigs that have no locus hint."""
    return typing.haplotype_ranks(_placed(spark, folder, Cut(spark)))


def denovo_calls_all(spark, folder):
    """As ``denovo_calls``, with the contigs that have no locus hint."""
    cut = Cut(spark)
    return typing.denovo_calls(cut.write(_placed(spark, folder, cut)))  # read twice


def contig_match(spark, folder):
    return _rounded(typing.match_contigs(_contigs(spark, folder), _haps(spark, folder).withColumnRenamed("rec_no", "ref_ord")), "identity_pct", "coverage_pct")


def hinted_identity(spark, folder):
    """Each distinct contig against every haplotype of its hinted locus."""
    contigs = _contigs(spark, folder).select("locus_hint", "sequence").distinct()
    refs = _haps(spark, folder).filter("sequence <> ''").select(F.upper(names.parse_locus(F.col("marker"))).alias("locus_hint"), "rec_no", F.col("sequence").alias("ref"))
    a, b = F.col("sequence"), F.col("ref")
    return contigs.join(refs, "locus_hint").select(
        "locus_hint", "sequence", "rec_no", F.round(sequences.hamming(a, b), 6).alias("distance"), F.round(sequences.prefix_identity(a, b), 6).alias("approx"),
        F.round(sequences.coverage(a, b), 6).alias("coverage"), F.round(sequences.identity(a, b), 6).alias("identity"), sequences.contains_either(a, b).alias("contained"),
    )


def _reads(spark, folder):
    return _contigs(spark, folder).select(F.col("seq_id").alias("sample_id"), F.col("ord").alias("rec_no"), "sequence", "locus_hint")


def read_filter(spark, folder):
    reads = _reads(spark, folder).withColumn("qual", F.translate("sequence", "ACGT", "+5?I"))
    return typing.filter_reads(reads, 300, 1500, 20.0).select("rec_no", F.round(sequences.mean_phred(F.col("qual")), 6).alias("quality"))


def read_support(spark, folder):
    return typing.read_support(_reads(spark, folder), _haps(spark, folder), 2)


def junction_trim(spark, folder):
    s = F.col("sequence")
    return _reads(spark, folder).select("rec_no", sequences.is_junction_read(s).alias("junction"), sequences.trim_junction(s).alias("trimmed"))


def junctions(spark, folder):
    """The junction of each specimen whose contigs hold one."""
    return typing.junctions(_reads(spark, folder))


def longest_contig(spark, folder):
    own = _reads(spark, folder).withColumn("locus_hint", F.coalesce("locus_hint", F.lit("")))
    return own.groupBy("sample_id", "locus_hint").agg(F.max_by("sequence", F.struct(F.length("sequence"), -F.col("rec_no"))).alias("sequence"))


def consensus(spark, folder):
    """Of the contigs of each hint, and of those without one."""
    return typing.consensus(_reads(spark, folder).withColumn("locus_hint", F.coalesce("locus_hint", F.lit(""))), "locus_hint")


def gold_threshold_mad(spark, folder):
    return _rounded(metrics.gold_threshold(_dist(spark, folder), _gold(spark, folder), True), "threshold")


def gold_threshold_sd(spark, folder):
    return _rounded(metrics.gold_threshold(_dist(spark, folder), _gold(spark, folder), False), "threshold")


def distance_auc(spark, folder):
    return _rounded(metrics.distance_auc(_dist(spark, folder), _gold(spark, folder)), "auc")


def within_percent(spark, folder):
    return _rounded(metrics.within_percent(_dist(spark, folder), _clusters(spark, folder).filter("assigned_cluster >= 0"), "assigned_cluster", 0.2), "within_pct")


def cluster_sizes(spark, folder):
    return _clusters(spark, folder).groupBy("assigned_cluster").agg(F.count("*").alias("n"))


def adjusted_rand(spark, folder):
    return _rounded(metrics.adjusted_rand(_clusters(spark, folder), _gold(spark, folder), "assigned_cluster", "cluster_alias"), "ari")


def cluster_relabel(spark, folder):
    return metrics.relabel(_clusters(spark, folder), "assigned_cluster")


def excluded_specimens(spark, folder):
    specimens = table(spark, folder, "specimens").select(clean_id("seq_id").alias("seq_id"))
    return metrics.with_excluded(_clusters(spark, folder), specimens, "assigned_cluster")


def id_collision(spark, folder):
    return metrics.colliding_ids(table(spark, folder, "specimens").select(clean_id("seq_id").alias("seq_id")), _contigs(spark, folder))


def metric_correlation(spark, folder):
    cut = Cut(spark)
    given = cut.write(_dist(spark, folder))
    return _rounded(metrics.correlation(given, distance.wibs_of_pairs(given, _calls(spark, folder), cut).withColumn("d", F.round("d", 9))), "pearson", "spearman")


def micro_clusters(spark, folder):
    return hierarchy.micro_clusters(_dist(spark, folder), threshold=0.08)


def _tree(spark, folder):
    own = distance.wibs_genotypes(_calls(spark, folder))
    return own, genotype_tree.genotype_tree(spark, own, distance.wibs_distances)


def ward_inertia(spark, folder):
    """Merges of the tree and the sum of their squared heights, which is 2/n of the squared distances, whatever the ties."""
    tree = _tree(spark, folder)[1].frame()
    return tree.agg(F.count("*").alias("n_merges"), F.round(F.sum(F.col("height") * F.col("height")), 4).alias("sum_h2"), F.max("size").alias("largest"))


def height_gaps(spark, folder):
    return _rounded(hierarchy.height_gaps(_tree(spark, folder)[1].frame()), "gap", "relative", "threshold")


def within_by_k(spark, folder):
    """The share of same-cluster pairs within 0.2 for each number of clusters."""
    own, tree = _tree(spark, folder)
    return _rounded(hierarchy.within_of_steps(genotype_tree.steps_within(spark, own, tree, distance.wibs_distances, 0.2), own.n), "within_pct")


def ward_tree(spark, folder):
    return _rounded(_tree(spark, folder)[1].frame(), "height")


def cophenetic_correlation(spark, folder):
    own, tree = _tree(spark, folder)
    return _rounded(genotype_tree.cophenetic_correlation(spark, own, tree, distance.wibs_distances), "cophenetic")


def knee_clusters(spark, folder):
    own = distance.wibs_genotypes(_calls(spark, folder))
    return _clustered(*genotype_tree.knee_clusters(spark, own, distance.wibs_distances))


def supervised_clusters(spark, folder):
    own = distance.wibs_genotypes(_calls(spark, folder))
    return _clustered(*genotype_tree.supervised_clusters(spark, own, distance.wibs_distances, _gold(spark, folder)))


def _clustered(labels, k, threshold):
    return labels.select("seq_id", F.col("label").alias("assigned_cluster"), F.lit(k).alias("k"), F.round(F.lit(threshold), 6).alias("threshold"))


QUERIES = {
    f.__name__: f
    for f in (
        barratt_matrix, plucinski_matrix, snp_wibs_matrix, rank_ensemble_matrix, wibs_pairs, snp_wibs_pairs, barratt_pairs, plucinski_pairs, rank_ensemble, double_centring, locus_parse, norm_name, content_hash, haplotype_id, locus_hint,
        presence_cells, completeness, complete_specimens, marker_dimension, locus_called, allele_frequency, allele_share, locus_entropy, snp_weight, haplotype_rank,
        haplotype_rank_all, denovo_calls_all, denovo_calls, contig_match, hinted_identity, read_filter, read_support, junction_trim, longest_contig, consensus, gold_threshold_mad, gold_threshold_sd,
        distance_auc, within_percent, cluster_sizes, adjusted_rand, cluster_relabel, excluded_specimens, id_collision, metric_correlation, micro_clusters,
        junctions, ward_inertia, height_gaps, within_by_k, ward_tree, cophenetic_correlation, knee_clusters, supervised_clusters,
    )
}

def _mism(a: str, b: str) -> str:
    """Differing places on the common prefix."""
    n = f"least(length({a}), length({b}))"
    return f"hamming(substr({a}, 1, {n}), substr({b}, 1, {n}))"


_HAP_RANK = CONTIGS + """,
counted as (select locus_hint as locus, sequence, count(*) as n, min(ord) as first_ord from contigs_v where locus_hint <> '' group by 1, 2),
ranked as (select *, row_number() over (partition by locus order by n desc, length(sequence) desc, first_ord) as rank from counted),
named as (select *, replace(trim(locus), ' ', '_') || '_L' || length(sequence) || 'bp.H' || lpad(cast(rank as varchar), cast(greatest(2, length(cast(rank as varchar))) as integer), '0') || '_' || upper(substr(md5(upper(sequence)), 1, 4)) as marker from ranked)"""

ORACLE = {
    "wibs_pairs": f"with {WIBS} select i, j, round(d, 6) as d from wibs",
    "snp_wibs_pairs": f"""with {KEPT},{PAIRS},{HAPS},
      seqs as (select {CLEAN.format('marker')} as marker, arg_max(sequence, length(sequence)) as sequence from haps_v where sequence <> '' group by 1),
      n as (select count(*) as n from complete),
      car as (select locus, marker, count(distinct seq_id) as c from kept group by 1, 2),
      sw as (select m.locus, avg(1 / sqrt(greatest((coalesce(c, 0) / n) * (1 - coalesce(c, 0) / n), 1e-6))) as w from markers_v m left join car using (locus, marker), n group by 1),
      ms as (select distinct locus, marker, sequence from kept left join seqs using (marker)),
      md as (select x.locus, x.marker as m1, y.marker as m2, ({_mism('x.sequence', 'y.sequence')} + abs(length(x.sequence) - length(y.sequence))) / greatest(length(x.sequence), length(y.sequence)) as md
             from ms x join ms y on x.locus = y.locus and x.marker < y.marker where x.sequence is not null and y.sequence is not null),
      same as (select i, j, locus, 0.0 as dl from locus_pairs where list_has_any(v1, v2)),
      apart as (select i, j, locus, x, unnest(v2) as y from (select i, j, locus, unnest(v1) as x, v2 from locus_pairs where not list_has_any(v1, v2))),
      dl as (select a.i, a.j, a.locus, min(coalesce(md, 1.0)) as dl from apart a left join md on md.locus = a.locus and md.m1 = least(x, y) and md.m2 = greatest(x, y) group by 1, 2, 3)
      select i, j, round(sum(dl * w) / sum(w), 6) as d from (select * from same union all select * from dl) join sw using (locus) group by 1, 2""",
    "barratt_pairs": f"with {BARRATT} select i, j, round(d, 6) as d from barratt",
    "plucinski_pairs": f"with {KEPT},{PAIRS},{SHARES},{PLUCINSKI} select i, j, round(d, 6) as d from plucinski",
    "rank_ensemble": f"""with {BARRATT},{PLUCINSKI},
      a as (select i, j, round(d, 6) as d from barratt), b as (select i, j, round(d, 6) as d from plucinski),
      ra as (select i, j, (rank() over (order by d) + (count(*) over (partition by d) - 1) / 2) / count(*) over () as f from a),
      rb as (select i, j, (rank() over (order by d) + (count(*) over (partition by d) - 1) / 2) / count(*) over () as f from b)
      select i, j, round((ra.f + rb.f) / 2, 6) as d from ra join rb using (i, j)""",
    "double_centring": f"""with {WIBS},
      full_m as (select i, j, d from wibs union all select j, i, d from wibs union all select seq_id, seq_id, 0.0 from complete),
      m as (select i, avg(d * d) as m from full_m group by 1)
      select f.i, f.j, case when round(-0.5 * (d * d - a.m - b.m + (select avg(m) from m)), 6) = 0 then 0.0 else round(-0.5 * (d * d - a.m - b.m + (select avg(m) from m)), 6) end as g from full_m f join m a on a.i = f.i join m b on b.i = f.j""",
    "locus_parse": f"""with p as (select distinct marker, regexp_replace(regexp_replace({_PARSED.format('marker')}, '_L[0-9]+bp$', ''), '_+$', '') as l from calls)
      select marker, case when contains(l, 'Junction') or (contains(l, 'Mt_') and contains(l, 'Cmt')) then 'Mt_Cmt' else l end as locus from p""".replace("trim(marker)", "trim(marker, ' ' || chr(9) || chr(10) || chr(13))"),
    "norm_name": "select distinct marker, trim(replace(string_split(marker, '.')[-1], '-', '_')) as norm from calls",
    "content_hash": "select ord, upper(substr(md5(upper(trim(sequence, ' ' || chr(9) || chr(10) || chr(13)))), 1, 4)) as hash4, upper(substr(md5(upper(trim(sequence, ' ' || chr(9) || chr(10) || chr(13)))), 1, 6)) as hash6 from contigs where sequence is not null",
    "haplotype_id": f"""with p as (select *, regexp_replace(regexp_replace({_PARSED.format('marker')}, '_L[0-9]+bp$', ''), '_+$', '') as l from haplotypes where sequence is not null),
      q as (select *, case when contains(l, 'Junction') or (contains(l, 'Mt_') and contains(l, 'Cmt')) then 'Mt_Cmt' else l end as loc from p)
      select rec_no, replace(trim(loc), ' ', '_') || '_L' || length(sequence) || 'bp.H' || lpad(cast(rank as varchar), cast(greatest(2, length(cast(rank as varchar))) as integer), '0') || '_' || upper(substr(md5(upper(trim(sequence, ' ' || chr(9) || chr(10) || chr(13)))), 1, 4)) as hap_id from q""",
    "locus_hint": "select ord, trim(string_split(string_split(locus_hint, '_Hap_')[1], '.')[1]) as locus from contigs where locus_hint is not null",
    "presence_cells": f"with {CALLS} select seq_id, marker, 'X' as cell from calls_v",
    "completeness": f"""with {CALLS}, ids as (select {CLEAN.format('seq_id')} as seq_id from specimens union select seq_id from calls_v)
      select ids.seq_id, count(distinct locus) as n_loci, round(count(distinct locus) / (select count(distinct locus) from calls_v), 6) as completeness from ids left join calls_v using (seq_id) group by 1""",
    "complete_specimens": f"""with {CALLS} select seq_id, count(*) as n_markers from calls_v group by 1 having count(distinct locus) >= 0.5 * (select count(distinct locus) from calls_v)""",
    "marker_dimension": f"with {KEPT} select locus, marker, cast(ploidy as integer) as ploidy from markers_v",
    "locus_called": f"with {CALLS} select locus, count(distinct seq_id) as called from calls_v group by 1",
    "allele_frequency": f"with {WEIGHTS} select locus, marker, cast(ploidy as integer) as ploidy, carriers, called, round(p, 6) as p, round(w, 6) as w from weights",
    "allele_share": f"with {CALLS} select locus, marker, count(*) as n, round(count(*) / sum(count(*)) over (partition by locus), 6) as share from calls_v group by 1, 2",
    "locus_entropy": f"with {CALLS}, s as (select locus, count(*) / sum(count(*)) over (partition by locus) as share from calls_v group by locus, marker) select locus, round(-sum(share * log2(share)), 6) as entropy from s group by 1",
    "snp_weight": f"""with {KEPT}, n as (select count(*) as n from complete), c as (select locus, marker, count(distinct seq_id) as c from kept group by 1, 2)
      select locus, round(avg(1 / sqrt(greatest((coalesce(c, 0) / n) * (1 - coalesce(c, 0) / n), 1e-6))), 6) as w from markers_v left join c using (locus, marker), n group by 1""",
    "haplotype_rank": f"with {_HAP_RANK} select locus, sequence, n, cast(length(sequence) as integer) as len, cast(rank as integer) as rank, marker from named",
    "denovo_calls": f"with {_HAP_RANK} select distinct c.seq_id, c.locus_hint as locus, marker from contigs_v c join named n on n.locus = c.locus_hint and n.sequence = c.sequence",
    "hinted_identity": f"""with {CONTIGS},{HAPS}, p as (select rec_no, sequence, regexp_replace(regexp_replace({_PARSED.format('marker')}, '_L[0-9]+bp$', ''), '_+$', '') as l from haps_v where sequence <> ''),
      q as (select upper(case when contains(l, 'Junction') or (contains(l, 'Mt_') and contains(l, 'Cmt')) then 'Mt_Cmt' else l end) as locus_hint, sequence as r, rec_no from p),
      x as (select distinct c.locus_hint, c.sequence as s, r, rec_no from contigs_v c join q using (locus_hint)), y as (select *, {_mism('s', 'r')} as mm, least(length(s), length(r)) as lo, greatest(length(s), length(r)) as hi from x)
      select locus_hint, s as sequence, rec_no, round((mm + hi - lo) / hi, 6) as distance, round(case when lo / hi < 0.6 then 0 else (lo - mm) / hi end, 6) as approx, round(100 * lo / hi, 6) as coverage,
             round(100 * (lo - mm) / lo, 6) as identity, contains(s, r) or contains(r, s) as contained from y""",
    "read_filter": f"""with {CONTIGS}, q as (select ord as rec_no, length(sequence) as n, (10 * (length(sequence) - length(replace(sequence, 'A', ''))) + 20 * (length(sequence) - length(replace(sequence, 'C', '')))
      + 30 * (length(sequence) - length(replace(sequence, 'G', ''))) + 40 * (length(sequence) - length(replace(sequence, 'T', '')))) / length(sequence) as quality from contigs_v)
      select rec_no, round(quality, 6) as quality from q where n between 300 and 1500 and quality >= 20""",
    "read_support": f"""with {CONTIGS},{HAPS}, s as (select seq_id as sample_id, marker, count(distinct ord) as n from contigs_v c join haps_v h on length(h.sequence) >= 20 and contains(c.sequence, substr(h.sequence, 1, 20)) group by 1, 2)
      select sample_id, marker, 99.5::double as identity_pct, n as read_support, 10 * n as bitscore from s where n >= 2""",
    "junction_trim": f"""with {CONTIGS}, a as (select ord, sequence as s, instr(sequence, 'CCATCTACAGC') as f from contigs_v),
      b as (select ord, s, case when f > 0 then substr(s, f + 11) else s end as t from a)
      select ord as rec_no, regexp_matches(s, '(?i)(CCATCTACAGC.*AACAC|GTGTT.*GCTGTAGATGG)') as junction,
             case when instr(reverse(t), 'CACAA') > 0 then substr(t, 1, length(t) - instr(reverse(t), 'CACAA') - 4) else t end as trimmed from b""",
    "longest_contig": f"with {CONTIGS} select seq_id as sample_id, locus_hint, sequence from (select *, row_number() over (partition by seq_id, locus_hint order by length(sequence) desc, ord) as rn from (select * replace (coalesce(locus_hint, '') as locus_hint) from contigs_v)) where rn = 1",
    "gold_threshold_mad": f"with {GOLD_PAIRS}, w as (select d from gp where li = lj), m as (select median(d) as m from w) select round(coalesce((select m from m) + 3 * 1.4826 * median(abs(d - (select m from m))), 0.05), 6) as threshold, count(*) as n_pairs from w",
    "gold_threshold_sd": f"with {GOLD_PAIRS} select round(coalesce(avg(d) + 3 * coalesce(stddev_samp(d), 0), 0.05), 6) as threshold, count(*) as n_pairs from gp where li = lj",
    "distance_auc": f"""with {GOLD_PAIRS}, r as (select li = lj as same, rank() over (order by round(d, 12)) + (count(*) over (partition by round(d, 12)) - 1) / 2 as r from gp),
      s as (select count(*) as n, coalesce(sum(same::int), 0) as n1, sum(case when same then r end) as s from r)
      select round(case when n1 > 0 and n > n1 then 1 - (s - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) else 0.5 end, 6) as auc, cast(n1 as bigint) as n_same, cast(n - n1 as bigint) as n_other from s""",
    "within_percent": f"with {DIST},{CLUSTERS} select round(coalesce(100 * avg((d <= 0.2)::int), 100.0), 6) as within_pct, count(*) as n_pairs from dist join clusters_v a on a.seq_id = i join clusters_v b on b.seq_id = j where a.assigned_cluster = b.assigned_cluster and a.assigned_cluster >= 0",
    "cluster_sizes": f"with {CLUSTERS} select assigned_cluster, count(*) as n from clusters_v group by 1",
    "adjusted_rand": f"""with {CLUSTERS},{GOLD}, c as (select assigned_cluster as a, cluster_alias as b, count(*) as n from clusters_v join gold_v using (seq_id) group by 1, 2),
      t as (select (select sum(n * (n - 1) / 2) from c) as sab, (select sum(n * (n - 1) / 2) from (select sum(n) as n from c group by a)) as sa, (select sum(n * (n - 1) / 2) from (select sum(n) as n from c group by b)) as sb, (select sum(n) from c) as n)
      select round(case when (sa + sb) / 2 = sa * sb / (n * (n - 1) / 2) then 1.0 else (sab - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)) end, 6) as ari, cast(n as bigint) as n from t""",
    "cluster_relabel": f"with {CLUSTERS}, f as (select assigned_cluster, row_number() over (order by min(seq_id)) as label from clusters_v group by 1) select seq_id, cast(label as integer) as label from clusters_v join f using (assigned_cluster)",
    "excluded_specimens": f"with {CLUSTERS} select seq_id, assigned_cluster from clusters_v union all select distinct {CLEAN.format('seq_id')}, -1 from specimens where {CLEAN.format('seq_id')} not in (select seq_id from clusters_v)",
    "id_collision": f"with {CONTIGS} select {CLEAN.format('seq_id')} as seq_id from specimens intersect select seq_id from contigs_v",
    "metric_correlation": f"""with {WIBS},{DIST}, b as (select i, j, dist.d as x, round(wibs.d, 9) as y from dist join wibs using (i, j)),
      r as (select x, y, rank() over (order by round(x, 12)) + (count(*) over (partition by round(x, 12)) - 1) / 2 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 as ry from b)
      select round(corr(x, y), 6) as pearson, round(corr(rx, ry), 6) as spearman, count(*) as n from r""",
    "micro_clusters": f"""with recursive {DIST}, e as (select i as a, j as b from dist where d <= 0.08 union select j, i from dist where d <= 0.08),
      reach as (select a, a as b from e union select r.a, e.b from reach r join e on e.a = r.b), c as (select a as seq_id, min(b) as first_seq_id from reach group by 1)
      select seq_id, first_seq_id, count(*) over (partition by first_seq_id) as size from c""",
}

_ALL = "every_pair as (select a.seq_id as i, b.seq_id as j from complete a join complete b on a.seq_id < b.seq_id)"
_BARRATT_ALL = "barratt_all as (select i, j, round(coalesce(d, (select case when max(d) > 0 then max(d) else 1 end from barratt)), 6) as d from every_pair left join barratt using (i, j))"
_PLUCINSKI_ALL = "plucinski_all as (select i, j, round(coalesce(d, 2), 6) as d from every_pair left join plucinski using (i, j))"

ORACLE |= {
    "barratt_matrix": f"with {BARRATT},{_ALL},{_BARRATT_ALL} select i, j, d from barratt_all",
    "plucinski_matrix": f"with {KEPT},{PAIRS},{SHARES},{PLUCINSKI},{_ALL},{_PLUCINSKI_ALL} select i, j, d from plucinski_all",
    "snp_wibs_matrix": f"with {KEPT},{_ALL}, s as ({ORACLE['snp_wibs_pairs']}) select i, j, coalesce(d, 1) as d from every_pair left join s using (i, j)",
    "rank_ensemble_matrix": f"""with {BARRATT},{PLUCINSKI},{_ALL},{_BARRATT_ALL},{_PLUCINSKI_ALL},
      ra as (select i, j, (rank() over (order by d) + (count(*) over (partition by d) - 1) / 2) / count(*) over () as f from barratt_all),
      rb as (select i, j, (rank() over (order by d) + (count(*) over (partition by d) - 1) / 2) / count(*) over () as f from plucinski_all)
      select i, j, round((ra.f + rb.f) / 2, 6) as d from ra join rb using (i, j)""",
}

_MATCH = f"""{CONTIGS},{HAPS},
s as (select distinct sequence as s from contigs_v),
near as (select s, rec_no, marker, sequence as r, 100.0::double * least(length(s), length(sequence)) / greatest(length(s), length(sequence)) as cov from s, haps_v where sequence <> ''),
scored as (select s, rec_no, marker, cov, contains(s, r) or contains(r, s) as exact, 100.0::double * (least(length(s), length(r)) - {_mism('s', 'r')}) / least(length(s), length(r)) as ident from near where cov >= 85),
ordered as (select *, row_number() over (partition by s order by not exact, case when exact then 0 else -ident end, rec_no) as rn from scored),
best as (select s, marker, cov, case when exact then 100.0 else ident end as ident from ordered where rn = 1),
named as (
  select s.s, case when ident >= 99 then marker
    when ident > 0 then case when contains(marker, '_Hap_') then string_split(marker, '_Hap_')[1] when contains(marker, 'Junction') then 'Mt_Cmt' else marker end || '_NOVEL_' || upper(substr(md5(s.s), 1, 6))
    else 'Novel_Marker_' || upper(substr(md5(s.s), 1, 6)) end as marker, ident, cov
  from s left join best on best.s = s.s)"""

ORACLE |= {
    "contig_match": f"with {_MATCH} select ord, marker, round(ident, 6) as identity_pct, round(cov, 6) as coverage_pct from contigs_v c join named n on n.s = c.sequence",
    "consensus": f"""with {CONTIGS}, r as (select coalesce(locus_hint, '') as locus_hint, ord, sequence from contigs_v),
      m as (select locus_hint, floor(median(length(sequence))) as mid, count(*) as n_reads from r group by 1),
      b as (select locus_hint, n_reads, length(sequence) as len from (select r.*, n_reads, row_number() over (partition by locus_hint order by abs(length(sequence) - mid), ord) as rn from r join m using (locus_hint)) where rn = 1),
      l as (select locus_hint, ord, pos, sequence[cast(pos as bigint)] as base from (select locus_hint, ord, sequence, unnest(range(1, length(sequence) + 1)) as pos from r)),
      v as (select locus_hint, pos, base, count(*) as n, min(ord) as first_ord from l group by 1, 2, 3),
      w as (select *, row_number() over (partition by locus_hint, pos order by n desc, first_ord) as rn from v)
      select locus_hint, string_agg(base, '' order by pos) as consensus, max(n_reads) as n_reads from w join b using (locus_hint) where rn = 1 and pos <= len group by 1""",
    "junctions": f"""with {CONTIGS}, a as (select seq_id, ord, sequence as s from contigs_v where regexp_matches(sequence, '(CCATCTACAGC.*AACAC|GTGTT.*GCTGTAGATGG)')),
      b as (select seq_id, ord, case when instr(s, 'CCATCTACAGC') > 0 then substr(s, instr(s, 'CCATCTACAGC') + 11) else s end as t from a),
      c as (select seq_id, ord, case when instr(reverse(t), 'CACAA') > 0 then substr(t, 1, length(t) - instr(reverse(t), 'CACAA') - 4) else t end as t from b),
      d as (select seq_id, t as s from (select *, row_number() over (partition by seq_id order by length(t) desc, ord) as rn from c where length(t) > 20) where rn = 1),
      e as (select seq_id, case when instr(s, 'CCATCTACAGC') > 0 then substr(s, instr(s, 'CCATCTACAGC') + 11) else s end as t from d),
      f as (select seq_id, case when instr(reverse(t), 'CACAA') > 0 then substr(t, 1, length(t) - instr(reverse(t), 'CACAA') - 4) else t end as t from e)
      select seq_id as sample_id, 'Mt_Cmt' || (length(t) + 43) || '.X_Junction_Hap_' || seq_id as marker, t as sequence from f where t <> ''""",
    "ward_inertia": f"""with {WIBS}, n as (select count(*) as n from complete)
      select (select n - 1 from n) as n_merges, round(2 * sum(d * d) / (select n from n), 4) as sum_h2, (select n from n) as largest from wibs""",
}
