"""Command line: ``python -m lociforge.cli generate-sheet | distances | cluster | process-reads | run-all``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.functions.names import clean_locus_hint, parse_locus
from lociforge.operators import distance, hierarchy, metrics, typing
from lociforge.session import Cut, close_cuts, get_session, open_cuts
from lociforge.sources import files, sinks


def calls_of(spark: SparkSession, args: argparse.Namespace, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """``(specimens, calls)``: ``(seq_id)``, also of specimens without calls, and ``(seq_id, locus, marker)``.

    From call lists, or from contigs with or without references. A folder of call lists that holds FASTA is one of contigs.
    """
    assembled = args.assembled
    if assembled is None and args.specimens is None:
        raise SystemExit("--specimens or --assembled is needed")
    if assembled is None and files.holds_fasta(spark, args.specimens):
        assembled = args.specimens
    if assembled is None:
        specimens, calls = files.read_call_lists(spark, args.specimens, args.background)
        return specimens, calls.withColumn("locus", parse_locus(F.col("marker")))
    contigs = cut.write(files.read_contigs(spark, assembled))
    specimens = contigs.select("seq_id").distinct()
    if args.references and not args.de_novo:
        found = typing.match_contigs(contigs, files.read_references(spark, args.references)).join(contigs.select("ord", "seq_id"), "ord")
        return specimens, found.select("seq_id", "marker").distinct().withColumn("locus", parse_locus(F.col("marker")))
    named = contigs.withColumn("locus", parse_locus(clean_locus_hint(F.col("locus_hint"))))
    return specimens, typing.denovo_calls(typing.assigned_loci(cut.write(named.select("seq_id", "locus", "sequence", "ord")), cut))


def metric_of(args: argparse.Namespace) -> str:
    """The metric asked for, else the one that suits the reads: ``wibs`` for noisy ones and unknown panels."""
    return args.metric or ("wibs" if args.de_novo or args.preset == "ont-r10" else "ensemble")


def pairs_of(calls: DataFrame, args: argparse.Namespace, cut: Cut) -> DataFrame:
    metric, ploidy, least = metric_of(args), args.ploidy, args.min_completeness
    if metric == "wibs":
        return distance.wibs_pairs(calls, ploidy, least)
    if metric == "snp-wibs":
        path = args.sequences or args.references
        if path is None:
            raise SystemExit("snp-wibs needs --sequences or --references")
        return distance.snp_pairs(calls, files.read_marker_sequences(calls.sparkSession, path), ploidy, least, every=True)
    first = distance.barratt_matrix(calls, cut, ploidy, least)
    return distance.rank_ensemble(first, distance.plucinski_pairs(calls, ploidy, args.epsilon, least, every=True))


def cluster(pairs: DataFrame, gold: DataFrame | None, args: argparse.Namespace, cut: Cut) -> DataFrame:
    if gold is not None:
        labels, k, threshold = hierarchy.supervised_clusters(pairs, gold, cut, args.stringency, args.calibration == "robust")
    else:
        labels, k, threshold = hierarchy.knee_clusters(pairs, cut)
    print(f"{k} clusters, threshold {threshold:.5f}")
    return labels


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lociforge")
    out.add_argument("command", choices=["generate-sheet", "distances", "cluster", "process-reads", "run-all"])
    out.add_argument("--specimens", help="folder or zip of call lists, or of FASTA")
    out.add_argument("--background", help="call lists whose specimens must have other names")
    out.add_argument("--assembled", help="FASTA file, folder or zip of contigs")
    out.add_argument("--references", help="FASTA of reference haplotypes")
    out.add_argument("--sequences", help="FASTA of marker sequences for snp-wibs")
    out.add_argument("--de-novo", action="store_true", help="find loci and haplotypes without references")
    out.add_argument("--reads", help="FASTQ file or folder")
    out.add_argument("--junctions", action="store_true", help="process-reads: write the junction of each sample as FASTA")
    out.add_argument("--min-quality", type=float, default=10.0)
    out.add_argument("--min-support", type=int, default=5)
    out.add_argument("--sheet", help="haplotype sheet; with cluster: its specimens outside the matrix come out as -1")
    out.add_argument("--matrix")
    out.add_argument("--gold", help="known clusters")
    out.add_argument("--stringency", type=float, default=95.0, help="percent of same-cluster pairs within the threshold")
    out.add_argument("--calibration", choices=["robust", "classical"], default="robust", help="median and MAD, or mean and deviation")
    out.add_argument("--preset", choices=["illumina", "ont-r10", "pacbio-hifi"], default="illumina")
    out.add_argument("--metric", choices=["wibs", "snp-wibs", "ensemble"])
    out.add_argument("--ploidy", type=int)
    out.add_argument("--epsilon", type=float, default=distance.EPSILON)
    out.add_argument("--min-completeness", type=float, default=0.10)
    out.add_argument("--single-file", action="store_true", help="write each table as one file, by one task")
    out.add_argument("--output", required=True)
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    gold = files.read_gold(spark, args.gold) if args.gold else None
    one = args.single_file
    cut = Cut(spark)
    if args.command == "process-reads":
        reads = files.read_fastq(spark, args.reads)
        if args.junctions:
            sinks.write_fasta(typing.junctions(reads), args.output)
            return
        if not args.references:
            raise SystemExit("process-reads needs --references or --junctions")
        kept = typing.filter_reads(reads, min_quality=args.min_quality)
        sinks.write_table(typing.read_support(kept, files.read_references(spark, args.references), args.min_support), args.output, header=False, single=one)
    elif args.command == "generate-sheet":
        specimens, calls = calls_of(spark, args, cut)
        sinks.write_sheet(calls, args.output, specimens, one)
    elif args.command == "distances":
        calls = files.read_sheet_calls(spark, args.sheet).withColumn("locus", parse_locus(F.col("marker")))
        sinks.write_matrix(cut.write(pairs_of(cut.write(calls), args, cut)), args.output, one)
    elif args.command == "cluster":
        labels = cluster(cut.write(files.read_matrix(spark, args.matrix)), gold, args, cut)
        if args.sheet:
            table = files.read_sheet(spark, args.sheet)
            labels = metrics.with_excluded(labels, table.select(F.col(table.columns[0]).alias("seq_id")), "label")
        sinks.write_clusters(labels, args.output, one)
    else:
        specimens, calls = (cut.write(t) for t in calls_of(spark, args, cut))
        sinks.write_sheet(calls, f"{args.output}/sheet", specimens, one)
        pairs = cut.write(pairs_of(calls, args, cut))
        sinks.write_matrix(pairs, f"{args.output}/matrix", one)
        # specimens outside the matrix are reported as -1
        sinks.write_clusters(metrics.with_excluded(cluster(pairs, gold, args, cut), specimens, "label"), f"{args.output}/clusters", one)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark, before = SparkSession.getActiveSession() or get_session(), open_cuts()
    try:
        run(spark, args)
    finally:
        close_cuts(keep=before)  # the results are written


if __name__ == "__main__":
    main()
