import gzip
import os
import zipfile

import pytest

from lociforge import cli
from lociforge.operators import distance
from lociforge.plans import file_queries
from lociforge.session import close_cuts, open_cuts, shared_folder
from lociforge.sources import files, sinks
from lociforge.streaming import ingest


def test_fasta_and_contigs(spark, tmp_path):
    folder = tmp_path / "c"
    folder.mkdir()
    (folder / "x.fasta").write_text(">S1|L1_Hap_3 note\nacgt\nACGTACGTACGTACGTACGT\n>S2_contig7\n" + "A" * 30 + "\n>read9\n" + "C" * 25 + "\n>short|L1\nACGT\n")
    with gzip.open(folder / "y.fa.gz", "wt") as f:
        f.write(">odd\n" + "G" * 40 + "\n")
    got = {(r["seq_id"], r["locus_hint"], r["sequence"]) for r in files.read_contigs(spark, str(folder)).collect()}
    assert got == {("S1", "L1_Hap_3 note", "ACGT" * 6), ("S2", None, "A" * 30), ("x", None, "C" * 25), ("y", None, "G" * 40)}
    (tmp_path / "r.fasta").write_text(">a.L1-H1\nACGT\n>a.L1-H1\nGGGG\n>b\n\n")
    assert [tuple(r) for r in files.read_references(spark, str(tmp_path / "r.fasta")).collect()] == [(1, "L1_H1", "GGGG")]
    with pytest.raises(Exception):
        files.read_contigs(spark, str(tmp_path / "missing")).count()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/P7.fasta", ">P1|L1\r\nACGTACGTAC\r\nGTACGTACGTAC\r\n>plain\n" + "T" * 22 + "\n")
        z.writestr("__MACOSX/x.fasta", ">no|L1\n" + "T" * 30 + "\n")
        z.writestr("in/.dot.fasta", ">no|L1\n" + "T" * 30 + "\n")
    for place in (tmp_path / "z.zip", tmp_path):
        zipped = files.read_contigs(spark, str(place))
        rows = {(r["seq_id"], r["locus_hint"], r["sequence"]) for r in zipped.collect()}
        assert rows >= {("P1", "L1", "ACGTACGTACGTACGTACGTAC"), ("P7", None, "T" * 22)} and not any(r[0] == "no" for r in rows)
        assert zipped.select("ord").distinct().count() == zipped.count()
    assert files.holds_fasta(spark, str(tmp_path / "z.zip")) and files.holds_fasta(spark, str(folder))
    (tmp_path / "q.fasta").write_text(">a.L1-H1 note\nACGT\nAC\n>a.L1-H1 note\nGGGG\n")
    assert [tuple(r) for r in files.read_marker_sequences(spark, str(tmp_path / "q.fasta")).collect()] == [("L1_H1 note", "GGGG")]


def test_call_lists(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    (folder / "A.txt").write_text("L1_Hap_1\t3\nL2_Hap_1\n\nL1_Hap_1\n")
    (folder / "B.txt").write_text("")
    (folder / ".hidden").write_text("x")
    with zipfile.ZipFile(folder / "z.zip", "w") as z:
        z.writestr("in/C.txt", "L1_Hap_2\n")
    specimens, calls = files.read_call_lists(spark, str(folder))
    assert {r[0] for r in specimens.collect()} == {"A", "B", "C"}
    assert {tuple(r) for r in calls.collect()} == {("A", "L1_Hap_1"), ("A", "L2_Hap_1"), ("C", "L1_Hap_2")}
    assert not files.holds_fasta(spark, str(folder))
    back = tmp_path / "back"
    back.mkdir()
    (back / "A.txt").write_text("q")
    with pytest.raises(ValueError):
        files.read_call_lists(spark, str(folder), str(back))


def test_fastq(spark, tmp_path):
    text = "".join(f"@r{i}\nACGT{'ACGT'[i % 4]}\n+\n@IIII\n" for i in range(10))
    (tmp_path / "s.fastq").write_text(text)
    got = sorted(tuple(r) for r in files.read_fastq(spark, str(tmp_path / "s.fastq")).collect())
    assert got == [("s", i, f"r{i}", f"ACGT{'ACGT'[i % 4]}", "@IIII") for i in range(10)]


def test_matrix_gold_and_clusters(spark, tmp_path):
    pairs = spark.createDataFrame([("A", "B", 0.25), ("A", "C", 1.0), ("B", "C", 0.5)], "i string, j string, d double")
    sinks.write_matrix(pairs, str(tmp_path / "m"))
    assert {tuple(r) for r in files.read_matrix(spark, str(tmp_path / "m")).collect()} == {tuple(r) for r in pairs.collect()}
    (tmp_path / "gold.tsv").write_text("Seq_ID True_Cluster\nA\t1\nB   2\n")
    assert {tuple(r) for r in files.read_gold(spark, str(tmp_path / "gold.tsv")).collect()} == {("A", "1"), ("B", "2")}
    golds = tmp_path / "golds"
    golds.mkdir()
    for name, row in (("x", "A 1"), ("y", "B 2")):
        (golds / name).write_text(f"Seq_ID True_Cluster\n{row}\n")
    assert {tuple(r) for r in files.read_gold(spark, str(golds)).collect()} == {("A", "1"), ("B", "2")}


def test_run_all_and_reads(spark, tmp_path):
    place = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    close_cuts()
    before = set(os.listdir(place))
    rows = []
    for i in range(8):
        for locus in ("L1", "L2", "L3"):
            rows.append(f">S{i}|{locus}\n" + ("ACGGTCA" if i < 4 else "TTGACCA") * 5 + "A" * len(locus) + ("G" if locus == "L3" and i % 2 else ""))
    (tmp_path / "c.fasta").write_text("\n".join(rows) + "\n")
    cli.main(["run-all", "--assembled", str(tmp_path / "c.fasta"), "--metric", "wibs", "--output", str(tmp_path / "out")])
    assert set(os.listdir(place)) <= before  # no table of a cut is left
    got = spark.read.csv(str(tmp_path / "out/clusters"), sep="\t", header=True).collect()
    assert len(got) == 8 and len({r["Assigned_cluster"] for r in got if r["Seq_ID"] < "S4"}) == 1
    assert len(files.read_sheet(spark, str(tmp_path / "out/sheet")).columns) > 4
    read = "ACGTACGTACGTACGTACGTACGT" * 20
    (tmp_path / "s.fastq").write_text(f"@a\n{read}\n+\n{'I' * len(read)}\n" * 6)
    (tmp_path / "ref.fasta").write_text(f">L1_H01_TEST\n{read[:60]}\n")
    cli.main(["process-reads", "--reads", str(tmp_path / "s.fastq"), "--references", str(tmp_path / "ref.fasta"), "--output", str(tmp_path / "ont")])
    assert spark.read.csv(str(tmp_path / "ont"), sep="\t").first()[1] == "L1_H01_TEST"
    middle = "GATTACA" * 5
    (tmp_path / "j.fastq").write_text(f"@a\nTTCCATCTACAGC{middle}AACACTT\n+\n{'I' * 55}\n@b\nCCATCTACAGC{middle[:25]}AACAC\n+\n{'I' * 41}\n")
    cli.main(["process-reads", "--reads", str(tmp_path / "j.fastq"), "--junctions", "--output", str(tmp_path / "jf")])
    assert [(r["header"], r["sequence"]) for r in files.read_fasta(spark, str(tmp_path / "jf")).collect()] == [("Mt_Cmt78.X_Junction_Hap_j", middle)]
    common = ["--min-completeness", "0", "--ploidy", "1"]
    cli.main(["distances", "--sheet", str(tmp_path / "out/sheet"), "--epsilon", "0.2", "--single-file", *common, "--output", str(tmp_path / "d")])
    assert files.read_matrix(spark, str(tmp_path / "d")).count() == 28
    cli.main(["cluster", "--matrix", str(tmp_path / "d"), "--sheet", str(tmp_path / "out/sheet"), "--output", str(tmp_path / "c2")])
    assert spark.read.csv(str(tmp_path / "c2"), sep="\t", header=True).count() == 8


def test_run_all_reports_specimens_without_or_with_few_calls(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(5):
        (folder / f"S{i}.txt").write_text("".join(f"L{k}_Hap_{1 + (i > 2)}\n" for k in range(12)))
    (folder / "EMPTY.txt").write_text("")
    (folder / "FEW.txt").write_text("L1_Hap_1\n")
    cli.main(["run-all", "--specimens", str(folder), "--preset", "ont-r10", "--output", str(tmp_path / "out")])
    got = {r["Seq_ID"]: r["Assigned_cluster"] for r in spark.read.csv(str(tmp_path / "out/clusters"), sep="\t", header=True).collect()}
    assert set(got) == {"S0", "S1", "S2", "S3", "S4", "EMPTY", "FEW"} and {s for s, c in got.items() if c == "-1"} == {"EMPTY", "FEW"}
    assert {r["Seq_ID"] for r in files.read_sheet(spark, str(tmp_path / "out/sheet")).collect()} == set(got)


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "A.txt").write_text("L1\nL1\nL2\n")
    seen = []
    for extra in (None, "B.txt"):
        if extra:
            (folder / extra).write_text("L9\n")
        query = ingest.keep_calls(ingest.distinct_calls(ingest.stream_call_lists(spark, str(folder))), str(tmp_path / "t"), str(tmp_path / "cp"), lambda t: seen.append(t.count()))
        query.awaitTermination(120)
    assert seen[-1] == 3
    assert {(r["seq_id"], r["marker"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("A", "L1"), ("A", "L2"), ("B", "L9")}


def test_wide_files_have_no_limit_of_columns(spark, tmp_path):
    n = 20_050
    names = [f"L1_Hap_{k:05d}" for k in range(n)]
    calls = spark.createDataFrame([("S,1", m) for m in names] + [('S"2', names[7])], "seq_id string, marker string")
    sinks.write_sheet(calls, str(tmp_path / "s"), spark.createDataFrame([("EMPTY",)], "seq_id string"))
    assert files.read_sheet_calls(spark, str(tmp_path / "s")).exceptAll(calls).count() == 0 and files.read_sheet_calls(spark, str(tmp_path / "s")).count() == n + 1
    lines = [r[0] for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert {len(x.split("\t")) for x in lines} == {n + 1} and any(x.startswith("EMPTY\t") for x in lines)
    pairs = spark.createDataFrame([('A"x', "B,y", 0.25), ('A"x', "C", 1e-7), ("B,y", "C", 0.5)], "i string, j string, d double")
    sinks.write_matrix(pairs, str(tmp_path / "m"))
    assert {tuple(r) for r in files.read_matrix(spark, str(tmp_path / "m")).collect()} == {tuple(r) for r in pairs.collect()}


def test_matrix_of_more_ids_than_a_plan_has_columns(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/x.csv").write_text("i," + ",".join(f"B{k:05d}" for k in range(20_600)) + "\nA," + ",".join(str(k / 32) for k in range(20_600)) + "\n")
    back = files.read_matrix(spark, str(tmp_path / "m"))
    assert back.count() == 20_600 and {tuple(r) for r in back.filter("j in ('B00001', 'B20599')").collect()} == {("A", "B00001", 1 / 32), ("A", "B20599", 20_599 / 32)}


def test_matrix_file_leaves_no_text_of_the_whole_matrix(spark):
    rows = [(f"S{i:03d}{x}", f"L{k % 4}", f"L{k % 4}_Hap_{(i * k) % 7}") for i in range(50) for k in range(1, 6) for x in (",b" if i == 3 else '"' if i == 4 else "",)]
    calls = spark.createDataFrame(rows, "seq_id string, locus string, marker string").distinct()
    want, before = {(r["i"], r["j"]): r["d"] for r in distance.wibs_pairs(calls).collect()}, open_cuts()
    own = distance.wibs_genotypes(calls)
    for sizes in ((128, 4096, 32), (16, 7, 5)):
        back = file_queries._matrix_back(spark, own, *sizes)
        assert {(r["i"], r["j"]): r["d"] for r in back.collect()} == pytest.approx(want, abs=1e-12) and back.count() == 50 * 49 // 2
        assert open_cuts() == before and "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
