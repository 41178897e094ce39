"""Readers of sequence, call, sheet, matrix and label files as DataFrames."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociforge.functions.names import norm_name
from lociforge.operators.ordering import numbered

FASTA_SUFFIX = r"(?i)\.(fasta|fa|fna)(\.gz)?$"
SKIPPED_REFERENCES = ["Illumina", "MAPPING"]
NOT_CALLS = r"(?i)(^|/)\.[^/]*$|\.(pdf|sh)$"


def _stem(path: Column) -> Column:
    """The file's name without its last suffix, and without ``.gz`` before."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(F.regexp_replace(name, r"\.gz$", ""), r"\.[^.]*$", "")


def _one_slash(path: str) -> Column:
    """``file:///a`` as ``file:/a``, as listings and rows write local paths differently."""
    return F.regexp_replace(path, "^file:/+", "file:/").alias("path")


def read_fasta(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``(path, pos, header, sequence)``: the records of FASTA files (plain or gz), sequences joined and upper-case.

    Records are split by the reader at a line that begins with ``>``, so a large file is read by many tasks. ``pos`` is
    the record's place in the order of its file's splits. A path without files raises.
    """
    reader = spark.read.option("lineSep", "\n>")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return _fasta_records(reader.text(path).select(F.col("_metadata.file_path").alias("path"), "value"))


def _fasta_records(parts: DataFrame) -> DataFrame:
    """``(path, pos, header, sequence)`` of ``(path, value)``, the text of one record each."""
    raw = parts.select("path", F.regexp_replace("value", r"^>", "").alias("v")).withColumn("pos", F.monotonically_increasing_id())
    lines = F.split(F.regexp_replace("v", "\r", ""), "\n")
    return raw.select("path", "pos", F.btrim(F.get(lines, F.lit(0))).alias("header"), F.upper(F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.btrim(x)), "")).alias("sequence")).filter("header <> ''")


def sequence_map(records: DataFrame, whole_header: bool = False) -> DataFrame:
    """``(seq_name, sequence)``: the first word of each header, or all of it; of repeated names the last record counts."""
    name = F.col("header") if whole_header else F.get(F.split("header", r"\s+"), F.lit(0))
    return records.withColumn("seq_name", name).groupBy("seq_name").agg(F.max_by("sequence", "pos").alias("sequence"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """``(ref_ord, marker, sequence)`` of a file, or of all FASTA files under a folder but mapping ones."""
    own = read_fasta(spark, path, recursive=True)
    for word in SKIPPED_REFERENCES:
        own = own.filter(~F.col("path").contains(word))
    named = own.withColumn("marker", norm_name(F.get(F.split("header", r"\s+"), F.lit(0)))).filter("sequence <> ''")
    panel = named.groupBy("marker").agg(F.min(F.struct("path", "pos")).alias("_at"), F.max_by("sequence", F.struct("path", "pos")).alias("sequence"))
    return numbered(panel, ["_at"], "ref_ord", start=1).select("ref_ord", "marker", "sequence")


def read_marker_sequences(spark: SparkSession, path: str) -> DataFrame:
    """``(marker, sequence)`` for the sequence metric: the normalised whole header of each record names its marker."""
    own = read_fasta(spark, path, recursive=True)
    for word in SKIPPED_REFERENCES:
        own = own.filter(~F.col("path").contains(word))
    return sequence_map(own.filter("sequence <> ''").withColumn("header", norm_name(F.col("header"))), whole_header=True).withColumnRenamed("seq_name", "marker")


def read_contigs(spark: SparkSession, path: str, min_letters: int = 20) -> DataFrame:
    """``(seq_id, locus_hint, sequence, ord)`` from assembled contigs.

    ``sample|locus`` headers name both; ``a_b_contigN`` and ``…hap…`` headers name the sample before the last ``_``;
    others, and those that begin with ``read``, belong to the file's stem. FASTA members of zip files count as files.
    Raises if no record is found.
    """
    own = read_fasta(spark, path, recursive=True).filter(F.col("path").rlike(FASTA_SUFFIX))
    zipped = read_archived(spark, path).filter(F.col("content").rlike(r"(?m)^>")).select(F.concat_ws("/", "archive", "member").alias("path"), F.explode(F.split("content", r"\r?\n(?=>)")).alias("value"))
    # numbered apart, so that no two records have one number
    own = own.unionByName(_fasta_records(zipped.filter(F.col("value").startswith(">"))).withColumn("pos", -1 - F.col("pos")))
    parts, tokens = F.split("header", r"\|"), F.split("header", "_")
    piped = F.size(parts) > 1
    last = F.lower(F.element_at(tokens, -1))
    routed = (F.size(tokens) > 1) & (last.startswith("contig") | last.contains("hap"))
    sample = F.when(F.lower("header").startswith("read"), _stem(F.col("path"))).when(piped, F.btrim(F.get(parts, F.lit(0)))).when(routed, F.array_join(F.slice(tokens, 1, F.size(tokens) - 1), "_")).otherwise(_stem(F.col("path")))
    out = own.select(sample.alias("seq_id"), F.when(piped, F.btrim(F.get(parts, F.lit(1)))).alias("locus_hint"), "sequence", F.col("pos").alias("ord")).filter(F.length("sequence") >= min_letters)
    if out.isEmpty():
        raise ValueError(f"no contigs in {path}")
    return out


def read_archived(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, member, content)``: the text members of zip files, but folders, dotfiles and ``__MACOSX``."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        name = info.filename
                        if info.is_dir() or "__MACOSX" in name or name.rsplit("/", 1)[-1].startswith("."):
                            continue
                        yield pd.DataFrame({"archive": [archive], "member": [name], "content": [z.read(info).decode("utf-8", "ignore")]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(members, "archive string, member string, content string")


def read_call_lists(spark: SparkSession, path: str, background: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(specimens, calls)``: ``(seq_id)`` of all files, also empty ones, and distinct ``(seq_id, marker)``.

    A file's stem is its specimen and each line's first tab-separated field a marker. Dotfiles, PDFs and scripts are
    skipped, zip members count as files. A specimen named twice, or also in ``background``, raises.
    """

    def listing(folder: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        # the reader passes over empty files, but its own listing has them
        listed = spark.createDataFrame([(x,) for x in files.inputFiles()], "path string")
        plain = (
            listed.select(_one_slash("path")).join(files.select(_one_slash("path"), F.decode("content", "UTF-8").alias("content")), "path", "left")
            .filter(~F.col("path").rlike(NOT_CALLS) & ~F.lower("path").endswith(".zip"))
            .select(_stem(F.col("path")).alias("seq_id"), F.coalesce("content", F.lit("")).alias("content"))
        )
        return plain.unionByName(read_archived(spark, folder).select(_stem(F.col("member")).alias("seq_id"), "content"))

    own = listing(path)
    twice = own.groupBy("seq_id").count().filter("count > 1").select("seq_id").limit(5).collect()
    if background is not None:
        twice += own.select("seq_id").intersect(listing(background).select("seq_id")).limit(5).collect()
    if twice:
        raise ValueError("specimens named twice: " + ", ".join(r[0] for r in twice))
    lines = own.select("seq_id", F.explode(F.split("content", r"\r?\n")).alias("line"))
    calls = lines.select("seq_id", F.btrim(F.get(F.split("line", "\t"), F.lit(0))).alias("marker")).filter("marker <> ''").distinct()
    return own.select("seq_id"), calls


def holds_fasta(spark: SparkSession, path: str) -> bool:
    """Whether there is a FASTA file, plain or in a zip, at or under the path: then its files are contigs, not call lists."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").filter(F.col("path").rlike(FASTA_SUFFIX))
    return not names.isEmpty() or not read_archived(spark, path).filter(F.col("member").rlike(FASTA_SUFFIX)).isEmpty()


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def _fields(line: str, sep: str) -> list[str]:
    if '"' not in line:
        return line.split(sep)
    csv.field_size_limit(max(csv.field_size_limit(), len(line)))
    return next(csv.reader([line], delimiter=sep, escapechar="\\"))


def _cells(spark: SparkSession, path: str, sep: str, wanted: Callable[[str], bool]) -> DataFrame:
    """``(i, j, cell)`` of the wanted cells of a wide table whose files all begin with the same header; ``j`` is a column's name.

    Lines are parted in the tasks, so no plan has a column for each cell of a line.
    """
    lines = spark.read.text(path)
    first = lines.filter("value <> ''").first()
    if first is None:
        raise ValueError(f"no header in {path}")
    names = spark.sparkContext.broadcast((first[0], _fields(first[0].rstrip("\r"), sep)))

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        header, columns = names.value
        for batch in batches:
            for line in batch.column(0).to_pylist():
                if not line or line == header:
                    continue
                name, *cells = _fields(line.rstrip("\r"), sep)
                kept = [k for k, c in enumerate(cells[: len(columns) - 1]) if wanted(c)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(kept), pa.string()), pa.array([columns[k + 1] for k in kept], pa.string()), pa.array([cells[k] for k in kept], pa.string())], names=["i", "j", "cell"])

    return lines.mapInArrow(long, "i string, j string, cell string")


def read_sheet_calls(spark: SparkSession, path: str) -> DataFrame:
    """``(seq_id, marker)`` of a sheet's cells that hold ``X``; its first column names the specimens."""
    return _cells(spark, path, "\t", lambda c: c == "X").select(F.col("i").alias("seq_id"), F.col("j").alias("marker"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(i, j, d)``, i before j, from a square CSV whose first column names the rows."""
    return _cells(spark, path, ",", lambda c: c != "").filter("i < j").select("i", "j", F.expr("try_cast(cell as double)").alias("d")).filter("d is not null")


def read_matrix_part(file: BinaryIO) -> Iterator[pa.RecordBatch]:
    """``read_matrix`` of one file that ``write_matrix_part`` wrote: a batch for each line."""
    columns = pa.array(_fields(file.readline().decode().rstrip("\n"), ",")[1:], pa.string())
    for line in file:
        if line.startswith(b'"'):
            name, *cells = _fields(line.decode().rstrip("\n"), ",")
            cells = pa.array(cells, pa.string())
        else:
            first, _, rest = line.rstrip(b"\n").partition(b",")
            name, cells = first.decode(), pc.split_pattern(pa.array([rest.decode()]), ",").flatten()
        after = pc.greater(columns, name)
        j = columns.filter(after)
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name), len(j)), j, cells.filter(after).cast(pa.float64())], names=["i", "j", "d"])


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """``(seq_id, cluster_alias)``: the first two columns, parted by any white space; the first line of each file is a header."""
    own = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split(F.btrim("value"), r"\s+").alias("f"), (F.col("_metadata.file_block_start") == 0).alias("_first"), F.monotonically_increasing_id().alias("_n"))
    head = own.filter("_first").groupBy("path").agg(F.min("_n").alias("_h"))
    return own.join(head, "path").filter("_n <> _h and size(f) > 1").select(F.get("f", F.lit(0)).alias("seq_id"), F.get("f", F.lit(1)).alias("cluster_alias"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, rec_no, header, sequence, qual)`` of FASTQ files (plain or gz) of four-line records.

    Lines are numbered over a file's splits, so a large file is read by many tasks.
    """
    own = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.regexp_replace("value", "\r$", "").alias("line"), F.monotonically_increasing_id().alias("_n"))
    # a line's number in its file: its number in its split plus the lines of the file's splits before
    splits = own.groupBy("path", "_at").agg(F.count("*").alias("_c"), F.min("_n").alias("_first"))
    before = splits.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = own.join(F.broadcast(before), ["path", "_at"]).select("path", (F.col("_n") - F.col("_first") + F.col("_before")).alias("no"), "line")
    pick = lambda k: F.max(F.when(F.col("no") % 4 == k, F.col("line")))
    records = numbered.groupBy("path", F.floor(F.col("no") / 4).alias("rec_no")).agg(pick(0).alias("header"), pick(1).alias("sequence"), pick(3).alias("qual"))
    return records.select(_stem(F.col("path")).alias("sample_id"), "rec_no", F.regexp_replace("header", "^@", "").alias("header"), "sequence", F.coalesce("qual", F.lit("")).alias("qual")).filter("sequence is not null")
