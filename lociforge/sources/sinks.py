"""Writers of sheets, sequences, matrices and cluster labels; each writes a folder of part files unless told ``single``."""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.session import Cut


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = True, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, sep=sep, header=header)


def _quoted(text: str, sep: str) -> str:
    return '"' + text.replace('"', '\\"') + '"' if any(c in text for c in (sep, '"', "\n", "\r")) else text


def _write_lines(cells: DataFrame, rows: DataFrame, names: list[str], path: str, sep: str, corner: str, blank: str, single: bool, cut: Cut) -> None:
    """A wide table as text: of cells ``(i, j, d)`` a line for each ``i`` of ``rows``, sorted, and a place for each ``j`` of the sorted ``names``.

    Only the names are held as a whole; no plan has a column for each. Every file begins with the header.
    """
    spark = cells.sparkSession
    places = spark.createDataFrame(pa.table({"j": pa.array(names, pa.string()), "at": pa.array(range(len(names)), pa.int32())}))
    placed = cells.join(places, "j").select("i", "at", F.col("d").cast("string").alias("d"))
    # the first of each row's cells is its own, so that rows without cells have a line too
    placed = cut.write(placed.unionByName(rows.select("i", F.lit(-1).alias("at"), F.lit(None).cast("string").alias("d"))))
    placed = placed.coalesce(1).sortWithinPartitions("i", "at") if single else placed.repartitionByRange("i").sortWithinPartitions("i", "at")
    shared = spark.sparkContext.broadcast(sep.join([corner, *(_quoted(n, sep) for n in names)]))
    n = len(names)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, row = None, None
        begun = False
        for batch in batches:
            for i, at, d in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun:
                    begun = True
                    yield pa.RecordBatch.from_arrays([pa.array([shared.value])], names=["value"])
                if i != name:
                    if row is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([sep.join([_quoted(name, sep), *row])])], names=["value"])
                    name, row = i, [blank] * n
                if at >= 0:
                    row[at] = d
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sep.join([_quoted(name, sep), *row])])], names=["value"])

    placed.mapInArrow(lines, "value string").write.mode("overwrite").option("extension", "csv").text(path)
    cut.close()


def write_sheet(calls: DataFrame, path: str, specimens: DataFrame | None = None, single: bool = False) -> None:
    """The sheet of ``presence_sheet``, of any number of markers: ``Seq_ID`` and a cell for each, ``X`` or empty."""
    cut = Cut(calls.sparkSession)
    own = cut.write(calls.select(F.col("seq_id").alias("i"), F.col("marker").alias("j")).distinct())
    rows = own.select("i") if specimens is None else own.select("i").union(specimens.select("seq_id"))
    names = [r[0] for r in own.select("j").distinct().orderBy("j").collect()]
    _write_lines(own.withColumn("d", F.lit("X")), cut.write(rows.distinct()), names, path, "\t", "Seq_ID", "", single, cut)


def write_fasta(records: DataFrame, path: str, name: str = "marker") -> None:
    """``>name`` and sequence lines in the order of the names, in files that ``read_contigs`` takes for FASTA."""
    lines = records.select(name, "sequence").orderBy(name).select(F.explode(F.array(F.concat(F.lit(">"), F.col(name)), F.col("sequence"))))
    lines.write.mode("overwrite").option("extension", "fna").csv(path, sep="\u0001", header=False, quote="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_fastq(reads: DataFrame, path: str) -> None:
    reads.select(F.concat(F.lit("@"), F.col("header"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), F.col("qual"))).write.mode("overwrite").text(path)


def write_matrix(pairs: DataFrame, path: str, single: bool = False) -> None:
    """The square matrix with row names, 0 where no pair is given; each line is made from its own cells, whatever their number."""
    cut = Cut(pairs.sparkSession)
    ids = cut.write(pairs.select("i").union(pairs.select("j")).distinct())
    names = [r[0] for r in ids.orderBy("i").collect()]
    both = pairs.select("i", "j", "d").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    _write_lines(both, ids, names, path, ",", "i", "0.0", single, cut)


def write_matrix_part(file: BinaryIO, names: list[str], rows: list[str], d: np.ndarray) -> None:
    """Some lines of ``write_matrix`` as a file of their own: the header of all ``names``, and the cells ``d`` of ``rows``."""
    file.write((",".join(["i", *(_quoted(n, ",") for n in names)]) + "\n").encode())
    cells = pa.array(np.ascontiguousarray(d).ravel()).cast(pa.string())
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(names), pa.int32()), cells), ",")
    for name, line in zip(rows, lines):
        file.write(f"{_quoted(name, ',')},".encode())
        file.write(line.as_buffer())
        file.write(b"\n")


def write_clusters(labels: DataFrame, path: str, single: bool = False) -> None:
    """``Seq_ID`` and ``Assigned_cluster``."""
    write_table(labels.select(F.col("seq_id").alias("Seq_ID"), F.col("label").alias("Assigned_cluster")).orderBy("Seq_ID"), path, single=single)
