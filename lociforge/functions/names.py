"""Column expressions for marker, locus and haplotype names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Allele suffixes of marker names, deleted in this order, and the length suffix that may then end a name; fixed values.
ALLELE_SUFFIXES = [r"_Hap_\d+", r"\.H\d+(_[A-F0-9]+)?", r"_H\d+(_[A-F0-9]+)?", r"_(NOVEL|novel)_\d+", r"\.X_\d+"]
LENGTH_SUFFIX = r"_L\d+bp$"
JUNCTION_LOCUS = "Mt_Cmt"


def parse_locus(name: Column) -> Column:
    """The locus of a marker column name; junction markers all belong to ``Mt_Cmt``."""
    out = F.btrim(name, F.lit(" \t\r\n"))
    for pattern in [*ALLELE_SUFFIXES, LENGTH_SUFFIX, "_+$"]:
        out = F.regexp_replace(out, pattern, "")
    junction = out.contains("Junction") | (out.contains("Mt_") & out.contains("Cmt"))
    return F.when(junction, F.lit(JUNCTION_LOCUS)).otherwise(out)


def norm_name(name: Column) -> Column:
    """The text after the last ``.``, with ``-`` read as ``_``, trimmed."""
    return F.btrim(F.translate(F.substring_index(name, ".", -1), "-", "_"))


def content_hash(sequence: Column, length: int = 4) -> Column:
    """The first characters of the upper-case MD5 of the trimmed, upper-case sequence."""
    return F.upper(F.substring(F.md5(F.upper(F.btrim(sequence, F.lit(" \t\r\n")))), 1, length))


def haplotype_id(locus: Column, sequence: Column, rank: Column, include_length: bool = True, include_hash: bool = True) -> Column:
    """``<Locus>_L<len>bp.H<rank>[_<hash>]``: the name of a haplotype found without a reference."""
    parts = [F.translate(F.btrim(locus), " ", "_")]
    if include_length:
        parts.append(F.format_string("_L%dbp", F.length(sequence)))
    parts.append(F.format_string(".H%02d", rank))
    if include_hash:
        parts += [F.lit("_"), content_hash(sequence, 4)]
    return F.concat(*parts)


def clean_locus_hint(hint: Column) -> Column:
    """The part before ``_Hap_``, then before the first ``.``, trimmed."""
    return F.btrim(F.substring_index(F.substring_index(hint, "_Hap_", 1), ".", 1))


def junction_id(specimen: Column, length: Column) -> Column:
    """The marker of an assembled junction; 43 letters of primer are added to its length."""
    return F.format_string("Mt_Cmt%d.X_Junction_Hap_%s", length + 43, specimen)


def ploidy_of(locus: Column, ploidy: int | dict[str, int] | None = None) -> Column:
    """Ploidy of a locus: a number for all, by name (others 2), or 1 for mitochondrial loci and else 2."""
    if ploidy is None:
        return F.when(F.upper(locus).startswith("MT"), F.lit(1)).otherwise(F.lit(2))
    if isinstance(ploidy, dict):
        out = F.lit(2)
        for name, n in ploidy.items():
            out = F.when(locus == name, F.lit(int(n))).otherwise(out)
        return out
    return F.lit(int(ploidy))
