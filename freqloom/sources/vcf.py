"""VCF text to allele counts, one narrow pass without a shuffle.

The genotypes of a site sit in one line, so each line is counted where it is read: the sample columns of a population are
picked by position and their allele characters counted. Only a BED restriction adds a join.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freqloom.functions.configs import quoted
from freqloom.operators.calls import is_biallelic, polarise, populations_of, site_table
from freqloom.operators.regions import region_length, within_regions
from freqloom.operators.sites import SiteTable
from freqloom.sources.text import read_bed

FIRST_SAMPLE_COLUMN = 9


def sample_columns(header: str, ind2pop: Mapping[str, str]) -> dict[str, list[int]]:
    """Column numbers of each population's samples; every mapped sample must be in the header."""
    columns = {name: i for i, name in enumerate(header.rstrip("\n").split("\t")) if i >= FIRST_SAMPLE_COLUMN}
    absent = sorted(set(ind2pop) - set(columns))
    if absent:
        raise ValueError(f"samples without a column in the VCF header: {absent[:10]}")
    out: dict[str, list[int]] = {p: [] for p in populations_of(ind2pop)}
    for sample, pop in ind2pop.items():
        out[pop].append(columns[sample])
    return out


def parse_records(lines: DataFrame, header: str, ind2pop: Mapping[str, str], info_aa_field: str = "AA") -> DataFrame:
    """Biallelic records of ``lines(value)``: ``chrom_id, position, ref, alt, aa, n0, n1``.

    A ``#CHROM`` line other than ``header`` raises: lines of files with other sample orders are a call of their own.
    """
    by_pop = sample_columns(header, ind2pop)
    same = f"if(value = {quoted(header.rstrip(chr(10)))}, false, raise_error('VCF files with different headers must be read separately'))"
    keep = f"case when startswith(value, '#CHROM') then {same} else not startswith(value, '#') and value <> '' end"
    # ALT is read from the first columns; only lines that stay are split, once: later filters on the parsed fields cannot
    # be pushed below a generator, so they do not repeat the split.
    alt = "substring_index(substring_index(value, '\\t', 5), '\\t', -1)"
    split_once = "inline(array(struct(split(substring_index(value, '\\t', 9), '\\t') as h, split(value, '\\t') as f)))"
    fields = lines.where(F.expr(keep)).where(is_biallelic(alt)).selectExpr(split_once)
    genotypes = [
        f"if(h[8] = 'GT' or startswith(h[8], 'GT:'), array_join(transform(array({', '.join(map(str, cols))}),"
        f" i -> substring_index(f[i], ':', 1)), '/'), '') as g{k}"
        for k, cols in enumerate(by_pop.values())
    ]
    aa = f"nullif(regexp_extract(concat(';', h[7], ';'), {quoted(f';{re.escape(info_aa_field)}=([^;]*);')}, 1), '')"
    texts = fields.selectExpr("h[0] as chrom_id", "double(h[1]) as position", "h[3] as ref", "h[4] as alt", f"{aa} as aa", *genotypes)
    side = lambda allele: ", ".join(
        f"length(g{k}) - length(replace(g{k}, '{allele}', ''))" for k in range(len(by_pop))
    )
    return texts.selectExpr(
        "chrom_id", "position", "ref", "alt", "aa", f"array({side(0)}) as n0", f"array({side(1)}) as n1"
    )


def sites_from_lines(
    lines: DataFrame,
    header: str,
    ind2pop: Mapping[str, str],
    ancestral_alleles: bool | str = True,
    info_aa_field: str = "AA",
    bed: DataFrame | None = None,
) -> SiteTable:
    """Site table from VCF lines; see :func:`read_vcf`."""
    return _sites(parse_records(lines, header, ind2pop, info_aa_field), ind2pop, ancestral_alleles, bed)


def _sites(records: DataFrame, ind2pop: Mapping[str, str], ancestral_alleles: bool | str, bed: DataFrame | None) -> SiteTable:
    if bed is not None:
        records = within_regions(records, bed, "length(ref)")
    pops = populations_of(ind2pop)
    length = None if bed is None else region_length(bed)
    return site_table(polarise(records, pops, ancestral_alleles), pops, ancestral_alleles, length)


def read_vcf(
    spark: SparkSession,
    paths: str | list[str],
    ind2pop: Mapping[str, str],
    bed_path: str | None = None,
    ancestral_alleles: bool | str = True,
    info_aa_field: str = "AA",
) -> SiteTable:
    """Allele counts at the biallelic SNPs of VCF text files.

    ``ind2pop`` maps samples to populations and is no wider than a header line. ``ancestral_alleles`` is True (INFO
    field, sites without it are excluded), False (REF, and the spectrum is folded) or the name of an outgroup
    population. With a BED file only its intervals are kept and their summed length is the data length.

    Files may list their samples in different orders and have others besides; each must have all mapped samples. Files
    that share a header line are read together, so several headers mean as many scans, of their own files only.
    """
    lines = spark.read.text(paths)
    bed = None if bed_path is None else read_bed(spark, bed_path)
    headers = file_headers(lines)
    read = [parse_records(lines if len(headers) == 1 else spark.read.text(files), header, ind2pop, info_aa_field) for header, files in headers.items()]
    return _sites(reduce(DataFrame.unionByName, read), ind2pop, ancestral_alleles, bed)


def file_headers(lines: DataFrame) -> dict[str, list[str]]:
    """Files by their ``#CHROM`` line. A file that has one begins with ``#``, and it is near the start, so one or two short jobs
    per file read its first partition; files are asked for a few at a time. Files without it, as the later parts of a
    folder, go with the one header that the others have."""
    spark, files = lines.sparkSession, sorted(lines.inputFiles())

    def header(file: str) -> str | None:
        text = spark.read.text(file)
        top = text.take(1)
        if not top or not top[0].value.startswith("#"):
            return None
        found = text.where("startswith(value, '#CHROM')").take(1)
        return found[0].value.rstrip("\n") if found else None

    with ThreadPoolExecutor(8) as pool:
        by_file = dict(zip(files, pool.map(header, files), strict=True))
    headers: dict[str, list[str]] = {h: [] for h in by_file.values() if h is not None}
    if not headers:
        raise ValueError("no #CHROM header line")
    bare = [f for f, h in by_file.items() if h is None]
    if bare and len(headers) > 1:
        raise ValueError(f"no #CHROM header line in {bare[0]}, and the other files have several")
    for file, line in by_file.items():
        headers[line or next(iter(headers))].append(file)
    return headers
