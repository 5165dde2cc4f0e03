"""File-to-file batch jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from freqloom.operators.sites import SiteTable
from freqloom.sources.tables import load_sites, save_sites, save_spectrum
from freqloom.sources.text import read_ind2pop
from freqloom.sources.vcf import read_vcf
from freqloom.sources.warehouse import block_spectrum, put_part


def vcf_job(
    spark: SparkSession, vcf: str | list[str], ind2pop: str, out: str, bed: str | None = None, no_aa: bool = False,
    outgroup: str | None = None, info_aa_field: str = "AA",
) -> None:
    """VCF files to a site-table folder."""
    save_sites(_vcf_sites(spark, vcf, ind2pop, bed, no_aa, outgroup, info_aa_field), out)


def _vcf_sites(
    spark: SparkSession, vcf: str | list[str], ind2pop: str, bed: str | None, no_aa: bool, outgroup: str | None, info_aa_field: str
) -> SiteTable:
    if no_aa and outgroup:
        raise ValueError("choose either no_aa or an outgroup")
    # One row per sample column of the VCF header.
    samples = {row.sample: row.pop for row in read_ind2pop(spark, ind2pop).collect()}
    ancestral: bool | str = False if no_aa else (outgroup or True)
    return read_vcf(spark, vcf, samples, bed, ancestral, info_aa_field)


def add_vcf_job(
    spark: SparkSession, vcf: str | list[str], ind2pop: str, warehouse: str, part: str, bed: str | None = None, no_aa: bool = False,
    outgroup: str | None = None, info_aa_field: str = "AA",
) -> None:
    """VCF files (a chromosome, say) to one part of a warehouse; other parts are not touched."""
    put_part(_vcf_sites(spark, vcf, ind2pop, bed, no_aa, outgroup, info_aa_field), warehouse, part)


def warehouse_spectrum_job(spark: SparkSession, out: str, n_blocks: int, warehouse: str) -> None:
    """All parts of a warehouse to the spectrum of ``n_blocks`` equal blocks."""
    save_spectrum(block_spectrum(spark, warehouse, n_blocks), out)


def concatenate_job(spark: SparkSession, inputs: list[str], out: str) -> None:
    """Several site-table folders to one."""
    save_sites(SiteTable.concatenate([load_sites(spark, p) for p in inputs]), out)


def extract_spectrum_job(spark: SparkSession, out: str, n_blocks: int, inputs: list[str]) -> None:
    """Site-table folders to the spectrum of ``n_blocks`` equal blocks."""
    save_spectrum(SiteTable.concatenate([load_sites(spark, p) for p in inputs]).extract_blocks(n_blocks), out)
