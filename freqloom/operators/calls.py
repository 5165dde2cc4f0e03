"""From genotype calls to polarised allele counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freqloom.functions.configs import quoted
from freqloom.operators.sites import SiteTable


def map_samples(calls: DataFrame, ind2pop: DataFrame) -> DataFrame:
    """Calls of mapped samples with their population; others are dropped."""
    return calls.join(ind2pop, "sample")


def unmapped_samples(calls: DataFrame, ind2pop: DataFrame) -> DataFrame:
    """Samples of ``ind2pop`` that never occur in ``calls``; empty when the sample sets agree."""
    return ind2pop.select("sample").join(calls.select("sample").distinct(), "sample", "left_anti")


def count_alleles(calls: DataFrame, keys: Sequence[str], pops: Sequence[str]) -> DataFrame:
    """``keys`` plus arrays ``n0`` and ``n1``: calls of allele 0 and 1 per population, missing calls ignored.

    One hash aggregation with map-side combine; populations without a call get zeros.
    """
    side = lambda allele: F.array(
        *[F.expr(f"int(count_if(pop = {quoted(p)} and allele = {allele}))") for p in pops]
    )
    return calls.groupBy(*keys).agg(side(0).alias("n0"), side(1).alias("n1"))


def is_biallelic(alt: str = "alt") -> str:
    return f"({alt} <> '.' and instr({alt}, ',') = 0)"


def ancestral_allele_text(ancestral: bool | str, pops: Sequence[str]) -> str:
    """0 or 1, null when the site must be excluded.

    ``True``: the ``aa`` column equals REF or ALT. A population name: its calls agree on one allele. ``False``: REF.
    """
    if ancestral is True:
        return "case when aa = ref then 0 when aa = alt then 1 end"
    if ancestral is False:
        return "0"
    k = list(pops).index(ancestral)
    return f"case when (n0[{k}] > 0) <> (n1[{k}] > 0) then if(n0[{k}] > 0, 0, 1) end"


def polarise(counts: DataFrame, pops: Sequence[str], ancestral: bool | str) -> DataFrame:
    """Adds ``ancestral_allele``, ``anc`` and ``der``; an outgroup's own counts are left out of both arrays."""
    keep = [i for i, p in enumerate(pops) if p != ancestral]
    pick = lambda side: "array(" + ", ".join(f"{side}[{i}]" for i in keep) + ")"
    marked = counts.withColumn("ancestral_allele", F.expr(ancestral_allele_text(ancestral, pops)))
    return marked.withColumns({
        "anc": F.expr(f"if(ancestral_allele = 1, {pick('n1')}, {pick('n0')})"),
        "der": F.expr(f"if(ancestral_allele = 1, {pick('n0')}, {pick('n1')})"),
    })


def accounting_of(polarised: DataFrame, length: DataFrame | None = None) -> DataFrame:
    """Kept and excluded SNPs in one aggregate, next to the data length where it is known."""
    counted = polarised.selectExpr(
        "cast(null as double) as length", "count_if(ancestral_allele is not null) as n_read",
        "count_if(ancestral_allele is null) as n_excluded",
    )
    if length is None:
        return counted
    both = counted.unionByName(length.selectExpr("double(length) as length"), allowMissingColumns=True)
    return both.agg(F.max("length").alias("length"), F.max("n_read").alias("n_read"), F.max("n_excluded").alias("n_excluded"))


def site_table(
    polarised: DataFrame, pops: Sequence[str], ancestral: bool | str, length: DataFrame | None = None
) -> SiteTable:
    """The kept sites as a table; populations in name order, the outgroup removed."""
    df = polarised.where("ancestral_allele is not null").selectExpr(
        "string(chrom_id) as chrom_id", "double(position) as position", "anc", "der"
    )
    kept = tuple(p for p in pops if p != ancestral)
    return SiteTable(df, kept, accounting_of(polarised, length), (), ancestral is False)


def populations_of(ind2pop: Mapping[str, str]) -> list[str]:
    """Distinct populations sorted by name: the order of the count arrays."""
    return sorted(set(ind2pop.values()))
