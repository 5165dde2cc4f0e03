"""VCF text that keeps arriving: the same parsing as a stream, for files added to a folder.

Parsing and polarisation look at one line at a time, so they need no state or watermark. Sites are appended to Parquet by the
file sink, which counts each input file once. Configuration counts are kept as a running aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from freqloom.operators.calls import polarise, populations_of
from freqloom.sources.vcf import parse_records


def arriving_sites(
    spark: SparkSession, folder: str, header: str, ind2pop: Mapping[str, str], ancestral_alleles: bool | str = True,
    info_aa_field: str = "AA",
) -> DataFrame:
    """Streaming ``(chrom_id, position, anc, der)`` from the VCF files of ``folder``; all carry the same ``header``."""
    lines = spark.readStream.text(folder)
    records = parse_records(lines, header, ind2pop, info_aa_field)
    kept = polarise(records, populations_of(ind2pop), ancestral_alleles).where("ancestral_allele is not null")
    return kept.select("chrom_id", "position", "anc", "der")


def append_sites(sites: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write everything that has arrived to Parquet and stop; run again for what arrives later."""
    writer = sites.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def running_config_counts(sites: DataFrame) -> DataFrame:
    """Streaming ``(anc, der, n_sites)``; its state holds one row per distinct configuration."""
    return sites.groupBy("anc", "der").agg(F.count(F.lit(1)).alias("n_sites"))
