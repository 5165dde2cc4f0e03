"""Allele-count analytics on Spark: sites, joint site frequency spectra, statistics and model scoring."""

from freqloom.operators.sites import SiteTable
from freqloom.operators.spectrum import Spectrum
from freqloom.operators.stats import SpectrumStats

__all__ = ["SiteTable", "Spectrum", "SpectrumStats"]
