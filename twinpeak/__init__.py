"""Twin-peak evidence engine: chiral LC / DIA-MS2 analysis as Spark jobs."""

from .params import ExtractionSettings, PairThresholds, PeakPickSettings

__all__ = ["ExtractionSettings", "PairThresholds", "PeakPickSettings"]
