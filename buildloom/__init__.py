"""Build-provenance analytics on Spark: declarative plans over property tables."""

__version__ = "0.1.0"
