"""cribra: DataFrame-in, DataFrame-out operators for building text corpora with Spark."""

__version__ = "0.1.0"
