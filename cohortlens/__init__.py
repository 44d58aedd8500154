"""Point-in-time cohort, feature, evaluation, drift and discontinuity operators on Spark DataFrames."""

__version__ = "0.1.0"
