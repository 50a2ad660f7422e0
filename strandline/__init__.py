"""strandline: aligning, fusing, cleaning and scoring time-series and relational data on Spark."""

__version__ = "0.1.0"
