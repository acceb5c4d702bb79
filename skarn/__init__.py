"""skarn: time-series event mining, interval fusion and training-data preparation on PySpark."""

__version__ = "0.1.0"
