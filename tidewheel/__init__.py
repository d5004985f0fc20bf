"""Analytics over catalogues of time series and event streams, as Spark DataFrame operators."""

__version__ = "0.1.0"
