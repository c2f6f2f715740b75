"""shapeloom: labelled time-series windows, shapelet dictionaries and drift analytics on PySpark."""

__version__ = "0.1.0"
