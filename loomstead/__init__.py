"""Event-study panel analytics and table hygiene on PySpark DataFrames."""

__version__ = "0.1.0"
