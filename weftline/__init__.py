"""weftline: a Spark-native analytics engine.

Operators are plain functions that take and return DataFrames.  Catalyst and
adaptive execution choose the physical plan; the package only declares it.
"""

__version__ = "0.1.0"
