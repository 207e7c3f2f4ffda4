"""weft: Spark-native preparation and scoring of language-model data.

Subpackages: ``sources`` (scans/sinks), ``functions`` (column expressions),
``operators`` (DataFrame-in/DataFrame-out jobs), ``plans`` (driver bindings
and composite jobs), ``streaming`` (Structured Streaming jobs).
"""
__version__ = "0.1.0"
