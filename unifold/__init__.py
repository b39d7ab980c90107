"""unifold: a Spark-native engine that unifies person profiles from many sources."""

__version__ = "0.1.0"
