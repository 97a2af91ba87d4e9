"""remedia: Spark-native analytics for program-repair pipelines."""

__version__ = "0.1.0"
