"""fixloom: a Spark-native curation engine for security-fix commit records."""

__version__ = "0.1.0"
