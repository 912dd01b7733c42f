"""Table quality checks, profiling and near-duplicate detection on Spark."""

from plumbline.operators.rules import Rule

__all__ = ["Rule"]
