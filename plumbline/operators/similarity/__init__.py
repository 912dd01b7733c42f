"""Near-duplicate detection on distinct values."""

from plumbline.operators.similarity.pipeline import NearDuplicates, near_duplicates

__all__ = ["NearDuplicates", "near_duplicates"]
