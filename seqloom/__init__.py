"""Sequence analytics on Spark DataFrames: scans, causal features, mergeable scores, fits and streams."""

from seqloom.layout import FeatureLayout, SequenceSpec

__all__ = ["FeatureLayout", "SequenceSpec"]
