"""Melody search on Spark: pitch contours, packed tracks and subsequence DTW matching."""
