"""Timed text (SubRip, WebVTT, ASS/SSA) as Spark DataFrames."""
