"""Posting analytics on Spark: readers, text facts, ranking, merging and a stage machine as DataFrame plans."""
