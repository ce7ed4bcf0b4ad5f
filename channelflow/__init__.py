"""Multichannel state-sequence analytics on Spark DataFrames."""
