"""Tidemark: rewindable host and process history as Spark DataFrames."""
