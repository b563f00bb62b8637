"""Constraint-graph analytics over Markdown corpora, expressed as Spark DataFrames."""
