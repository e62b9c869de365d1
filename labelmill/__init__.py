"""labelmill: label-data pipelines on Spark DataFrames.

Import rows, apply label changes as an append-only history, measure label
quality, split and export training data, and derive labeller presence.
"""
