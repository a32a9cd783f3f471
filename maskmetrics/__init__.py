"""Mask metrics on Spark: instance tables, shape and colour features, per-image and per-run results."""
