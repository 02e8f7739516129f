"""Spark-native analytics for wide sparse measurement tables labelled against a hierarchical vocabulary."""
