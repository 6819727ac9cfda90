"""Dependency-style property graphs as Spark DataFrames: selectors compiled to
logical plans, closures, versions and ranges, and the reports built on them."""
