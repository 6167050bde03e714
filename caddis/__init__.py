"""Caddis: catalogue enrichment, entity matching and data preparation on PySpark DataFrames."""
