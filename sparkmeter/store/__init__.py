"""Parquet tables of a store and the jobs that change them."""
