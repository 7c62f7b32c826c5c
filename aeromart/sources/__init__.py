"""Readers and writers: Parquet, CSV, JDBC, name normalisation, test-data views."""
