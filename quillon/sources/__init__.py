"""Collections on Parquet and importers."""
