"""Text analytics over DataFrames."""
