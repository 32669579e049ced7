"""From filter strings and options to DataFrames."""
