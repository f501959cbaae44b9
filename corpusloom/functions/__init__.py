"""Functions from Columns to Columns."""
