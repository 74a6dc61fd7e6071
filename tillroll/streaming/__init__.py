"""The row-local cleaning operators applied to streaming DataFrames."""
