"""Columnar analytics on Spark: fixed-width arithmetic, masks and row-id streams, sorting and runs, as DataFrame expressions."""
