"""Document analytics on Spark: DataFrame functions, one module per operator family."""
