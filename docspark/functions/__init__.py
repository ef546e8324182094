"""Column -> Column helpers built on native Spark expressions."""
