"""Column-in, column-out building blocks; everything stays inside Spark expressions."""
