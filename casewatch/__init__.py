"""Public-health surveillance analytics as Spark DataFrame operators."""
