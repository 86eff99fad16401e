"""tidegate: decision analytics as Spark DataFrame operators."""
