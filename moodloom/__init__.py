"""Collection and mood analytics as Spark DataFrame operators."""
