"""Event analytics as Spark DataFrame plans."""
