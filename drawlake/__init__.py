"""Draw-history analytics as Spark DataFrame operators."""
