"""kelora: rail-reliability analytics as Spark DataFrame, SQL and streaming jobs."""
