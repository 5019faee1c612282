"""Market-intelligence and training-data analytics as PySpark jobs."""
