"""Usage, quota and cost analytics as PySpark jobs."""
