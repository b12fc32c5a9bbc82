"""harrow: web-collection analytics as plain PySpark DataFrame jobs."""
