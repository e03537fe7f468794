"""Business-table analytics as Spark jobs."""
