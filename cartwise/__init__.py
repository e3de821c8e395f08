"""Product recommendations from shop clickstream events, as Spark DataFrame jobs."""
