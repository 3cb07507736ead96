"""A log store and search engine on Spark: day-partitioned, stream-sorted Parquet behind a published manifest."""
