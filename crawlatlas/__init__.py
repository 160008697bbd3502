"""Web-crawl analytics on Spark: logs, configuration, frontier and archive jobs."""
