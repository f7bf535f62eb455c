"""tracelex: traceable text features as Spark DataFrame operators."""
