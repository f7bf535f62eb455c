"""tracelex.sources"""
