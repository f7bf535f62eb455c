"""tracelex.operators"""
