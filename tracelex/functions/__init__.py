"""tracelex.functions"""
