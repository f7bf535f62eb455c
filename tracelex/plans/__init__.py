"""tracelex.plans"""
