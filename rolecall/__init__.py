"""Job-posting analytics on Spark: merge, derive, score, filter, sort and report."""
