"""Claims catalog and docket-survival analytics as Spark DataFrame jobs."""
