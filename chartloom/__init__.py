"""Chart analytics on Spark: documents, search, change sets, scoring and cohort statistics as DataFrame jobs."""
