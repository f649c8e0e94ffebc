"""A Spark-native pipeline for job postings: sources, matching, freshness, structuring and serving."""
