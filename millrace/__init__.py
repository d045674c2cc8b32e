"""millrace: cleaning, deduplicating and searching large text corpora on Spark."""
