"""millrace: feed-digest analytics and corpus preparation as PySpark DataFrame programs."""
