"""millrace: web-lead analytics and text-corpus preparation as Spark jobs."""
