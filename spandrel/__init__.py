"""Code-graph analytics and corpus preparation as Spark jobs."""
