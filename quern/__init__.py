"""quern: session analytics and corpus processing as Spark jobs."""
