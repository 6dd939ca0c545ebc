"""tidelog: versioned logs, operation replay, graphs and sketches as Spark jobs."""
