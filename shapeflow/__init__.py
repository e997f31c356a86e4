"""Traffic-shape analytics and text-corpus jobs on Spark."""
