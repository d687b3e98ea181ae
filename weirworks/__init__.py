"""DataFrame operators for building, checking and watching data pipelines on Spark."""
