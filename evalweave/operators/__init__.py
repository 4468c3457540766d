"""DataFrame -> DataFrame operators; each takes grouping columns and stays lazy where it can."""
