"""Building blocks for large groups and the end-to-end report jobs."""
