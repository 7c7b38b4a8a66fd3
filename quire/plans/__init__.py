"""End-to-end jobs (search, discovery, corpus build) and the query registry."""
