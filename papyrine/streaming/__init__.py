"""Row-local operators on unbounded input."""
