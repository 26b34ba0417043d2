"""Column-to-Column functions; nothing in here triggers a job."""
