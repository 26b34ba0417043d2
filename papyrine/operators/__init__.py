"""Relational operators: chunking, indexing, retrieval, reading, generation, agreement."""
