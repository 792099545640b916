"""loomdex: indexing, search and text processing for source code and documents on Spark."""
