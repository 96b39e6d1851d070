"""Detection over tables of captured web pages, as DataFrame operations."""
