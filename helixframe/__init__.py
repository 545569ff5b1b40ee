"""Analytics on collections of sequences and vectors."""
