"""The registry of queries and their oracles."""
