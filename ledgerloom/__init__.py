"""Spark-native analytics over ordered batches of reads and writes and their verifiable log."""
