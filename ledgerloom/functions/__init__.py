"""Column functions: hashes, bits, codecs, and order-dependent helpers."""
