"""Structured Streaming forms: in-order application of out-of-order tasks, per-height commits, maintenance."""
