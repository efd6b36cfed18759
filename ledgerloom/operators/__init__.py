"""DataFrame operators of the ledger: access sets, scheduling, state, the log store, hash trees, admission, workloads, metrics."""
