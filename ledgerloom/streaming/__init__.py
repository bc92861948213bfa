"""streaming of the ledger engine."""
