"""operators of the ledger engine."""
