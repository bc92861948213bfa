"""sources of the ledger engine."""
