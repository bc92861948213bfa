"""functions of the ledger engine."""
