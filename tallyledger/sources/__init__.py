"""Reading, canonicalizing and writing ledgers, balances and snapshots."""
