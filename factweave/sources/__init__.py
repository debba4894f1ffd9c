"""Table access, ledger sinks and the answer cache."""
