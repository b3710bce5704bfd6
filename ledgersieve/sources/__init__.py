"""Reading, standardising and writing ledgers."""
