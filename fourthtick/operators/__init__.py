"""Generic DataFrame operators: ranking, as-of join, key checks, row combination."""
