"""Column functions: text identity, numerals, key policy, panel geometry."""
