"""Sources: JSON catalogs, change lines, rules, and the choice among candidate sources."""
