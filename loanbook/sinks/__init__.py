"""Where results go: the partitioned loan table and exported files."""
