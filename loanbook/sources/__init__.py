"""Where loan data comes from: tape files, stored tables, test tables."""
