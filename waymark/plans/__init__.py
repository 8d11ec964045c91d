"""Query catalogue: named queries over the test tables and their SQL twins."""
