"""Types, literals and expressions of statements as Spark columns."""
