"""From statements to DataFrames: parser, transactions, session, shell."""
