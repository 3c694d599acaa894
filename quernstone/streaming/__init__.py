"""Nothing streams: the statements that this engine takes have no long-running form."""
