"""Block headers kept up to date from a stream of rows."""
