"""The engine's operators on the given order tables, and the same results in plain SQL."""
