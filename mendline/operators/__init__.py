"""Operators over sales tables and block headers: DataFrame in, DataFrame out."""
