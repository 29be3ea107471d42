"""Operators over paired text corpora: DataFrame in, DataFrame out."""
