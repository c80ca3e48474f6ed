"""Relational and decision operators over DataFrames."""
