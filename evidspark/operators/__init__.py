"""Retrieval, structure, answer and quality operators over DataFrames."""
