"""Operators over blocks, chunks, terms, postings and logs; each takes and returns DataFrames."""
