"""Operators over genes, graphs, matrices, sequences and trees; every one takes and returns DataFrames."""
