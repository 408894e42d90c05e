"""Residua: sequence, residue-graph and corpus analytics as Spark DataFrame plans."""
