"""Compositions of operators: feature, graph, alert and report plans."""
