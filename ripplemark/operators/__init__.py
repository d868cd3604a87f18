"""Operators from DataFrame to DataFrame: graph, changes, scanning, retrieval, evaluation."""
