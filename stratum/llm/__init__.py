"""Operators for training-data pipelines over the documents, pages, labels and conversations tables."""
