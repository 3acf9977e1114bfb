"""Operators for training-data pipelines over text documents (see :mod:`weft.llm.queries`)."""
