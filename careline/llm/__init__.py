"""Operators for preparing training data, and their queries (``careline.llm.queries``)."""
