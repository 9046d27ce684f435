"""Operators of a training-data pipeline.

Nothing outside this package imports it. Every operator takes DataFrames and column
names, keeps its own general interface, and is registered as a query in
``quern.llm.queries``.
"""
