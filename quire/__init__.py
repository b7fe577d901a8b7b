"""quire: a PySpark-native engine for multi-witness text corpora and the records around them.

Subpackages
-----------
functions   scalar expressions (Catalyst columns; Arrow functions where Spark has no built-in)
operators   relational operators built from DataFrame plans
sources     readers and writers
plans       the query catalogue with a DuckDB statement beside each query
streaming   stateful event operators (batch and Structured Streaming)
llm         training-data operators for text; nothing else imports it
"""

__version__ = "0.1.0"
