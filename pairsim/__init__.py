"""pairsim: entity-pair similarity analytics on Spark DataFrames.

Sub-packages:
  sources    readers for tables, text lines, merge logs, and the sinks
  functions  Column-expression builders (no actions, no DataFrames)
  operators  DataFrame -> DataFrame operators (pairs, signatures, split, ...)
  plans      registered queries binding the operators to the test tables
  streaming  Structured Streaming variants of the incremental operators
"""

__version__ = "0.1.0"
