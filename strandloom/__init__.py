"""strandloom: sequence, run-length and succinct-structure analytics on Spark DataFrames.

Every operator takes a DataFrame (or Columns) and returns one; plans stay lazy
and JVM-side unless a docstring says otherwise.
"""

__version__ = "0.1.0"
