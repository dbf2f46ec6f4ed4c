"""docframe: document analytics on Spark tables.

Every operator is a function from DataFrames (or Columns) to DataFrames (or
Columns); nothing runs until the caller writes or collects the result.
"""
