"""verilane: a PySpark engine that resolves free-text references and checks the claims that rest on them.

Every operator is a function from DataFrames or Columns to DataFrames or Columns; nothing here starts a job on its own.
"""
