"""Finance-operations analytics as Spark DataFrame jobs.

Money is always a signed ``bigint`` of minor units (cents); dates are ISO
``YYYY-MM-DD`` strings at table boundaries. Library functions take and return
DataFrames or Columns and stay lazy, except where a module says it writes.
"""
