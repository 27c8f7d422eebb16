"""Operators on whole DataFrames: records, access, versions, reports and source code."""
