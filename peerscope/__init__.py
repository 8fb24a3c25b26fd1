"""Screening of aggregated claims and payment-relationship tables for unusual patterns, on Spark DataFrames."""
