"""Scalar functions: builders of Spark columns, and Python helpers for what columns cannot express."""
