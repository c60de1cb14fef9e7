"""Transcript coverage analytics as Spark DataFrames: which script points each call covers, and how well."""
