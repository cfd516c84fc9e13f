"""Tracewell: experience-graph analytics as Spark DataFrame plans."""
