"""Exam-document analytics on Spark DataFrames."""
