"""Callboard: agent-performance scorecards and issue routing on Spark.

Sub-packages
------------
functions   column expressions (numbers, text, dates, snapshot JSON, p-values)
operators   DataFrame -> DataFrame building blocks (skew, ordering, statistics)
sources     readers and writers
plans       the jobs: cases, productivity, scorecard, routing
streaming   availability kept up to date from arriving snapshot files
"""
