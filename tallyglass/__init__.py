"""tallyglass: table profiling, privacy checks and synthetic data as Spark jobs.

Every operator takes DataFrames and returns DataFrames.  Work over rows stays in
Spark; only results whose size is bounded by the number of columns, bins, levels
or parameters reach the driver.
"""
