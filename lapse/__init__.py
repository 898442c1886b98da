"""Customer-retention analytics written as Spark jobs.

Segmentation, dataset profiling, survival analysis, churn classification and
lifetime value. Every operator takes a DataFrame plus column names and returns
a DataFrame; only fitted parameters (a handful of doubles) reach the driver.
"""
