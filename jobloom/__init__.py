"""Work-queue analytics on PySpark: jobs, leases, step journals and events as DataFrames."""
