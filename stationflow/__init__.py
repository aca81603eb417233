"""Station-to-station flow analytics on PySpark.

Every operator is a function from DataFrame to DataFrame; thresholds and column
names are parameters with the published analysis values as defaults.
"""
