"""flowmetrics: customer-journey and operations analytics on Spark.

Subpackages
-----------
sources    table access and stand-in business tables
functions  Column builders (classifiers, rates, dates, nested fields)
operators  DataFrame -> DataFrame analytic operators
plans      the registered query catalogue and its SQL oracles
streaming  Structured Streaming variants of the feed-health operators
"""

__version__ = "0.1.0"
