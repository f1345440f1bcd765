"""Technology-signal analytics on Spark.

Job postings, web pages and HTTP header captures go in; technology profiles of
companies, change events, searches, exports and usage reports come out.  Every
operator takes DataFrames (or Columns) and returns one, without running a job.
"""
