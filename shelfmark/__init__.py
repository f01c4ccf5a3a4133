"""Shelfmark: a file catalog on Spark.

Lists directory trees, hashes content, keeps disks, scans, files and errors as
tables, and answers search, duplicate, statistics, folder and report questions
over them.  Every operator takes DataFrames and returns a DataFrame.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so executors
# need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
