"""Operators for preparing training data: packing, filters, search, joins, mixing, sharding, extraction.

Each module holds one operator: a function of DataFrames with its own
parameters.  ``queries`` applies them to the tables of a data folder.  Nothing
outside this subpackage (and the pipeline at the repository's top) imports it.
"""

from pyspark import cloudpickle

import basketry.llm as _package

# Functions of this subpackage travel to the executors as code, so they need no
# copy of the package on the executors' import path.
cloudpickle.register_pickle_by_value(_package)
