"""Training-data operators: deduplication, filtering, scoring, mixing and packing of text corpora.

Nothing outside this subpackage imports it.  Every operator takes DataFrames with a ``text`` and an
integer id column and leaves other columns alone; a null text counts as empty and a null id sorts after
every other id.
"""

import sys

from pyspark import cloudpickle

# Python workers get the operators' functions with the task: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
