"""Operators that prepare training data, each a DataFrame function.

Nothing outside this folder (and corpus_pipeline.py) imports it. Functions
that run in Python workers are shipped by value, so executors need the public
libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
