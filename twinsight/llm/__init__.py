"""Operators of a training-data pipeline. Nothing outside this package and ``corpus_pipeline`` imports it.

Functions that run in Python workers are sent by value and broadcasts carry plain tables, so executors need neither this
package nor a copy of it on their disks.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
