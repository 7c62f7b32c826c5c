"""Operators for preparing training data: language ID, near-duplicate joins,
decontamination, surrogates for personal data, packing and the like.

Each module holds one operator with its own general interface;
``queries.py`` holds the thin registered queries.  Functions that run in
Python tasks are pickled by value, so executors need no copy of the
package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
