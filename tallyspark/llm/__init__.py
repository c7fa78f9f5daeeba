"""Training-data operators: language ID, chat formatting, toxicity, near-duplicates, packing,
WARC, HTML extraction, quality rules, benchmark decontamination, secret scans, substring dedup, hard
negatives and ranked lexical search.

Nothing else in the library imports this package.  Its worker functions are pickled by value, so
executors need no installed copy of it.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
