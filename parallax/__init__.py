"""parallax: scoring and training small regression networks over Spark DataFrames.

Sub-packages:

* ``sources``   - text lines, delimited records with bad-record split, the
                  model weights table, prediction sinks
* ``operators`` - examples/keying, scoring, worker placement, training
* ``functions`` - the network as Column expressions
* ``plans``     - timed scoring/training jobs and their summaries, plan checks
"""

from __future__ import annotations

import sys

# Python functions this package hands to Spark (Arrow UDFs, mapInPandas,
# applyInPandas) are pickled by value, so Python workers need not have the
# package on their path.  On a cluster shipping it with --py-files also works.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass

__version__ = "0.1.0"
