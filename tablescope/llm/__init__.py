"""Operations for training-data pipelines (see README, "Training-data operators").

Nothing else in the package imports this subpackage. Its functions travel to
the executors by value, so those need not have the package installed."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
