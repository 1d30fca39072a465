"""lexiloom: Unicode text normalisation and matching for Spark, with a text-corpus toolkit in ``lexiloom.llm``."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions sent to Python workers carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
