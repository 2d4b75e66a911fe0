"""Training-data operators. Nothing outside this subpackage imports it.

``queries.py`` registers one thin ``opN_<name>`` query per operator; the operators
themselves take any DataFrame and the names of its id and text columns.
"""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel inside the task, so executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
