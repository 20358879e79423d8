"""fluxframe: spectra, catalogues and posterior samples as Spark DataFrames."""

import sys

from pyspark import cloudpickle

from fluxframe.session import local_session, staged

# Kernels travel to the executors with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["local_session", "staged"]
