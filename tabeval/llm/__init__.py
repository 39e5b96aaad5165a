"""Operators for preparing language-model training text: decontamination, scoring,
language identification, URL reputation, token counts, quality, near-duplicates,
packing, secrets and fingerprints.  Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need not have
# the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
