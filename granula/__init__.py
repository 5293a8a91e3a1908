"""Granula: spatial morphometry of segmented objects as relational plans on Spark."""

import os
import site
import sys
from pathlib import Path

from pyspark import cloudpickle

_root = str(Path(__file__).resolve().parent.parent)
_found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
if _root not in {str(Path(p).resolve()) for p in _found if p}:
    # Python workers could not import the package by name, so its functions travel with each task
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
