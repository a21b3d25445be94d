"""Puts the repository on the path of tests and of Spark's Python workers."""

import os
import sys
from pathlib import Path

HERE = str(Path(__file__).parent)
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = f"{HERE}:{os.environ.get('PYTHONPATH', '')}"
