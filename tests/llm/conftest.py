import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_fixtures import docs, texts  # noqa: E402, F401
