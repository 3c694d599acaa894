"""A transactional SQL engine on Spark: copy-on-write tables behind a versioned manifest.

``Session`` takes statements and returns DataFrames; ``operators`` holds the
scans, filters, joins and row changes as plain DataFrame functions.
"""

from quernstone.errors import EngineError
from quernstone.plans.session import Session

__all__ = ["EngineError", "Session"]
