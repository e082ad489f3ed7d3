"""shopfloor: Spark-native sales, catalogue and stock analytics.

Every operator takes DataFrames and returns DataFrames built from native
Spark expressions; nothing calls ``collect()``.  See README.md for the map
from operators to modules.
"""

from shopfloor.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
