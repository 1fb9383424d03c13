"""tickframe: market-bar analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames (or builds Columns) and works on
all symbols at once; see README.md for the operator map.
"""

from tickframe.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
