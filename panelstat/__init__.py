"""panelstat: weighted household-survey estimation, document-record extraction
and answer scoring as Spark DataFrame operators.

Every public operator takes DataFrames (and column names) and returns a lazy
DataFrame; nothing is collected to the driver.
"""

from panelstat.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
__version__ = "0.1.0"
