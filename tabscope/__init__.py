"""tabscope — table profiling, cleaning and exploration as Spark DataFrame operators.

Subpackages: ``sources`` (readers), ``functions`` (expression building blocks),
``operators`` (DataFrame-in/DataFrame-out operators), ``plans`` (composite
reports) and ``streaming`` (the daily resample on a stream).
"""

__version__ = "0.1.0"

from .functions.missing import normalize_missing
from .session import ensure_checkpoint_dir, local_session
from .sources.readers import read_table, scan_csv, scan_json

__all__ = ["normalize_missing", "local_session", "ensure_checkpoint_dir", "read_table",
           "scan_csv", "scan_json"]
