"""pagelake: encyclopedia-dump analytics as Spark DataFrame jobs.

Subpackages: ``functions`` (Column functions), ``sources`` (readers and
writers), ``operators`` (DataFrame operators), ``plans`` (registered queries
and their SQL oracles), ``streaming`` (incremental jobs).
"""

from pagelake.session import build_session, cut_lineage, prepare

__all__ = ["build_session", "cut_lineage", "prepare"]
__version__ = "0.1.0"
