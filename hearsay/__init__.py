"""Social-comment intelligence as Spark DataFrame jobs.

Comments are the atoms; everything else (signals, rankings, alerts, briefs) is
a DataFrame derived from them.
"""

from hearsay.tables import Tables

__all__ = ["Tables"]
