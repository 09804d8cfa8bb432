"""DNS traffic analytics as Spark jobs.

Packets, dnstap frames and flat DNS logs are DataFrames from end to end: every
operator takes a DataFrame and returns one, and Catalyst plans the work.
"""

from namestrata.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
