"""Streaming entry point.

The reference has no streaming operators; its search reads one term file to
the end.  The one stateful thing it keeps across searches is the per-JVM
source-usage map (``docMatchCount``).  ``term_files`` re-expresses that as a
Structured Streaming job: term files dropped into a folder are searched per
micro-batch against a fixed document index, and the usage table written by
one batch feeds the formula and the quota of the next.
"""

from phrasemill.streaming.term_files import search_term_files  # noqa: F401
