"""credsweep: hardcoded-secret detection over DataFrames of text.

Input: a DataFrame (doc_id, filename, text) or a directory tree of files.
Output: a ``findings`` DataFrame plus per-file and corpus reports.
See ``credsweep.plans.scan.scan``.
"""

__version__ = "0.1.0"
