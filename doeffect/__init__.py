"""Direction-of-effect evidence analytics on Spark DataFrames.

Layout: ``functions`` (Column rules and fixed vocabularies), ``sources``
(readers, derived fixtures, sink), ``operators`` (DataFrame operators),
``plans`` (end-to-end run, query registry, SQL oracle), ``streaming``.
"""

__version__ = "0.1.0"
