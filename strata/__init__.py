"""strata — sampling and evaluation of sampled outputs on Spark DataFrames.

Subpackages:

* ``sources``   — table scans, ordinal slices, held-out splits, column resolution, sinks
* ``functions`` — column-expression builders (text normalisation, numbers, scoring, token arrays)
* ``operators`` — multi-row operators (evaluation metrics, reports, distribution shaping,
  lattice / i.i.d. sampling, multi-step decoding, skew-safe ordered scans)
* ``plans``     — the registered queries over the driver tables and their DuckDB oracles
* ``streaming`` — the stateless scorer applied to streaming DataFrames
"""

__version__ = "0.1.0"
