"""rankforge: candidate scoring, screening and ranking as Spark DataFrame plans.

Every public function takes DataFrames or Columns and returns a DataFrame or Column that is still
lazy, so the pieces chain with ``DataFrame.transform``.  Functions that have to run a job while
building their result (bounded statistics, model fitting, the diversity rounds) say so.
"""

__version__ = "0.1.0"
