"""Parts-price benchmarking as Spark jobs.

Supplier-bill lines go in; a median price per part, price analytics, claim
assessments and matcher-quality reports come out.  Every public function takes
and returns DataFrames.
"""

from pricebench.config import MatchConfig

__all__ = ["MatchConfig"]
