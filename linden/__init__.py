"""linden: corpus analytics for text and source code, expressed as Spark jobs.

Every operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver.  The package is organised as

* ``sources``   -- table loading, derived views (lines, tokens, code lines,
                   edit log, manifests) and sinks.
* ``functions`` -- fixed vocabularies and Column-level helpers (tokeniser
                   pattern, similarity expressions, case conversion).
* ``operators`` -- relational building blocks (n-grams, lookups, search,
                   outlines, spelling, candidates, features, evaluation).
* ``streaming`` -- Structured Streaming jobs over the edit log.
* ``plans``     -- named queries over the driver tables plus their SQL twins.
"""

from linden.session import ensure_checkpoint_dir, get_session, materialize

__all__ = ["get_session", "ensure_checkpoint_dir", "materialize"]
