"""Imports every group of queries so that they register themselves."""

import catalog.corrections  # noqa: F401
import catalog.evaluation  # noqa: F401
import catalog.files  # noqa: F401
import catalog.patterns_and_outliers  # noqa: F401
import catalog.profiles  # noqa: F401
import catalog.row_rules  # noqa: F401
import catalog.scores  # noqa: F401
import catalog.similar  # noqa: F401
import catalog.suggested  # noqa: F401
