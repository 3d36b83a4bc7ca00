"""Importing this module registers every query."""

import parity.spell_queries  # noqa: F401, I001
import parity.survival_queries  # noqa: F401
import parity.key_queries  # noqa: F401
import parity.quality_queries  # noqa: F401
import parity.rollup_queries  # noqa: F401
import parity.feature_queries  # noqa: F401
import parity.score_queries  # noqa: F401
import parity.action_queries  # noqa: F401
import parity.signal_queries  # noqa: F401
import parity.export_queries  # noqa: F401
