"""Query plans: fixtures derived from the driver tables and the query registry."""

from .registry import QUERIES  # noqa: F401


def load_all() -> dict:
    from . import q_corpus, q_gram, q_moderation, q_quant, q_requests  # noqa: F401
    from . import q_streaming  # noqa: F401  (reuses the batch oracles)
    return QUERIES
