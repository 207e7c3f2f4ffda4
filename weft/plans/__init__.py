"""Driver query plans: importing this package registers every query."""

from weft.plans import registry
from weft.plans import (q_chat, q_dedup, q_eval, q_gen, q_ingest, q_mcq, q_plan,  # noqa: F401
                         q_io, q_prompts, q_sets, q_stream, q_text, q_translate, q_usage)

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
