"""All queries of the subpackage."""

from cellweave.llm import (  # noqa: F401
    collocations,
    decontamination,
    html_extraction,
    language_id,
    lm_scoring,
    mixing,
    pii,
    quality_rules,
    secrets_scan,
    sharding,
    simhash,
    topk_search,
    whitening,
)
from cellweave.llm.registry import ORACLES, QUERIES  # noqa: F401
