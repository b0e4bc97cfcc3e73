"""All registered queries: importing the modules fills the registry."""

from sqlgauge.querybook import (  # noqa: F401
    answers, arrivals, business, corpus, evaluations, mutations, prompts, results, rewards, statements,
)
from sqlgauge.querybook.registry import ORACLES, QUERIES, SURVEY_IDS

__all__ = ["ORACLES", "QUERIES", "SURVEY_IDS"]
