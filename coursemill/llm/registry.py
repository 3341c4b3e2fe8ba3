"""What the driver registers of this subpackage."""

from __future__ import annotations

import corpus_pipeline

from .oracles import llm_oracles
from .queries import Query, llm_queries


def registered_queries() -> dict[str, Query]:
    return {**llm_queries(), "pipeline": corpus_pipeline.run}


def registered_oracles() -> dict[str, str]:
    return llm_oracles()  # SQL can express neither the toxicity stage nor the pipeline that begins with it
