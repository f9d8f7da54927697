"""Options of the engine: environment over configuration file over defaults; and the session."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

ENV_PREFIX = "FOLIOSCOPE_"


@dataclass(frozen=True)
class Options:
    root: str = ""
    inbox: str = "inbox"
    #: BM25.
    k1: float = 1.2
    b: float = 0.75
    #: Rows of one work among the hits.
    per_work: int = 2
    #: Reciprocal rank fusion: constant, and how many rows each list and the fused one give.
    rrf_k: int = 60
    keyword_pool: int = 800
    vector_pool: int = 400
    fused_pool: int = 1200
    keyword_cap: int = 2000
    #: When vectors take part.
    min_vectors: int = 100
    min_coverage: int = 20
    min_embed_chars: int = 40
    max_embed_chars: int = 1200
    min_index_chars: int = 40
    min_scan_chars: int = 25
    min_text_ratio: float = 0.15
    #: Topics.
    top_topics: int = 16
    min_support: int = 4
    min_support_library: int = 5
    redundancy: float = 0.62
    free_per_stem: int = 3
    graph_nodes: int = 150
    graph_edge: int = 3
    typo_ratio: int = 5
    min_cosine: float = 0.25
    #: Query language.
    translate: bool = True
    snippet_tokens: int = 18
    snippet_chars: int = 160
    stable_seconds: float = 2.0
    event_retention: int = 300

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None) -> Options:
        """Defaults, overlaid by a JSON file if it exists, overlaid by ``FOLIOSCOPE_<NAME>`` variables."""
        own = cls()
        found: dict[str, object] = {}
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                found.update(json.load(f))
        env = dict(os.environ) if env is None else env
        found.update({f.name: env[key] for f in fields(cls) if (key := ENV_PREFIX + f.name.upper()) in env})
        given = {f.name: _cast(found[f.name], type(getattr(own, f.name))) for f in fields(cls) if f.name in found}
        return replace(own, **given)


def _cast(value: object, kind: type) -> object:
    if kind is bool:
        return str(value).lower() in ("1", "true", "yes", "on")
    return kind(value)


def session(name: str = "folioscope", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` is added as given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
