"""Enrichment of a stream: the feature expressions are row-local, so they run unchanged on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracelex.operators.enrich import concept_features


def enriched_stream(posts: DataFrame, vocabulary: list[tuple], compounds: dict[str, list[str]], concepts: list[str], key: str = "doc_id") -> DataFrame:
    """posts: a streaming (or plain) DataFrame with key and text, enriched with a frozen vocabulary. No state is kept."""
    return concept_features(posts, vocabulary, compounds, concepts, key)
