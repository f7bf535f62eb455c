"""Every query of the library (not of its llm part) that has SQL, against DuckDB on the smallest tables."""

import os

import pytest

from tracelex.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
SOME = [
    "entry_activation", "feature_vector", "derived_features", "top_concepts", "mention_positions", "concept_polarity", "concept_windows", "agg_feature_coverage", "agg_numeric_summary", "trace_map", "triples_from_posts",
    "conformance_report", "metrics_overall", "sequence_sha256_blocks", "matrix_fingerprint", "build_vocab", "encode_tokens", "project_release", "anova_f", "run_grid", "grid_collect", "link_runs", "reconcile_predictions",
    "audit_traceability", "audit_model_inputs", "scan_split", "scan_trace", "scan_metric_docs", "manifest_verify", "tfidf_terms", "match_short_term", "match_long_term", "grid_small", "grid_aggregate", "scan_ntriples",
    "rdfs_type_inherit", "chk_class", "chk_node_kind", "chk_datatype", "matrix_differences", "reconcile_chain", "agg_ablation_summary", "rank_modules", "pivot_delta", "agg_module_coverage", "agg_label_distribution", "tfidf", "file_hashes",
]


@pytest.fixture(scope="module")
def db():
    import duckdb

    out = duckdb.connect()
    for f in os.listdir(SF):
        out.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return out


@pytest.mark.parametrize("name", SOME)
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    own = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    result = db.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    theirs = sorted(tuple(str(r[i]) for i in order) for r in result.fetchall())
    number = lambda rows: [tuple(_number(x) for x in r) for r in rows]
    assert sorted(df.columns) == sorted(names) and number(own) == number(theirs)


def _number(x):
    try:
        return round(float(x), 5)
    except ValueError:
        return x
