"""A stream of documents gets the features that a table of them gets."""

from tracelex.operators.enrich import concept_features
from tracelex.plans import fixtures as X
from tracelex.streaming import enriched_stream


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "that thing, ai and tionha"), (2, None), (3, "from this than then with")], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = enriched_stream(stream, X.VOCABULARY, X.COMPOUNDS, X.CONCEPTS).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(60)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, concept_features(df, X.VOCABULARY, X.COMPOUNDS, X.CONCEPTS).collect())) and len(got) == 3
