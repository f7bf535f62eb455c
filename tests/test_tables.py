"""Tables and files: token ids by head and tail, files of any size."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tracelex.operators import audit, tables


@pytest.mark.parametrize("head", [0, 1, 2, 3, 100])
def test_ids_by_head_and_tail_are_alike(spark, head):
    vocab = spark.createDataFrame([("a", 9, 2), ("b", 7, 3), ("c", 5, 4)], "token string, freq long, index long")
    docs = spark.createDataFrame([(1, ["a", "b", "c", "z", "a", "b"]), (1, ["c"]), (None, ["z", None]), (2, []), (3, None)], "doc_id int, words array<string>").withColumn("index", F.lit(5))
    got = sorted(((r.doc_id, r.ids) for r in tables.encode_tokens(docs.repartition(3), vocab, 5, head=head).collect()), key=str)
    assert got == sorted([(1, [2, 3, 4, 1, 2]), (1, [4, 0, 0, 0, 0]), (None, [1, 1, 0, 0, 0]), (2, [0] * 5), (3, [0] * 5)], key=str)


def test_ids_without_a_vocabulary(spark):
    none = spark.createDataFrame([], "token string, freq long, index long")
    docs = spark.createDataFrame([(1, ["a"])], "doc_id int, words array<string>")
    assert tables.encode_tokens(docs, none, 2).first().ids == [1, 0] and tables.encode_tokens(docs.limit(0), none, 2).collect() == []


def test_files_beyond_what_a_row_can_hold(spark, tmp_path):
    """More than 2 GB (a file with a hole), an empty one, names with blanks and signs, and what is left out."""
    folder = tmp_path / "in"
    (folder / "sub dir").mkdir(parents=True)
    big = 2**31 + 5
    with open(folder / "big.bin", "wb") as f:
        f.truncate(big - 3)
        f.seek(big - 3)
        f.write(b"end")
    (folder / "empty.bin").touch()
    (folder / "sub dir" / "a b%+é.bin").write_bytes(b"x" * 100)
    (folder / "skip.bin").write_bytes(b"y")
    (folder / "other.txt").write_bytes(b"z")
    digest, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range((big - 3) // len(zeros)):
        digest.update(zeros)
    digest.update(bytes((big - 3) % len(zeros)) + b"end")
    got = {r.path: (r.name, r.bytes, r.sha256) for r in audit.scan_files(spark, str(folder), ".bin", exclude=("skip",)).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {"big.bin": ("big.bin", big, digest.hexdigest()), "empty.bin": ("empty.bin", 0, sha(b"")), "sub dir/a b%+é.bin": ("a b%+é.bin", 100, sha(b"x" * 100))}


def test_cell_traces_read_texts_once(spark, capsys):
    """The features are stored by one scan, which the cells and their trace both read."""
    import os

    from tracelex.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables aren't here")
    for name in ("cell_trace", "join_cell_trace", "agg_trace_counts"):
        QUERIES[name](spark, sf).explain()
        assert "documents.parquet" not in capsys.readouterr().out
