"""Operators that bring rows together: WARC, quotations, Jaccard join, shards, suffixes, and the pipeline."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracelex.llm import induced, jaccard, quotes, shards, suffixes, warc


# Operator 2.
def test_warc(spark):
    rows = [(1, "http://a.b.example.com/x?y=1", "<p>é</p>"), (2, "https://m.example.com:80/", "<p>é</p>"), (3, None, None), (4, "not a url", ""), (5, "http://[bad", "zz"), (None, "http://example.com/n", "q"), (5, "http://[bad", "zz")]
    archive = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), block_lines=2)
    got = sorted(map(tuple, archive.read_all().drop("key", "payload").collect()), key=str)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        best = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if page == best else "revisit", None if page == best else best))
    assert got == sorted(want, key=str)
    urls = spark.createDataFrame([("http://a.b.example.com/x?y=1",), ("http://nowhere.org/",)], "url string")
    for most in (10, 0):
        found = archive.lookup(urls, max_directory=most).collect()
        assert [r.page_id for r in found] == [1] and found[0].record_type == "revisit" and found[0].refers_to == 2
    assert archive.lines().count() == len(rows)
    assert warc.write(spark.createDataFrame([], "page_id long, url string, html string")).read_all().count() == 0


def test_warc_of_odd_pages(spark):
    """Very long payloads, one key with several blocks of captures, and columns named like the index' own."""
    long = "<p>é" * 400_000
    rows = [(i, "http://example.com/same", f"page {i % 5}") for i in range(60)] + [(100, "http://example.com/long", long), (101, None, long), (None, None, None)]
    pages = spark.createDataFrame([(*r, 1, "f", 2) for r in rows], "page_id long, url string, html string, key long, file string, offset long")
    found = warc.write(pages, block_lines=7).lookup(pages.select("url"))
    got = {r.page_id: r for r in found.collect()}
    assert found.count() == len(rows) and all(got[i].record_type == ("response" if i >= 55 else "revisit") for i in range(60))
    assert got[101].payload == long.encode() and got[100].refers_to == 101 and got[100].payload_bytes == len(long.encode()) and got[None].payload_bytes == 0


def test_url_keys():
    assert warc.url_key("http://A.b.example.com/x?y=1#z") == "com,example,b,a)/x?y=1"
    assert " " not in warc.url_key("http://a b/c d")


# Operator 4.
def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there\nHow do you do?\n\nSecond  Paragraph here"), (1, 1, "assistant", "> hello there\n> how do you do?\nFine.\nThanks"), (1, 2, "user", ">> Hello there\n>> How do you do?\n> Fine.\nGood"),
            (1, 3, "user", "> Second paragraph here\nok"), (1, 4, "user", "no quote"), (1, 5, "user", "> never said\nx"), (2, 0, "user", None), (2, 1, "user", "> Fine.\nHm"), (None, 0, "user", "> a\nb"), (3, None, "user", "> Fine.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.linked(df).collect()}
    assert [got[1, k].parent_turn for k in range(6)] == [None, 0, 1, 0, None, None]
    assert [got[1, k].thread_turn for k in range(6)] == [0, 0, 0, 0, 4, 5]
    assert got[1, 2].body == "Good" and got[1, 2].quote_depth == 2 and got[2, 1].parent_turn is None and got[None, 0].body == "b"
    assert quotes.linked(df.limit(0)).count() == 0 and len(got) == len(rows)


def test_quoted_paragraphs_that_were_wrapped_anew(spark):
    told = "One two three four five six.\nSeven eight nine.\n\nTen eleven twelve\nthirteen.\n\nUnquoted end."
    rows = [(1, 0, "u", told), (1, 1, "u", "> One two three\n> four five six. Seven\n> eight nine.\n>\n> Ten\n> eleven twelve thirteen.\nYes.")]
    got = {r.turn: r for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].parent_turn == 0 and got[1].n_links == 2 and got[1].thread_turn == 0


def test_quotes_of_odd_rows(spark):
    """Ties between parents go to the later one; repeated rows get equal results; names of further columns may clash; a
    message of very many lines, blanks and marks is read in time in proportion to its length."""
    long = "\n".join(f"> line {i}" if i % 2 else f"own {i}" for i in range(40_000)) + "\n" + " " * 500_000 + "x\n" + ">" * 100_000 + " deep"
    rows = [(1, 0, "u", "same words"), (1, 1, "u", "other text"), (1, 2, "u", "> same words\n\n> other text"), (1, 2, "u", "> same words\n\n> other text"), (2, 0, "u", long), (2, 1, None, ""), (2, 2, "u", "> own 4")]
    df = spark.createDataFrame([(*r, 1, "x", [1]) for r in rows], "conv_id long, turn long, role string, text string, level long, unit string, lines array<long>")
    got = sorted(map(tuple, quotes.linked(df).drop("body", "role").collect()))
    assert got == [(1, 0, 0, 0, 0, None, 0), (1, 1, 0, 0, 0, None, 1), (1, 2, 2, 1, 2, 1, 1), (1, 2, 2, 1, 2, 1, 1), (2, 0, 20_001, 100_000, 0, None, 0), (2, 1, 0, 0, 0, None, 1), (2, 2, 1, 1, 1, 0, 0)]


# Operator 6.
def plain_components(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().split(" ") if (t or "").strip() else []
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 2048), (5, 80, 5)])
def test_jaccard(make, monkeypatch, n, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng, texts = random.Random(6), []
    for size in (1, 2, 3, 4, 5, 9, 14, 30, 80, 300):
        for _ in range(3):
            base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(30)) for _ in range(size)]
            for k in range(6):
                copy = list(base)
                for _ in range(rng.choice([0, k // 2, size // 50, size // 20])):
                    copy[rng.randrange(size)] = f"z{rng.randrange(9)}"
                texts.append(" ".join(copy[: size - rng.choice([0, 0, size // 20])]))
    texts += [None, "", texts[5], " ".join(texts[-1].split(" ") + ["extra"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(make(texts), n, percent).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts, n, percent)


@pytest.mark.parametrize("block", [2048, 5])
def test_all_links_of_a_family(make, odd, empty, monkeypatch, block):
    """Near copies in one component: every link between them is found, not only those that hold it together."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng, texts = random.Random(8), []
    for size in (3, 40, 120):
        base = [f"{rng.choice('abcdefgh')}{k}" for k in range(size)]
        for _ in range(15):
            copy = list(base)
            copy[rng.randrange(size)] = f"z{rng.randrange(4)}"
            texts.append(" ".join(copy[: size - rng.choice([0, 0, 1])]))
    texts += [None, "", texts[20], texts[20]]
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    near = lambda x, y: bool(x) and 100 * len(x & y) >= 85 * len(x | y)
    want = [(len(x), sum(near(x, y) for j, y in enumerate(sets) if i != j)) for i, x in enumerate(sets)]
    pairs, per = jaccard.links(make(texts))
    got = {r.doc_id: (r.n_shingles, r.n_links) for r in per.collect()}
    assert [got[i] for i in range(len(texts))] == want and sum(k for _, k in want) > 200
    first = [i for i, x in enumerate(sets) if x and x not in sets[:i]]
    want = sorted((i, j) for i in first for j in first if i < j and near(sets[i], sets[j]))
    assert sorted((min(r), max(r)) for r in map(tuple, pairs.collect())) == want
    if block == 5:
        assert [r.n_links for r in jaccard.links(odd)[1].collect() if r.doc_id == 3] == [1, 1] and jaccard.links(empty)[1].count() == 0


def test_blocks_of_a_hot_key(spark, monkeypatch):
    """Every pair of rows meets in exactly one block pair, but for those of one large root; no block is much too large."""
    monkeypatch.setattr(jaccard, "BLOCK", 10)
    rows = [(1, i, 5, 7 if i < 60 else (8 if i < 75 else i)) for i in range(100)] + [(2, i, 5, i) for i in range(3)]
    df = spark.createDataFrame(rows, "key long, row long, n long, root long")
    root = {(k, r): x for k, r, _, x in rows}
    for made, free in ((jaccard._met(df), True), (jaccard.in_blocks(df.drop("root")), False)):
        groups = {}
        for r in made.collect():
            groups.setdefault((r.key, r.i, r.j), []).append((r.row, r.block))
        met = Counter((k, min(a, b), max(a, b)) for (k, i, j), own in groups.items() for n, (a, x) in enumerate(own) for b, y in own[n + 1 :] if i == j or x != y)
        want = {(k, a, b) for k, a in root for l, b in root if k == l and a < b and not (free and root[k, a] == root[k, b])}
        assert want <= set(met) and all(met[p] == 1 for p in want) and max(map(len, groups.values())) < 50


def test_linked_sets_share_a_key():
    """The pigeonhole argument, on random pairs at the threshold."""
    rng = np.random.default_rng(6)
    for _ in range(600):
        size, percent = int(rng.integers(1, 700)), int(rng.choice([80, 85]))
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        lost = int(rng.integers(0, max(1, len(a) * (100 - percent) // 100) + 1))
        new = int(rng.integers(0, lost + 2))
        b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 1 << 63, new).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            assert len(np.intersect1d(jaccard.keys(a, percent), jaccard.keys(b, percent)))


def test_jaccard_of_odd_rows(odd, empty):
    rows = jaccard.linked(odd).collect()
    assert len(rows) == 7 and [r.component_id for r in rows if r.doc_id == 3] == [3, 3] and [r.component_id for r in rows if r.doc_id is None] == [None]
    assert jaccard.linked(empty).count() == 0 and jaccard.keep_one(odd).columns == odd.columns and jaccard.keep_one(odd).count() == 7


# Operator 8.
def test_shards(make, odd, empty):
    docs = make([f"text {i}" for i in range(1000)]).repartition(7)
    rows = shards.assign(docs, 24, block_rows=11).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == 1000 and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 24
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert all(r.size == len(f"text {r.doc_id}") + 8 for r in rows)
    assert len(shards.assign(odd).collect()) == 7 and shards.assign(empty).count() == 0


def test_shuffle_is_uniform_and_checksums_are_zlibs(make):
    """Chi-square of where each part's rows go, and of the slots that they get in their shard."""
    import zlib

    texts = [f"täxt {i} " * (i % 3) for i in range(6000)]
    docs = make(texts).repartitionByRange(6, "doc_id").cache()
    rows = shards.assign(docs, 8, block_rows=300).collect()
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 8 for r in rows)
    at = {r.doc_id: (r.shard, r.slot) for r in rows}
    table = lambda cells, a, b: np.array([[sum(1 for i, j in cells if (i, j) == (x, y)) for y in range(b)] for x in range(a)], float)
    for cells, a, b in (([(i // 1000, at[i][0]) for i in at], 6, 8), ([(i // 1000, at[i][1] // 150) for i in at], 6, 5), ([(at[i][0], at[i + 1][0]) for i in range(0, 5999, 2)], 8, 8)):
        t = table(cells, a, b)
        want = np.outer(t.sum(axis=1), t.sum(axis=0)) / t.sum()
        dof = (a - 1) * (b - 1)
        assert ((t - want) ** 2 / want).sum() < dof + 4.5 * (2 * dof) ** 0.5


def test_shards_are_written_whole(make, odd, tmp_path):
    docs = make([f"text {i}" for i in range(500)]).repartition(5)
    out = shards.write(docs, f"{tmp_path}/a", 6, block_rows=20)
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(500)) and all(r.text == f"text {r.doc_id}" for r in rows)
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in Counter(r.shard for r in rows).items())
    assert max(Counter(r.shard for r in rows).values()) - min(Counter(r.shard for r in rows).values()) <= 1
    clash = odd.withColumnsRenamed({"lang": "shard", "source": "slot", "measures": "block"})
    assert shards.write(clash, f"{tmp_path}/b", 3).select(clash.columns).exceptAll(clash).count() == 0


def test_communication_matrix():
    m = shards.matrix([5, 0, 100, 37], 24, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 100, 37] and set(m.sum(axis=0).tolist()) == {5, 6}
    rng = np.random.default_rng(0)
    draws = [shards.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**6) for _ in range(300)]
    assert abs(np.mean(draws) - 3e5) < 150 and 350 < np.std(draws) < 570


# Operator 10.
def plain_repeats(data, k):
    seen, out = set(), np.zeros(len(data), bool)
    for i in range(len(data) - k + 1):
        s = bytes(data[i : i + k])
        if induced.SEPARATOR not in s:
            out[i] = s in seen
            seen.add(s)
    return out


def test_induced_sorting():
    rng = random.Random(10)
    for _ in range(150):
        letters, n, k = rng.choice([1, 2, 3, 20, 254]), rng.choice([0, 1, 5, 30, 300]), rng.choice([1, 2, 3, 7, 20])
        raw = bytes(rng.choice([255] if rng.random() < 0.05 else range(letters)) for _ in range(n))
        raw += bytes([255]) + raw[n // 3 :]
        data = np.frombuffer(raw, np.uint8)
        assert (induced.repeated(data, k, rng.choice([1 << 10, 1 << 28])) == plain_repeats(data, k)).all()


@pytest.mark.parametrize("kind", ["words", "runs", "copies"])
def test_a_shard_of_several_times_the_memory(monkeypatch, kind):
    """Text, queues, minima and names go to scratch files and are read in small blocks."""
    monkeypatch.setattr(induced, "BLOCK", 1 << 10)
    monkeypatch.setattr(induced, "PART", 1 << 6)
    rng = random.Random(12)
    word = {"words": lambda: bytes(rng.choices(b"abcde ", k=rng.randint(3, 9))), "runs": lambda: bytes([rng.choice(b"ab")]) * rng.randint(1, 300), "copies": lambda: passages[rng.randrange(9)]}[kind]
    passages = [bytes(rng.choices(b"xyz", k=rng.randint(30, 400))) for _ in range(9)]
    raw = b"".join(b"".join(word() for _ in range(rng.randint(1, 30))) + b"\xff" for _ in range(400))[:120_000] + b"\xff"
    stores = []
    real = induced.Store.__init__
    monkeypatch.setattr(induced.Store, "__init__", lambda self, memory: (real(self, memory), stores.append(self))[0])
    data = np.frombuffer(raw, np.uint8)
    assert (induced.repeated(data, 40, len(raw) // 6) == plain_repeats(data, 40)).all()
    assert stores[0].end > 4 * len(raw)


def test_external_order():
    key = np.random.default_rng(1).integers(0, 50, 5000)
    assert (induced.order_by(key, induced.Store(100), limit=300) == np.argsort(key, kind="stable")).all()


def plain_removed(texts):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if (s := raw[i : i + 100]) in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((len(raw), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffixes(make, monkeypatch, hot):
    rng = random.Random(10)
    passages = ["".join(rng.choices("abcdé ", k=rng.randint(90, 260))) for _ in range(6)] + ["ab" * 150, "z" * 400]
    texts = ["".join(rng.choice([*passages, "".join(rng.choices("xyzw ", k=rng.randint(1, 80)))]) for _ in range(rng.randrange(7))) for _ in range(60)]
    texts += [None, "", texts[3], "".join(rng.choices("abcdefgh ", k=9000))]
    texts += [texts[-1][:4000] + "!" + texts[-1][4001:]]
    monkeypatch.setattr(suffixes, "HOT", hot)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.removed(make(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removed(texts)


def test_suffixes_of_odd_rows(odd, empty):
    rows = suffixes.removed(odd).collect()
    assert len(rows) == 7 and suffixes.removed(empty).count() == 0
    assert len({r.n_removed for r in rows if r.doc_id == 3}) == 1 and next(r for r in rows if r.doc_id == 4).n_removed == 4999


# The pipeline.
def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tracelex.llm import pieces

    rng = random.Random(11)
    words = "the ordinary sentence tells what happened in town yesterday when it rained for several hours and people stayed home because fields were dry rivers low nobody complained".split()
    text = lambda: " ".join(rng.choices(words, k=120))
    item = " ".join(rng.choices(words, k=25))
    base = text()
    texts = [base, base + " indeed", text(), text() + " " + item + " " + text(), text() + " token = abcdefabcdef0123 end", "short", None, "***%%% " * 50, text()]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [0, 2, 4, 8]
    decoded = {i: pieces.vocabulary("/opt/tokenizers/piece_bpe_32k.model").decode(r.ids) for i, r in rows.items()}
    assert decoded[0] == base and "[SECRET]" in decoded[4] and "abcdefabcdef" not in decoded[4] and decoded[8] == texts[8]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "SentencePiece encoding"]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, blanks without end, further columns with names that the stages use; and an empty table."""
    import corpus_pipeline

    rng = random.Random(13)
    words = "the ordinary sentence tells what happened in town yesterday when it rained for several hours and people stayed home because fields were dry rivers low nobody complained".split()
    text = lambda: " ".join(rng.choices(words, k=90))
    twice, blank, copied = text(), text() + " " * 600_000 + text(), text()
    rows = [(0, twice, "en"), (0, twice, "en"), (1, blank, None), (2, None, "en"), (3, "", "en"), (4, copied, "fr"), (5, copied, "fr"), (None, text(), "xx"), (6, text() + " \0\u2581 \U0001F642", "de")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, found string, measures long, hits string, _id long, component_id long, ids array<int>"
    for name, some in (("odd", rows), ("none", [])):
        spark.createDataFrame([(*r, "s", len(r[1] or ""), 1, "f", 2, "h", 3, 4, [5]) for r in some], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(0, "an item that no document has in it at all anywhere here")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    # 1 goes: a text that is nearly all blanks has next to no entropy.
    assert sorted((r.doc_id for r in got), key=lambda x: -1 if x is None else x) == [None, 0, 0, 4, 6]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/odd")
        assert [c for c in docs.columns] == [f.split()[0] for f in schema.split(", ")]


def test_runs_of_flags_in_blocks():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 8, 9, 64, 100):
        for share in (0.0, 0.3, 0.9, 1.0):
            flags = rng.random(n) < share
            edges = np.diff(np.concatenate([[0], flags.astype(int), [0]]))
            want = list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist(), strict=True))
            got = [(a, b) for first, last in suffixes.runs(flags, 8) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
            assert got == want


def test_few_bytes_make_few_shards():
    """A shard's 256 queues cost the same whatever it holds: 36 MB on 6 cores are 9 shards, not 144; much data has WAVES a core."""
    assert suffixes.shard_count(36 << 20, 6) == 9 and suffixes.shard_count(0, 6) == 6
    assert suffixes.shard_count(100 << 30, 6) == 6 * suffixes.WAVES


def test_a_small_shard_needs_no_scratch_file(monkeypatch):
    rng, stores = random.Random(13), []
    real = induced.Store.__init__
    monkeypatch.setattr(induced.Store, "__init__", lambda self, memory: (real(self, memory), stores.append(self))[0])
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    raw = b"\xff".join(" ".join(rng.choices(words, k=25)).encode() for _ in range(2000)) + b"\xff"
    induced.repeated(np.frombuffer(raw, np.uint8), suffixes.K, suffixes.SHARD_MEMORY * len(raw) // suffixes.SHARD_BYTES)
    assert stores[0].file is None


def test_members_of_positions(monkeypatch):
    monkeypatch.setattr(induced, "BLOCK", 1 << 7)
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 128, 129, 1000):
        own = np.flatnonzero(rng.random(n) < 0.3)
        members, every = induced.Members(own, n, induced.Store(1 << 20), np.int32), np.arange(n)
        assert (members.has(every) == np.isin(every, own)).all() and (members.number(every) == np.searchsorted(own, every)).all()


@pytest.mark.parametrize("top", [1, 1000, 1 << 40, 1 << 62])
def test_order_is_stable_for_keys_of_any_size(top):
    key = np.random.default_rng(4).integers(0, top, 3000)
    key[1000:2000] = key[:1000]
    assert (induced._argsort(key) == np.argsort(key, kind="stable")).all() and len(induced._argsort(key[:0])) == 0


def test_suffixes_of_rows_without_ids(spark):
    rng = random.Random(23)
    word = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    shared = word(180)
    texts = [(None, word(60) + shared + word(90)), (None, word(150) + shared[:150]), (4, word(30) + shared[20:] + word(300)), (5, word(400))]
    rows = suffixes.removed(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    gone = {(r.doc_id, r.n_bytes): r.n_removed for r in rows}
    # The ids that are null come first; of those two, the order is that of their texts' hashes.
    assert len(rows) == 4 and gone[4, len(texts[2][1])] == 160 and gone[5, 400] == 0
    assert sum(n for (i, _), n in gone.items() if i is None) == 150
