"""Operators that judge rows one by one: pieces, fertility, secrets, toxicity, decontamination."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelex.llm import decontaminate, fertility, pieces, secrets, toxicity

PATH = "/opt/tokenizers/piece_bpe_32k.model"


# Operator 1.
TEXTS = ["", "plain words here", "  two  spaces   x ", "tab\tand\nline\r\n", "日本語 ▁ mark   🙂 é ñ", "x" * 300, "ſtrange \x00 \x7f", "a" + " " * 70 + "b"]


def test_pieces_without_dropout_are_the_librarys():
    import sentencepiece

    sp, own = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.Encoder(PATH, 0.0)
    for t in TEXTS:
        if "▁" not in t:
            assert own.encode(t) == sp.encode(t)


def test_pieces_in_step_are_the_agendas():
    own, rng = pieces.Encoder(PATH, 0.3), random.Random(1)
    units = ["".join(rng.choices(" etaoinshré.,", k=rng.randint(1, 40))).replace(" ", "") or "e" for _ in range(400)]
    variants = [rng.randrange(4) for _ in units]
    flat, start, count = own._segments(units, pieces.np.array(variants))
    for u, v, s, c in zip(units, variants, start, count, strict=True):
        assert tuple(flat[s : s + c]) == own.vocabulary.segment(u, own.keys[v], own.cut)


def test_dropout_is_lossless_seeded_and_varied():
    a, b, c = pieces.Encoder(PATH, 0.2, 1), pieces.Encoder(PATH, 0.2, 1), pieces.Encoder(PATH, 0.2, 2)
    for t in TEXTS:
        assert a.vocabulary.decode(a.encode(t, "k")) == t and a.encode(t, "k") == b.encode(t, "k")
    text = "the same words again and again " * 40
    assert a.encode(text, "1") != c.encode(text, "1") and a.encode(text, "1") != a.encode(text, "2")
    assert len({tuple(a.encode("internationalisation", str(k))) for k in range(40)}) > 1


def test_every_occurrence_draws_for_itself():
    """A unit with one possible merge is skipped at the rate of the dropout, not at a multiple of a quarter; units with
    several are cut as the agenda cuts each occurrence by its own key."""
    own = pieces.Encoder(PATH, 0.1)
    rates = []
    for unit in [" " + c for c in "abcdefghijklmnop"]:
        cuts = np.concatenate(own.encode_all([unit[1:] + unit * 499] * 8, [str(k) for k in range(8)]))
        whole = own.vocabulary.ids.get(unit)
        if whole is not None:
            rates.append(1 - (cuts == whole).sum() / 4000)
    assert len(rates) > 10 and all(0.07 < r < 0.13 for r in rates)
    for dropout in (0.1, 0.5, 1.0):
        own, rng = pieces.Encoder(PATH, dropout), np.random.default_rng(1)
        names = [" internationalisation", "a", " é日x", " e" * 40, "-" * 40, " the", " qzxe" * 9]
        which, keys = rng.integers(0, len(names), 600), rng.integers(0, 1 << 63, 600).astype(np.uint64)
        flat, start, count = own._follow(names, which, keys)
        for u, k, s, c in zip(which, keys, start, count, strict=True):
            assert tuple(flat[s : s + c]) == own.vocabulary.segment(names[u], int(k), own.cut)
    assert len({tuple(flat[s : s + c]) for u, s, c in zip(which, start, count, strict=True) if u == 0}) == 1


def test_parts_do_not_change_the_ids(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500))
    whole = pieces.Encoder(PATH, 0.2).encode(text, "k")
    monkeypatch.setattr(pieces, "PART", 100)
    assert pieces.Encoder(PATH, 0.2).encode(text, "k") == whole


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_units_in_steps_of_any_size(monkeypatch, dropout):
    """Ids don't depend on how many units are worked on at a time, and are those of the agenda, unit by unit."""
    own, rng = pieces.Encoder(PATH, dropout), random.Random(5)
    units = [" " + "".join(rng.choices("aeinrst\u4e00é\U0001f600", k=rng.randint(0, 47))) for _ in range(300)]
    keys = np.array([rng.getrandbits(64) for _ in units], np.uint64)
    want = [own.vocabulary.segment(u, int(k), own.cut) for u, k in zip(units, keys, strict=True)]
    for step in (1, 7, 8192):
        monkeypatch.setattr(pieces, "STEP", step)
        flat, start, count = own._follow(units, np.arange(len(units)), keys)
        assert [tuple(flat[a : a + n].tolist()) for a, n in zip(start.tolist(), count.tolist(), strict=True)] == want


def test_pieces_of_odd_rows(spark, odd, empty):
    rows = pieces.tokenized(odd).withColumn("back", pieces.decode(F.col("ids"))).collect()
    texts = [r.text for r in odd.collect()]
    assert [r.back for r in rows] == [t or "" for t in texts]
    assert pieces.tokenized(empty).count() == 0


def test_the_query_sums_up_the_ids(spark, odd, tmp_path):
    """Counts and hash of op1_pieces against the ids that the operator returns and the library's own list of byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    more = spark.createDataFrame([(9, "日本 🙂 ∑𝔘 ▁ x" + chr(0), "en", "s")], "doc_id long, text string, lang string, source string")
    docs = odd.select("doc_id", "text", "lang", "source").union(more)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = pieces.op1_pieces(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = []
    for r in pieces.tokenized(docs).collect():
        t = texts[r.doc_id]
        assert sp.decode([]) == "" and pieces.vocabulary(PATH).decode(r.ids) == t
        want.append((r.doc_id, len(r.ids), sum(sp.is_byte(i) for i in r.ids), len(t), hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest(), True))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want)) and max(r.n_byte_tokens for r in rows) > 3


# Operator 5.
def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {k for v in windows.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def test_base_measures():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "\n", " ", "é ", "# ", "<", " ", "\x1c", "x y z a b c d e "]) for _ in range(rng.randrange(120)))
        assert fertility.base_measures(text) == plain_measures(text)


def test_bands(make, odd, empty):
    clean = "The ordinary sentence tells what happened in town yesterday when it rained for several hours and people stayed at home. " * 1
    noisy = " ".join(f"{w}***%%%" for w in "qzx vkj wpf bgt mcd xqz jvk fpw tgb dcm zzq kkv ffw ggb ddc qqx vvj wwp bbt mmc".split())
    docs = make([clean + "Nobody complained, since the fields had been dry and the river low.", noisy])
    assert [r.doc_id for r in fertility.keep(docs).collect()] == [0]
    assert fertility.judge(odd).count() == 7 and fertility.keep(empty).count() == 0
    assert fertility.keep(odd).columns == odd.columns


def plain_merges(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best[0] == 1 << 30:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[x] for x in parts]


def test_fertility_measures():
    """Against merges by rank one at a time, the piece library's own byte pieces, and a counter."""
    import base64
    import math
    from collections import Counter

    import regex
    import sentencepiece

    folder = fertility.TOKENIZERS
    ranks = {base64.b64decode(x.split()[0]): int(x.split()[1]) for x in open(f"{folder}/{fertility.BYTE_VOCABULARY}", "rb")}
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in ["plain words, it's 42 here", "  deux  mots\n\n\tet après ", "日本語 🙂 ∑𝔘 mix", "x" * 70 + " " * 9, "", "ſtrange\x1c\x85sp\u3000aces   end"]:
        ids = [t for piece in regex.findall(fertility.SPLIT, text) for t in plain_merges(piece.encode(), ranks)]
        odd = sum(sp.is_byte(i) for i in sp.encode(text)) if "\n" not in text and "\t" not in text else None
        n, chars, share, entropy = fertility.fertility(text, folder)
        want = -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values()) if ids else 0
        assert fertility.tokens(text, folder) == ids and n == len(ids) and abs(entropy - want) < 1e-9 and chars == (len(text) / n if n else 0)
        assert odd is None or not text or round(share * len(text.encode())) == odd or "\x1c" in text


def test_long_runs_are_tokenised(make):
    """Runs that the pattern's look-ahead can't take, with the tokens that it would give; and the whole query on them."""
    own, rng = fertility.encoding(fertility.TOKENIZERS), random.Random(5)
    runs = ["a", "b ", "\n", " " * 511, " " * 512, " " * 513, "\u3000" * 600, "\t" * 600, "é.", "\x85", "\x1c", "12", " x", "\r\n" * 300]
    for _ in range(200):
        text = "".join(rng.choices(runs, k=rng.randrange(1, 12)))
        assert fertility.tokens(text, fertility.TOKENIZERS) == own.encode_ordinary(text)
    words = " ".join(f"w{i}" for i in range(30))
    rows = fertility.judge(make([words + c * 2_000_000 + end for c in " \nx" for end in ("", "end")])).select("doc_id", "measures.*").collect()
    assert len(rows) == 6 and all(r.n_tokens > 60 and r.n_words in (30, 31) for r in rows)


def test_bands_are_fitted(spark, make):
    rng = random.Random(15)
    docs = make([" ".join(rng.choices("the ordinary sentence tells what happened in town when it rained for hours".split(), k=rng.randint(25, 400))) for _ in range(60)])
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(None, 1), (7, 0)], "doc_id long, quality int")
    bands = fertility.fit_bands(docs, labels)
    assert set(bands) == {"en", "Latin"} and fertility.judge(docs, bands=bands | {"other": (0, 0, 0, 0)}).where("measures.kept").count() == 60
    assert fertility.fit_bands(docs.limit(0), labels) == {}


# Operator 7.
def plain_base(text):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(secrets.ASSIGN, text, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(secrets.HEX, text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


@pytest.fixture(scope="session")
def primed(spark):
    return secrets.dictionary(spark.createDataFrame([("my_rare_identifier_name " * 40,), (None,)], "text string"))


def test_base_spans():
    rng = random.Random(7)
    bits = ["password", "PassWD", "api_key", "Apikey", "secret", "token", "=", ": ", "\"", " ", "AKIA", "ABCDEF0123456789", "deadbeefdeadbeef", "é", "ſecret", "\n", "0123456789abcdef0"]
    for _ in range(500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert secrets.base_spans(text) == plain_base(text)


def test_novelty_adds_spans_and_keeps_base_ones(primed):
    text = "bearer: Zk9f8sKd02ljQWxcvb77Lmn0p and token = abcdefabcdef0"
    base = secrets.base_spans(text)
    novel = secrets.novel_spans(text, base, primed)
    assert [text[a:b] for a, b, _ in novel] == ["Zk9f8sKd02ljQWxcvb77Lmn0p"] and base == plain_base(text)
    assert not secrets.novel_spans("password reset_user_password_by_identifier and the token of ordinarysentences", [], primed)
    assert len(primed) <= secrets.DICTIONARY


def test_the_corpus_identifiers_are_in_the_dictionary(spark):
    rng = random.Random(27)
    names = ["_".join("".join(rng.choices("bcdfghklmnprstvz", k=5)) for _ in range(3)) for _ in range(300)]
    primed = secrets.dictionary(spark.createDataFrame([(" ".join(names),), (" ".join(names[:100]),), (None,)], "text string"))
    assert sum(n.encode() in primed for n in names[:100]) >= 60
    text = f"the secret is kept in {names[5]} and read once"
    assert not secrets.novel_spans(text, [], primed)


@pytest.mark.parametrize("text", ["AWS_ACCESS_KEY=wJalrXUtnFEMI7K7MDENGbPxRfi", "x?signature=dGhpc0lzQVZlcnlTZWNyZXQx", "pwd=qZ7vK2mX9tR4wL8pB3nH",
                                  "auth=qZ7vK2mX9tR4wL8pB3nH", "credential=qZ7vK2mX9tR4wL8pB3nH", "private_key=qZ7vK2mX9tR4wL8pB3nH"])
def test_values_inside_a_run_are_measured(text, primed):
    value = text.split("=")[1]
    assert [text[a:b] for a, b, _ in secrets.novel_spans(text, secrets.base_spans(text), primed)] == [value]


# Ten wordings of a sensitive context.
WORDINGS = ["credential: {k}", "the credential is {k} for now", "rotate the old credential, {k} is the new one", "export SECRET_KEY={k}", "my password is {k} please keep it",
            "bearer {k}", "auth('{k}')", "{k} is the token", "signature {k} was sent", 'connection_string = "{k}" end']
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
NAMES = "get set user config value parse request client server default handler".split()


def novelty_recall(primed, make_value, form, n=20):
    """Share of planted values found over all wordings: alone, twice near each other, or far from the sensitive word."""
    rng, hit = random.Random(17), 0
    words = "the ordinary sentence tells what happened in town when it rained for several hours and people stayed home".split()
    prose = lambda k: " ".join(rng.choices(words, k=k))
    for wording in WORDINGS:
        for _ in range(n):
            value = make_value(rng)
            said = wording.format(k="this" if form == "far" else value)
            text = f"{prose(40)} {said} {prose(300 if form == 'far' else 9)} {'' if form == 'alone' else value + '.'} {prose(40)}"
            at, base = text.index(value), secrets.base_spans(text)
            hit += any(a < at + len(value) and at < b for a, b, _ in base + secrets.novel_spans(text, base, primed))
    return hit / n / len(WORDINGS)


@pytest.mark.parametrize("form", ["alone", "twice", "far"])
@pytest.mark.parametrize("kind", [UPPER, LOWER + DIGITS, LOWER + UPPER + DIGITS, UPPER + DIGITS, LOWER + UPPER + DIGITS + "+/"])
def test_recall_of_planted_values(primed, kind, form):
    assert novelty_recall(primed, lambda r: "".join(r.choices(kind, k=r.randint(18, 40))), form) >= 0.9


@pytest.mark.parametrize("form", ["alone", "twice", "far"])
def test_joined_names_are_not_reported(primed, form):
    for joined in ("_".join, "".join, lambda w: "_".join(w).upper(), lambda w: "".join(x.title() for x in w)):
        assert novelty_recall(primed, lambda r, j=joined: j(r.choices(NAMES, k=4)), form) <= 0.05


def test_every_copy_of_a_value_is_reported(primed):
    value = "qZ7vK2mX9tR4wL8pB3nH"
    text = f"the password was {value}, then again {value}. And once more: x={value}"
    assert [text[a:b].endswith(value) for a, b, _ in secrets.novel_spans(text, [], primed)] == [True] * 3


def test_candidates_are_cut_in_place_and_cover_runs_once():
    assert secrets.candidates("pwd=pwd=pwd=") == [] and secrets.candidates("no such word abcdefghijklmnopqrst") == []
    text = "pwd=abcdefghijklmnopqrstuv token=--0123456789ABCDEFGH.."
    assert [text[a:b] for a, b in secrets.candidates(text)] == ["abcdefghijklmnopqrstuv", "0123456789ABCDEFGH"]


@pytest.mark.parametrize("text", ["pwd=" * 250_000, "pwd= " + "qZ7vK2mX9tR4wL8pB3nH" * 50_000, "pwd " * 250_000 + "a" * 500_000 + "1", "password " + "token=aaaaaaaaaaaaaaaa" * 20_000,
                                  "password " + "/".join(f"{i:016d}" for i in range(30_000))])
def test_long_runs_take_time_in_proportion(primed, text):
    import time

    begun = time.monotonic()
    secrets.novel_spans(text, [], primed)
    assert time.monotonic() - begun < 30


def test_redaction(make, odd, empty):
    docs = make(["x token = abcdefabcdef0 y", None, "plain"])
    rows = secrets.redact(docs).orderBy("doc_id").collect()
    assert rows[0].text == "x [SECRET] y" and rows[0].n_chars == len(rows[0].text) and rows[1].text is None and rows[2].text == "plain"
    assert secrets.redact(odd).columns == odd.columns and secrets.redact(odd).count() == 7 and secrets.redact(empty).count() == 0
    clash = docs.withColumnsRenamed({"lang": "found", "source": "_found"})
    assert secrets.redact(clash).columns == clash.columns and secrets.redact(clash).where("text like '%[SECRET]%'").count() == 1
    assert secrets.redacted("aXXbYYc", [(1, 3, "hex"), (2, 3, "novel"), (4, 6, "hex")], "_") == "a_b_c"


# Operator 3.
def test_toxicity_sample_is_bounded_in_rows_and_words(spark):
    """Ids that thousands of rows share, and a text of most words: neither exceeds the stated bounds."""
    rows = [(0, f"some words {i % 7}", "en") for i in range(20_000)] + [(i, "more words of text", "en") for i in range(2, 60)]
    rows += [(100, "word " * 5_000, "en"), (None, "text", None), (7, None, None), (8, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 101)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, per_class=10, words=10_000)
    assert got.groupby("toxic").size().max() <= 10 and set(got["toxic"]) == {0, 1} and 100 not in set(got["doc_id"])
    wide = toxicity.sample(docs, labels, per_class=30_000, words=3_000)
    assert wide.groupby("toxic")["ids"].agg(lambda s: sum(map(len, s))).max() <= 3_000
    assert toxicity.sample(docs, labels, per_class=10, words=10_000).equals(got)


def test_toxicity_learns_held_out_rows(spark):
    rng = random.Random(3)
    words, bad = [f"w{i}" for i in range(200)], ["vile", "rotten", "nasty"]
    rows, labels = [], []
    for i in range(900):
        t = i % 4 == 0
        text = rng.choices(words, k=30)
        if t:
            for b in rng.sample(bad, 2):
                text.insert(rng.randrange(30), b)
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(t)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, lab).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(r.predicted, i % 4 == 0) for i, r in got.items() if r.held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.95


def plain_score(m, text):
    """The forward pass in loops: for each filter the largest value over all windows (past the end stands nothing), cut
    at zero, weighted, and through the logistic function."""
    import math
    import zlib

    ids = [zlib.crc32(w.encode()) % toxicity.BUCKETS for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    known = {int(b): i + 1 for i, b in enumerate(m.seen)}
    rows = [m.embed[known.get(b, 0)] for b in ids] + [m.embed[0]] * max(toxicity.WIDTHS)
    total, column = m.offset, 0
    for k in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best = 0.0
            for at in range(len(ids) + max(toxicity.WIDTHS) - k + 1):
                best = max(best, float(m.bias[k][f]) + sum(float(rows[at + j][d]) * float(m.filters[k][j][d][f]) for j in range(k) for d in range(toxicity.DIM)))
            total += best * float(m.weight[column])
            column += 1
    return 1 / (1 + math.exp(-total))


def small_model():
    rng = random.Random(23)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    texts = [" ".join(rng.choices(words, k=25) + (["vile", "rotten"] if i % 3 == 0 else [])) for i in range(240)]
    return toxicity.fit([toxicity.bucket_ids(t, toxicity.Buckets()) for t in texts], [int(i % 3 == 0) for i in range(240)], [["en", "fr", None][i % 3 if i % 2 else 0] for i in range(240)]), texts


def test_scores_are_those_of_loops():
    m, texts = small_model()
    some = [*texts[:12], "", None, "vile", "unknown words only", "wab vile rotten"]
    assert np.allclose(m.score(some, toxicity.Buckets()), [plain_score(m, t) for t in some], atol=1e-4)


def test_gradients_are_differences():
    """The gradients of a batch against differences of the loss, for parameters of every kind."""
    m, texts = small_model()
    for name in ("embed", "weight"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    m.filters, m.bias = ({k: v.astype(np.float64) for k, v in x.items()} for x in (m.filters, m.bias))
    docs, y = [m.rows(toxicity.bucket_ids(t, toxicity.Buckets())) for t in texts[:9]], np.array([i % 3 == 0 for i in range(9)], float)
    balance = np.array([1.0, 1.5])

    def loss():
        p = m.forward(docs)[0]
        return float((balance[y.astype(int)] * -(y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    grads, g0 = toxicity.gradients(m, docs, y, balance, decay=0.0)
    step = 1e-5
    params = {"e": m.embed, "w": m.weight} | {f"f{k}": m.filters[k] for k in toxicity.WIDTHS} | {f"b{k}": m.bias[k] for k in toxicity.WIDTHS}
    for name, a in params.items():
        for at in map(tuple, np.argwhere(np.abs(grads[name]) > 1e-4)[:6]):
            was = a[at]
            a[at] = was + step
            up = loss()
            a[at] = was - step
            down = loss()
            a[at] = was
            assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-4 + 0.02 * abs(grads[name][at]), (name, at)
    m.offset += step
    up = loss()
    m.offset -= 2 * step
    assert abs((up - loss()) / (2 * step) - g0) < 1e-4


def test_thresholds_have_the_best_f1():
    rows = [(0.1, 0.0), (0.3, 0.0), (0.35, 1.0), (0.6, 1.0), (0.62, 0.0), (0.9, 1.0)]
    f1 = lambda c: 2 * sum(t for s, t in rows if s >= c) / max(1, sum(s >= c for s, _ in rows) + sum(t for _, t in rows))
    cut = toxicity.threshold(rows)
    assert f1(cut) == max(f1(c) for c in np.linspace(0.05, 0.95, 19)) and 0.3 < cut <= 0.35
    m, _ = small_model()
    assert set(m.thresholds) <= {"en", "fr"} and all(0.05 <= v <= 0.95 for v in m.thresholds.values())


def test_toxicity_learns_from_all_rows(spark):
    """The first rows of training are bounded, those it goes through aren't: with three rows of either class to set out
    from, held-out rows are still told apart, and a text of very many words is learned from."""
    rng, words, bad = random.Random(5), [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)], ["vile", "rotten", "nasty"]
    rows = [(i, " ".join(rng.choices(words, k=20) + (rng.choices(bad, k=6) if i % 4 == 0 else [])), "en") for i in range(4_000)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(4_000)], "doc_id long, toxic int")
    held = [r for r in toxicity.score(docs, lab, per_class=3).collect() if r.held_out]
    yes, no = [r.score for r in held if r.doc_id % 4 == 0], [r.score for r in held if r.doc_id % 4]
    assert sum(a > b for a in yes for b in no) > 0.95 * len(yes) * len(no)
    long = spark.createDataFrame([(i, "only here " * (30_000 if i == 0 else 1), "en") for i in range(40)], "doc_id long, text string, lang string")
    rows = toxicity.labelled(long, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    assert rows.select(F.max(F.size("ids"))).first()[0] == 60_000 and len(toxicity.frequent(rows)) == 2
    m, _ = small_model()
    wide = toxicity.widened(m, toxicity.frequent(rows))
    one = toxicity.passed(rows, wide, np.ones(2, np.float32), 0)
    ids = wide.rows(toxicity.bucket_ids("only here", toxicity.Buckets()))
    assert (ids > 0).all() and (one.embed[ids] != wide.embed[ids]).all() and (one.embed[0] == 0).all()
    assert np.allclose(wide.score(["wab vile rotten"], toxicity.Buckets()), m.score(["wab vile rotten"], toxicity.Buckets()))


def test_slopes_of_long_texts_are_those_of_chunks(monkeypatch):
    m, texts = small_model()
    docs, y = [m.rows(toxicity.bucket_ids(t, toxicity.Buckets())) for t in [*texts[:5], "", " ".join(texts[:9])]], np.array([1, 0, 0, 1, 0, 0, 1], float)
    whole = toxicity.gradients(m, docs, y, np.array([1.0, 1.5]))
    monkeypatch.setattr(toxicity, "CHUNK", 11)
    parts = toxicity.gradients(m, docs, y, np.array([1.0, 1.5]))
    assert abs(whole[1] - parts[1]) < 1e-6 and all(np.allclose(whole[0][k], parts[0][k], atol=1e-6) for k in whole[0])


def test_thresholds_of_all_rows(spark):
    rng = random.Random(4)
    rows = [([round(rng.random(), 3)], ["en", "fr", None][i % 3], int(rng.random() < 0.3)) for i in range(600)] + [([0.4], "one", 1)] * 3
    df = spark.createDataFrame(rows, "ids array<double>, lang string, toxic int")
    got = {r.lang: r.cut for r in toxicity.thresholds(df, lambda c: F.get(c, F.lit(0))).collect()}
    assert set(got) == {"en", "fr"} and all(math.isclose(got[k], toxicity.threshold([(x[0], float(t)) for x, lang, t in rows if lang == k])) for k in got)


def test_toxicity_of_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(3, 1), (4, 0), (0, None)], "doc_id long, toxic int")
    for lab in (none, some):
        rows = toxicity.score(odd, lab).collect()
        assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, some).count() == 0


def test_long_texts_are_scored_whole(monkeypatch):
    m = toxicity.fit([toxicity.bucket_ids(t, toxicity.Buckets()) for t in ["a b c d"] * 20 + ["a b bad d"] * 20], [0] * 20 + [1] * 20, [None] * 40)
    text = "a b c d " * 300 + "a b bad d " + "a b c d " * 300
    whole = m.score([text, None, "", "a"], toxicity.Buckets())
    monkeypatch.setattr(toxicity, "CHUNK", 37)
    assert abs(whole - m.score([text, None, "", "a"], toxicity.Buckets())).max() < 1e-5


# Operator 9.
def plain_scan(text, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        k = min(n, len(x))
        for j in range(len(x) - k + 1 if k else 0):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == x[j : j + k]:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
    return len(w), len(hit), ",".join(sorted(found))


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_decontamination(spark, make, limit):
    rng = random.Random(9)
    word = lambda: rng.choice(["A", "b", "c", "éß", "Dé"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 10, 12, 15])))) for i in range(12)] + [(12, None)]
    texts = [" ".join(word() for _ in range(rng.randrange(40))) for _ in range(40)] + [None, "", items[3][1], items[5][1].lower() + "!! " + items[3][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.scan(make(texts), bench, broadcast_bytes=limit).collect()}
    for i, t in enumerate(texts):
        n, hit, found = plain_scan(t, items)
        assert (got[i].n_words, got[i].n_hit, ",".join(got[i]["items"]), got[i].contaminated) == (n, hit, found, hit > 0)


def test_decontamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (None, "text without an id")], "item_id long, text string")
    assert decontaminate.scan(odd, bench).where("contaminated").count() == 3
    assert decontaminate.remove(odd, bench).columns == odd.columns
    assert decontaminate.scan(empty, bench).count() == 0 and decontaminate.scan(odd, bench.limit(0)).where("contaminated").count() == 0


def test_span_removal(spark, make):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = make(["Start: One two, three four five six seven eight nine TEN! end", "clean text"])
    rows = decontaminate.remove(docs, bench, what="spans").orderBy("doc_id").collect()
    assert re.sub(r"\W+", " ", rows[0].text).strip() == "Start end" and rows[1].text == "clean text"
    clash = docs.withColumnsRenamed({"lang": "hits", "source": "id", "n_chars": "_id"})
    assert [r.text for r in decontaminate.remove(clash, bench, what="spans").orderBy("doc_id").collect()] == [r.text for r in rows]
    assert decontaminate.remove(clash, bench).count() == 1 and decontaminate.remove(clash, bench, what="spans").columns == clash.columns


def test_bit_map_follows_the_windows(spark, make, monkeypatch):
    """A full map only makes more suspects: results are the same with one of 64 bits."""
    rng = random.Random(19)
    items = [(i, " ".join(rng.choices("abcdefgh", k=14))) for i in range(300)]
    docs, bench = make([" ".join(rng.choices("abcdefgh", k=60)) for _ in range(20)] + [items[5][1]]), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, decontaminate.scan(docs, bench, n=4).collect()))
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 64)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 64)
    assert sorted(map(str, decontaminate.scan(docs, bench, n=4).collect())) == want


def test_sha_of_items_is_plain():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
