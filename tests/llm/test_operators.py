"""The operators against SQL, brute force and round trips, and on odd rows."""

import base64
import gzip
import hashlib
import json
import math
import os
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import bpe, chat, decontam, langid, line_dedup, lm, neardup, queries, sharding, textvec, topk, warc
from rankloom.llm.line_dedup import dedup_lines, keep_bitmaps
from tests.conftest import SF, agree

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "x y", None, "a", 3), (3, "\n\n", "fr", "b", 2), (4, "Zz " * 3000, "fr", "b", 9000), (4, "Zz " * 3000, "fr", "b", 9000), (5, "é ß 漢字 \U0001f600", "de", "c", 8)]


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def corpus(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    agree(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name])


# ---------------------------------------------------------------- words and shingles


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \n\tç漢.", max_size=40)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_word_and_shingle_hashes(texts):
    data, off = textvec.text_bytes(pa.array(texts, pa.string()))
    hashes, woff = textvec.word_hashes(data, off)
    expected = [words(t) for t in texts]
    assert np.diff(woff).tolist() == [len(w) for w in expected]
    flat = [w for ws in expected for w in ws]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
    sets = [s for _, part in textvec.shingle_sets(pa.array(texts, pa.string()), 3, 8) for s in part]
    assert [len(s) for s in sets] == [len(shingles(t, 3)) for t in texts]


# ---------------------------------------------------------------- op1


def exact_topk(queries_, items, k):
    out = {}
    for q, v in queries_.items():
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=False)))), i) for i, w in items if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<long>")


def found_topk(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("spread", [3, 1000, 1 << 28, 1 << 40])
def test_topk_with_ties_over_shards(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "SHARD", 37)
    monkeypatch.setattr(topk, "BLOCK", 5)
    rng = np.random.default_rng(spread)
    items = [(i, [int(x) for x in rng.integers(-spread, spread + 1, 6)]) for i in range(150)] + [(7, [1, 1, 1, 1, 1, 1]), (200, [0] * 6)]
    asked = {i: v for i, v in items[:12]}
    got = found_topk(topk.top_k(vectors(spark, [(i, v) for i, v in asked.items() if i != 7]), vectors(spark, items), 10))
    assert got == exact_topk({i: v for i, v in asked.items() if i != 7}, items, 10)


def test_only_essential_postings_are_read():
    """Of sparse items the postings of essential terms are far fewer than all, and none is lost."""
    rng = np.random.default_rng(4)
    items = np.where(rng.random((4000, 200)) < 0.05, rng.integers(-50, 51, (4000, 200)), 0)
    for w in (np.where(rng.random(200) < 0.08, rng.integers(-9, 10, 200), 0), np.eye(200, dtype=np.int64)[3] * 7 + np.eye(200, dtype=np.int64)[9], np.zeros(200, np.int64)):
        postings = topk.Postings(np.arange(4000), items.astype(np.float64))
        ids, scores = postings.search(11, w.astype(np.float64), 10, None)
        expected = exact_topk({11: w.tolist()}, list(enumerate(items.tolist())), 10)[11]
        assert list(zip(ids.tolist(), scores.astype(int).tolist(), strict=True)) == expected
        every = sum(len(postings.lists[t, int(np.sign(x))][0]) for t, x in enumerate(w) if x)
        assert postings.touched <= every and (not w.any() or postings.touched < 0.2 * items.size)
    floor = scores[-1]
    again = topk.Postings(np.arange(4000), items.astype(np.float64))
    shared = again.search(11, (items[5] * 3).astype(np.float64), 10, None)
    before = again.touched
    higher = again.search(11, (items[5] * 3).astype(np.float64), 10, int(shared[1][-1]))
    assert [x.tolist() for x in higher] == [x.tolist() for x in shared] and again.touched - before <= before and floor == 0


def test_topk_odd_rows(spark):
    items = [(1, [1, 2]), (2, [3]), (3, []), (None, [1, 1]), (4, None), (5, [1, None]), (6, [-1, 5, 9])]
    got = found_topk(topk.top_k(vectors(spark, items), vectors(spark, items), 10))
    assert got == exact_topk({1: [1, 2], 2: [3], 3: [], 6: [-1, 5, 9]}, [(1, [1, 2]), (2, [3]), (3, []), (6, [-1, 5, 9])], 10)
    assert topk.top_k(vectors(spark, []), vectors(spark, items), 3).count() == topk.top_k(vectors(spark, items), vectors(spark, []), 3).count() == 0


# ---------------------------------------------------------------- op2


def test_line_dedup_keeps_first(spark):
    rows = [(1, "A\nb\nA \n", "", "", 0), (2, " a\nc", "", "", 0), (3, "\n".join(f"l{i}" for i in range(150)) + "\nc", "", "", 0), (2, " a\nc", "", "", 0)]
    df = docs(spark, rows).withColumn("words", F.lit("own")).withColumn("key", F.lit(1))
    out = {r["doc_id"]: r["text"] for r in dedup_lines(df, min_docs=2).collect()}
    assert out == {1: "A\nb\n", 2: "c", 3: "\n".join(f"l{i}" for i in range(150))}
    assert dedup_lines(df).columns == df.columns and dedup_lines(df).count() == 4


@pytest.mark.parametrize(("hot", "first"), [(3, True), (3, False), (10**9, False)])
def test_line_dedup_of_hot_lines(spark, monkeypatch, hot, first):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rows = [(i, f"everywhere\nown {i}\nhalf {i % 2}\nthird {i // 3}\n", "", "", 0) for i in range(30)]
    seen = Counter(x for r in rows for x in set(r[1].split("\n")) if x)
    used, expected = set(), {}
    for i, text, *_ in rows:
        kept = [x for x in text.split("\n") if not x or seen[x] < 3 or (first and x not in used)]
        used |= set(text.split("\n"))
        expected[i] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in dedup_lines(docs(spark, rows), min_docs=3, keep_first=first).collect()} == expected


def test_line_dedup_odd_rows(spark):
    out = dedup_lines(docs(spark, ODD), min_docs=2)
    assert sorted(map(str, (r["text"] for r in out.collect()))) == sorted(map(str, (r[1] for r in ODD)))
    assert dedup_lines(docs(spark, [])).count() == 0 and keep_bitmaps(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- op3


def test_pages_round_trip(spark):
    big = "x" * 1200
    rows = [(1, "http://a b", big), (2, None, big), (3, "u", "x" * 10), (4, "u", "x" * 10), (5, "u", None), (None, "u", big), (6, "u", "é\r\n\r\n漢\n" * 300), (2, None, big)]
    out = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    expected = sorted(((p, size(h), sha(h), "revisit" if h == big and p != 2 else "response", 2 if h == big and p != 2 else None) for p, _, h in rows), key=str)
    assert got == expected and all(r["sound"] for r in out)
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    body = f"{version} 0 me\n{warc.FIELDS[version]}\n".encode()
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"payload\n\n"
    arc = warc.arc_header(version, "filedesc://x.arc", "text/plain", len(body), name="x.arc") + body + b"\n"
    arc += warc.arc_header(version, "http://e/ f", "text/html", len(http)) + http + b"\n"
    arc += warc.arc_header(version, "dns:e", "text/dns", 3) + b"abc\n" + warc.arc_header(version, "http://cut", "text/html", 99) + b"short"
    for content in (arc, gzip.compress(arc)):
        records = list(warc.parse_arc(content))
        assert [r["url"] for r in records] == ["filedesc://x.arc", "http://e/%20f", "dns:e", "http://cut"] and [r["cut"] for r in records] == [False] * 3 + [True]
        read = list(warc.parse_warc(b"\r\n\r\n".join(map(warc.to_warc, records)) + b"\r\n\r\n"))
        assert [h["warc-type"] for h, _ in read] == ["warcinfo", "response", "resource", "resource"] and read[1][1] == http and "warc-truncated" in read[3][0]
        assert read[1][0]["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"payload\n\n").digest()).decode()
        assert read[1][0]["warc-date"] == "2024-01-01T00:00:00Z" and warc.warc_date("199712") == "1997-12-01T00:00:00Z"


# ---------------------------------------------------------------- op4

TEXTS = ["", "  a  b", "x<|endoftext|> y <|startoftext|>", "É  é ß 　 don't I'LL 're 12345 \n\n\t", "Σας ΣΑΣ é ́x a ́b", "w" * 5000, "a " * 500, " nb sp", "\U0001f600 ok \x00 z"]


@pytest.mark.parametrize(("name", "keep"), [("word_bpe_49k.json", 16), ("word_bpe_49k.json", 1), ("byte_bpe_50k.json", 2)])
def test_encoding_is_exact(corpus, name, keep):
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        own = f.read()
    plain, codec = Tokenizer.from_str(own), bpe.Codec(own, keep, memo=500, chunks=50)
    assert codec.proven == name.startswith("word")
    texts = [*TEXTS, *(t or "" for _, t, _ in corpus[:60])]
    for _ in range(2):
        data, off = textvec.text_bytes(pa.array(texts))
        got = [x for i, j in textvec.blocks(off, 1 << 14) for x in codec.encode(data, off[i : j + 1])]
        for text, ids in zip(texts, got, strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
            assert codec.decode(ids) == plain.decode(ids.tolist(), skip_special_tokens=False)


@given(st.text(alphabet="aBsé\u0301Σς'’.,!<|>_ \t\n\u3000 0٣漢\x01\x1c", max_size=60))
@settings(max_examples=300, deadline=None)
def test_encoding_of_odd_texts(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    global ODD_CODEC
    if not ODD_CODEC:
        with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
            own = f.read()
        ODD_CODEC = (Tokenizer.from_str(own), bpe.Codec(own, 1))
    plain, codec = ODD_CODEC
    data, off = textvec.text_bytes(pa.array([text, f"{text} x{text}"]))
    expected = [plain.encode(t, add_special_tokens=False).ids for t in (text, f"{text} x{text}")]
    assert [x.tolist() for x in codec.encode(data, off)] == expected


ODD_CODEC = ()


def crossing_tokenizer():
    """A hand-written BPE whose merges reach over spaces, so that chunks often don't agree with their neighbours."""
    from tokenizers import Tokenizer, models

    pieces = ["a", "b", "c", " ", "a ", "a b", "b ", "b c", " c", "a b c"]
    merges = [("a", " "), ("b", " "), (" ", "c"), ("a ", "b"), ("b", " c"), ("a ", "b c")]
    return Tokenizer(models.BPE({p: i for i, p in enumerate(pieces)}, [m for m in merges if "".join(m) in pieces]))


@given(st.lists(st.text(alphabet="abc ", max_size=80), max_size=5))
@settings(max_examples=200, deadline=None)
def test_joins_are_repaired(texts):
    plain = crossing_tokenizer()
    codec = bpe.Codec(plain.to_str(), keep=1)
    data, off = textvec.text_bytes(pa.array([*texts, "aaaaaaaaa b c a b c b c"], pa.string()))
    got = codec.encode(data, off)
    for text, ids in zip([*texts, "aaaaaaaaa b c a b c b c"], got, strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert codec.repairs > 0 and not codec.proven


def test_chunks_are_encoded_once(spark):
    """Shared passages of different documents give equal chunks, which reach the tokenizer once."""
    with open(queries.word_tokenizer(), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    passage = " ".join(f"passage{i}" for i in range(400))
    data, off = textvec.text_bytes(pa.array([f"begin{i} {passage} end{i}" for i in range(50)]))
    codec.encode(data, off)
    assert 10 < len(codec.chunks.new) < 150 and max(map(len, codec.chunks.new)) > 50


def test_encoding_operator(spark):
    from tokenizers import Tokenizer

    path = queries.word_tokenizer()
    df = docs(spark, ODD).withColumn("n_tokens", F.lit("clash"))
    enc = bpe.encode(df, path)
    assert enc.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"] and enc.count() == len(ODD)
    plain = Tokenizer.from_file(path)
    expected = Counter(" ".join(map(str, plain.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD)
    assert Counter(" ".join(map(str, r["ids"])) for r in enc.collect()) == expected
    back = Counter(r["text"] for r in bpe.decode(enc.drop("n_tokens"), path).collect())
    assert back == Counter(plain.decode(plain.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in ODD)
    assert bpe.encode(docs(spark, []), path).count() == 0


def test_op4_digests(spark, corpus):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.word_tokenizer())
    got = by_id(queries.QUERIES["op4_bpe_chunk_reuse"](spark, SF))
    for i, text, _ in corpus:
        ids = plain.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[i])[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False)))


# ---------------------------------------------------------------- op5

TURNS = "conv_id long, turn long, role string, text string"


def test_examples(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 2)
    rows = [(1, 0, "system", "s###"), (1, 1, "user", "\\### Assistant: </turn> ok"), (1, 2, "assistant", "\\h\\e\\b</turn>"), (1, 3, "user", None), (1, 4, "assistant", ""), (2, 0, "assistant", "é漢"), (2, 0, "as\n:sistant", "b"), (None, None, None, None)]
    formatted = chat.format_turns(spark.createDataFrame(rows, TURNS))
    read = chat.read_turns(formatted).collect()
    assert Counter((r["conv_id"], r["turn"], r["role"], r["text"]) for r in read) == Counter((c, t, r or "", x or "") for c, t, r, x in rows)
    assert {r["text"] for r in read if r["loss_text"] is not None} == {r["loss_text"] for r in read if r["loss_text"] is not None} == {"\\h\\e\\b</turn>", "", "é漢"}
    examples = {(r["conv_id"], r["turn"]): r for r in chat.render_examples(formatted).collect()}
    assert set(examples) == {(1, 2), (1, 4), (2, 0)}
    whole = examples[1, 4]["example"]
    assert whole.startswith(examples[1, 2]["example"]) and whole.count("</turn>") == 5 and examples[1, 2]["example"][examples[1, 2]["loss_start"] : examples[1, 2]["loss_end"]] == "\\bh\\be\\bb\\e"
    assert chat.format_turns(spark.createDataFrame([], TURNS)).count() == 0


def test_examples_are_written_out(spark, monkeypatch):
    """Every target turn has its whole context, over several parts; the query reads its turns and losses from these texts."""
    monkeypatch.setattr(chat, "TURNS", 3)
    odd = ["", "a:\nb", "\n</turn>\n", "### user:\n", "\\n\\b", "é漢🙂\n", None]
    rows = [(1, i, "assistant" if i % 3 == 2 else "user", odd[i % 7]) for i in range(20)]
    rows += [(2, 0, "user", "never answered"), (3, 5, "assistant", "x"), (3, 9, "assistant", None), (None, 0, "assistant", "y"), (4, None, "r:\n\\n", None), (-9, 600, "assistant", "z" * 3000), (-9, 0, "system", "s")]
    mask = lambda x: (x or "").replace("\\", "\\b").replace("</turn>", "\\e").replace("###", "\\h")
    expected = []
    for conv in {r[0] for r in rows}:
        mine, text = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1] or 0), ""
        for nth, (_, turn, role, body) in enumerate(mine):
            text += "### " + mask(role).replace("\n", "\\n") + ":\n"
            span = (len(text), len(text + mask(body))) if role == "assistant" else (None, None)
            text += mask(body) + "\n</turn>\n"
            if role == "assistant" or nth == len(mine) - 1:
                expected.append((conv, turn, text, *span, nth == len(mine) - 1))
    examples = chat.render_examples(chat.format_turns(spark.createDataFrame(rows, TURNS)), rest=True)
    assert Counter(tuple(r) for r in examples.collect()) == Counter(expected)
    assert chat.render_examples(chat.format_turns(spark.createDataFrame(rows, TURNS))).count() == sum(r[2] == "assistant" for r in rows)
    read = chat.read_examples(examples)
    assert Counter(r["loss_text"] for r in read.where("loss_start is not null").collect()) == Counter(r[3] or "" for r in rows if r[2] == "assistant")
    back = read.where("whole is not null").select("conv_id", chat.turns_of(F.col("whole")).alias("turns")).collect()
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in back} == {c: [(r[2], r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1] or 0)] for c in {r[0] for r in rows}}

    seen = []
    monkeypatch.setattr(queries, "render_examples", lambda *a, **k: seen.append(chat.render_examples(*a, **k)) or seen[-1])
    got = queries.QUERIES["op5_chat_prefix_targets"](spark, SF)
    targets = spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'assistant'").count()
    assert len(seen) == 1 and seen[0].where("loss_start is not null").count() == targets + 1
    assert seen[0].where("ends").agg(F.sum(F.char_length("example"))).first()[0] == got.agg(F.sum("formatted_chars")).first()[0]


# ---------------------------------------------------------------- op6


def test_language_model(spark, corpus):
    got = by_id(queries.QUERIES["op6_deleted_interpolation"](spark, SF))
    tokens = {i: [*words(t), None] for i, t, _ in corpus}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2}
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = got[i]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in train, len(ts), sum(c[w] > 0 for w in ts), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] < 0
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def brute_lm(spark, train):
    """A deleted-interpolation model of (id, text) in plain Python, its weights learned here: text -> score, and P(b after a)."""
    hashed = spark.createDataFrame(train, "doc_id long, text string").select("doc_id", F.pmod(F.xxhash64("doc_id", "text", F.lit("deleted")), F.lit(lm.DELETED)).alias("h"))
    deleted = {r["doc_id"] for r in hashed.collect() if r["h"] == 0}
    tokens = {i: [*words(t), None] for i, t in train}
    bigrams = lambda ts: zip([None, *ts[:-1]], ts, strict=True)
    c = Counter(w for ts in tokens.values() for w in ts)
    kept = Counter(w for i, ts in tokens.items() if i not in deleted for w in ts)
    pairs, kept_pairs = (Counter(p for i, ts in tokens.items() if every or i not in deleted for p in bigrams(ts)) for every in (True, False))
    out = Counter(p for i in deleted for p in bigrams(tokens[i]))
    bucket = lambda n: 0 if not n else int(math.log2(n)) + 1
    parts = lambda a, b, c, p: (p[a, b] / max(c[a], 1), c[b] / max(sum(c.values()), 1), 1 / (len(tally) + 1))
    tally = c
    seen = {p: (bucket(kept[p[0]]), parts(*p, kept, kept_pairs)) for p in out}
    weights = {b: [1 / 3] * 3 if b else [0, 0.5, 0.5] for b in range(lm.BUCKETS)}
    for _ in range(lm.ROUNDS):
        sums = {b: [0.0] * 3 for b in weights}
        for p, n in out.items():
            b, f = seen[p]
            whole = sum(w * x for w, x in zip(weights[b], f, strict=True))
            for k in range(3):
                sums[b][k] += n * weights[b][k] * f[k] / whole
        pooled = [sum(s[k] for s in sums.values()) for k in range(3)]
        for b, s in sums.items():
            s = s if sum(s) else (pooled if b else [0, *pooled[1:]])
            if sum(s):
                weights[b] = [x / sum(s) for x in s]

    def p(a, b):
        return sum(w * x for w, x in zip(weights[bucket(c[a])], parts(a, b, c, pairs), strict=True))

    return (lambda text: sum(math.log10(p(a, b)) for a, b in bigrams([*words(text), None]))), p, c


def test_scores_are_those_of_a_brute_model(spark, monkeypatch):
    """Weights learned apart, frequent and rare words, unknown words and contexts, blocks and groups smaller than the corpus."""
    monkeypatch.setattr(lm, "BLOCK", 60)
    monkeypatch.setattr(lm, "GROUP_BYTES", 64)
    monkeypatch.setattr(lm, "MOVES", 0.0)
    monkeypatch.setattr(lm, "ROUNDS", 20)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(0, 30)) if x < 500)) for i in range(120)]
    asked = [(1000, "w1 w2 w1"), (1001, "new w1 newer newest w2"), (1002, None), (1003, "w3 " * 200)]
    score, p, c = brute_lm(spark, rows)
    scores, model = lm.score_texts(docs(spark, [(i, t, "", "", 0) for i, t in rows + asked]), F.col("doc_id") < 1000)
    got = by_id(scores)
    assert len(got) == len(rows) + len(asked)
    for i, text in rows + asked:
        assert got[i]["score"] == pytest.approx(score(text), abs=1e-6 * got[i]["n_tokens"])
    assert (model["train_tokens"], model["distinct"]) == (sum(c.values()), len(c))


def test_probabilities_sum_to_one(spark):
    """After every context, seen or not, all training words, the end and one place for all other words are 1 together."""
    rows = [(i, t) for i, t in enumerate(["a b a c", "a b", "b a d", "c c c a", "a b e", "d a b", ""] * 5)]
    _, model = lm.score_texts(docs(spark, [(i, t, "", "", 0) for i, t in rows]), F.lit(True))
    tokens = [[*words(t), None] for _, t in rows]
    c = Counter(w for ts in tokens for w in ts)
    pairs = Counter(p for ts in tokens for p in zip([None, *ts[:-1]], ts, strict=True))
    weights = np.array(model["weights"])
    for a in [*c, "unknown"]:
        all_ = [lm.probability(weights, np.array([pairs[a, b]]), np.array([c[a]]), np.array([c[b]]), model["train_tokens"], model["distinct"])[0] for b in [*c, "unknown"]]
        assert sum(all_) == pytest.approx(1, abs=1e-9) and min(all_) > 0


def test_weights_are_the_likeliest(spark, monkeypatch):
    """No small move of a bucket's weights makes the deleted counts likelier."""
    rng = np.random.default_rng(1)
    rows = [(int(b), int(min(b, p)), int(n), int(m)) for b, p, n, m in zip(rng.integers(0, 40, 300), rng.integers(0, 9, 300), rng.integers(0, 50, 300), rng.integers(1, 5, 300), strict=True)]
    monkeypatch.setattr(lm, "MOVES", 1e-5)
    weights = lm.learn_weights(spark.createDataFrame(rows, "before long, pair long, count long, n long"), 1000, 99)
    b, p, c, n = (np.array(x) for x in zip(*rows, strict=True))
    likely = lambda w: float((n * np.log(lm.probability(w, p, b, c, 1000, 99))).sum())
    for k in set(lm.bucket_of(b).tolist()):
        for i, j in ((0, 1), (1, 2), (2, 0)):
            moved = weights.copy()
            step = min(0.02, moved[k, i] * 0.9)
            if k or 0 not in (i, j):
                moved[k, i] -= step
                moved[k, j] += step
                assert likely(moved) <= likely(weights) + 1e-2
    assert (weights[0, 0], weights.sum(1).round(9).tolist()) == (0, [1.0] * lm.BUCKETS)


def test_language_model_odd_rows(spark):
    clash = docs(spark, ODD).withColumn("fold", F.lit("own")).withColumn("held_out", F.lit(1)).withColumn("block", F.lit(2))
    scores, model = lm.score_texts(clash, F.lit(True))
    assert scores.count() == len(ODD) and model["train_tokens"] == sum(len(words(r[1])) + 1 for r in ODD)
    none, model = lm.score_texts(docs(spark, ODD), F.lit(False))
    assert model["train_tokens"] == 0 and {r["n_known"] for r in none.collect()} == {0}
    assert lm.score_texts(docs(spark, []), F.lit(True))[0].count() == 0


def test_language_model_of_many_equally_rare_words(spark):
    """Every word keeps its own bigrams, however many there are and however rare they are."""
    rows = [(i, " ".join(f"w{(i * 150 + j) % 60_000}" for j in range(300)), "", "", 0) for i in range(400)]
    asked = [(1000, "w7 w8 w9", "", "", 0), (1001, "w7 w9 new w8", "", "", 0)]
    scores, model = lm.score_texts(docs(spark, rows + asked), F.col("doc_id") < 1000)
    assert model["distinct"] == 60_001
    got = by_id(scores)
    assert got[1000]["n_known"] == 4 and got[1001]["n_known"] == 4 and got[1000]["score"] > got[1001]["score"] + 3


def test_other_words_when_read_again_are_an_error(monkeypatch):
    """As many words of the same lengths, so that only the hash of what was asked for tells."""
    monkeypatch.setattr(lm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = lambda text: pa.RecordBatch.from_pydict({"fold": pa.array([1], pa.int32()), "held_out": [False], "id": [1], "text": [text]})
    asked = pa.Table.from_batches(list(lm.requester(1)(iter([batch("aa bb aa")]))))
    answers = pa.concat_tables([lm.answer(asked.filter(pc.equal(asked.column("g"), g))) for g in (0, 1)])
    answers = answers.filter(pc.equal(answers.column("block"), 0))
    rows = lambda text: pa.Table.from_batches(list(lm.block_rows(iter([batch(text)]))))
    _, count, before, pair = lm.counted(rows("aa bb aa"), answers, 1, ["kept"])
    assert (count.tolist(), before.tolist(), pair.tolist()) == ([2, 1, 2, 1], [1, 2, 1, 2], [1, 1, 1, 1])
    with pytest.raises(RuntimeError, match="another order"):
        lm.counted(rows("aa cc aa"), answers, 1, ["kept"])


# ---------------------------------------------------------------- op7


def test_held_out_accuracy(spark, corpus):
    truth = {i: lang for i, _, lang in corpus}
    rows = [r for r in queries.QUERIES["op7_language_id"](spark, SF).collect() if r["held_out"]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows)
    assert rows and right >= 0.95 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def brute_phrases(text, sample):
    """Phrases of a text that are the longest found in a sample; a letter that it lacks is one."""
    i = phrases = 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in sample:
            n += 1
        phrases, i = phrases + 1, i + n
    return phrases


def plain_text(text):
    """Lower-case letters, all else as single spaces; as the operator reads a text."""
    return re.sub(" +", " ", "".join(ch.lower()[:1] if ch.isalpha() else " " for ch in text))


@given(st.lists(st.text(alphabet="ab c", max_size=60), min_size=1, max_size=4), st.text(alphabet="ab c", max_size=40), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_phrases_are_longest_matches(texts, sample, piece):
    """Whatever the size of pieces, phrases are those of one parse from the text's beginning."""
    langid.lower_letters()
    model = langid.build({"x": sample, "y": "abab ba"})
    texts = [plain_text(t) for t in texts]
    codes = model["classes"][np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
    was, langid.PIECE = langid.PIECE, piece
    got = langid.parse(model, codes, np.cumsum([0, *map(len, texts)]))
    langid.PIECE = was
    assert got.tolist() == [[brute_phrases(t, plain_text(s).lstrip()) for t in texts] for s in (sample, "abab ba")]


def test_predictions_are_those_of_brute_force(spark, corpus):
    """The query's operators against phrases counted by string search, whole texts of all kinds."""
    df = docs(spark, [(i, t, lang, "", 0) for i, t, lang in corpus])
    samples = langid.learn(df.where(queries.fold(4) != 2), docs=3)
    rows = [*sorted(corpus, key=lambda r: len(r[1] or ""))[:: max(1, len(corpus) // 25)][:25], (-1, "漢字 Ünï 123 \u0130x", "zh"), (-2, None, "en"), (-3, "12 !?", "en")]
    got = by_id(langid.identify(docs(spark, [(i, t, lang, "", 0) for i, t, lang in rows]), samples))
    own = {k: plain_text(v).lstrip() for k, v in samples.items()}
    for i, text, _ in rows:
        read = plain_text(text or "").lstrip()[:4000]
        if len(plain_text(text or "")) > 4000:
            continue
        if not read.strip():
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        bits = sorted((brute_phrases(read, s) * math.log2(max(2, len(s))), k) for k, s in own.items())
        assert got[i]["score"] == pytest.approx(1 - bits[0][0] / bits[1][0], abs=1e-9)
        assert got[i]["lang_pred"] in [k for b, k in bits if b == bits[0][0]]


def test_scripts_of_many_letters(spark):
    """Letters are told apart however many a sample has."""
    one, two = ("".join(chr(0x4E00 + 3000 * k + (i * 7) % 2000) for i in range(1500)) for k in (0, 1))
    got = langid.identify(docs(spark, [(1, one[300:400], "", "", 0), (2, two[100:190], "", "", 0)]), {"a": one, "b": two})
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {1: "a", 2: "b"}


def test_tasks_build_the_same_automata(spark):
    samples = {"en": "the quick brown fox " * 20, "de": "der schnelle braune Fuchs " * 20, "el": "αβγ δεζ Ω"}
    here, there = langid.build(samples), langid.build(samples, spark)
    assert here["names"] == there["names"] and all(np.array_equal(here[k], there[k]) for k in ("classes", "table", "root", "logs"))
    assert langid.build({}, spark)["names"] == []


def test_a_long_row_is_not_the_whole_sample(spark):
    rows = [(0, "zzzz " * 30_000, "en", "", 0), *[(i, f"own words {i}", "en", "", 0) for i in range(1, 9)], (20, "wort " * 3000, "de", "", 0)]
    samples = langid.learn(docs(spark, rows), docs=5)
    assert "zzzz" not in samples["en"] and samples["en"].count("own words") == 5 and len(samples["de"]) == 15_001


def test_languages_of_odd_rows(spark):
    df = docs(spark, [*ODD, (9, "123 !?", "en", "a", 6)]).withColumn("score", F.lit("clash"))
    assert {r["lang_pred"] for r in langid.identify(df, {}).collect()} == {"und"}
    out = langid.identify(df, {"en": "the zz of", "de": "der die das"})
    assert out.where("doc_id in (1, 2, 3, 9)").select("lang_pred").distinct().collect() == [("und",)] and out.where("doc_id = 4").first()["lang_pred"] == "en"
    assert langid.identify(docs(spark, []), {"en": "a"}).count() == 0 and langid.learn(docs(spark, [])) == {}


# ---------------------------------------------------------------- op8


@pytest.mark.parametrize("bytes_", [1 << 20, 10])
def test_windows(spark, monkeypatch, bytes_):
    monkeypatch.setattr(decontam, "ITEM_BYTES", bytes_)
    items = [(1, "One two, THREE"), (2, " ".join(f"w{i}" for i in range(15))), (3, "two three"), (4, None), (5, "!!"), (None, "zed"), (1, "one two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = {1: "x one  TWO-three y", 2: " ".join(f"w{i}" for i in range(1, 14)), 3: "one two thre", 4: "", 5: None, 6: "zed é w1", 7: "w2 " * 40_000 + "two three"}
    df = docs(spark, [(i, t, "", "", 0) for i, t in texts.items()]).withColumn("items", F.lit(0))
    got = {i: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for i, r in by_id(decontam.find_contamination(df, bench, keep=["doc_id", "items"])).items()}
    assert got == {1: (5, 3, [1, 3], True), 2: (13, 13, [2], True), 3: (3, 0, [], False), 4: (0, 0, [], False), 5: (0, 0, [], False), 6: (3, 1, [], True), 7: (40_002, 2, [3], False)}
    spans = by_id(decontam.find_contamination(df, bench))[1]["spans"]
    assert [texts[1].encode()[s["start"] : s["end"]] for s in spans] == [b"one  TWO-three"]
    assert decontam.find_contamination(df, bench.limit(0)).where("contaminated").count() == 0 and decontam.find_contamination(df.limit(0), bench).count() == 0
    monkeypatch.setattr(decontam, "MOST_BYTES", 20)
    with pytest.raises(ValueError, match="in parts"):
        decontam.find_contamination(df, bench)


def brute_windows(text, items, window):
    """Hit words and found items of a text, window by window."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
    w, hit, found = split(text), set(), set()
    for i, t in items:
        own = split(t)
        n = min(len(own), window)
        for at in range(len(own) - n + 1 if own else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == own[at : at + n]:
                    hit |= set(range(p, p + n))
                    found.add(i)
    return len(w), hit, sorted(found)


@pytest.mark.parametrize("shared", [8, 1, 0])
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=4), st.lists(st.sampled_from("abc-"), max_size=40), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_windows_are_those_of_brute_force(shared, items, text, window):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontam, "SHARED", shared)
        windows_as_brute_force(items, text, window)


def windows_as_brute_force(items, text, window):
    items = [(i, " ".join(t)) for i, t in enumerate(items)]
    n, hit, found = brute_windows(" ".join(text), items, window)
    runs, ids = decontam.Windows([(i, t.encode()) for i, t in items], window).runs(" ".join(text).replace("-", " ").encode().split())
    assert ({p for s, e in runs for p in range(s, e)}, sorted(ids)) == (hit, found)


def test_windows_of_a_passage_that_many_items_share():
    """Finds are as many for 4,000 items with one preamble as for 40, and no item is missed."""
    preamble = [f"p{i}" for i in range(15)]
    text = [w for k in range(20) for w in [*preamble, f"x{k}"]]
    spans = {}
    for n in (40, 4000):
        items = [(i, " ".join([*preamble, *(f"i{i}w{j}" for j in range(20))]).encode()) for i in range(n)]
        spans[n], ids = decontam.Windows(items, 13).runs([w.encode() for w in text])
        assert ids == set(range(n)) and {p for s, e in spans[n] for p in range(s, e)} == {p for p in range(len(text)) if p % 16 < 15}
    assert len(spans[40]) == len(spans[4000]) <= 20 * 6


def test_output_does_not_depend_on_the_cut_of_items(spark, corpus, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    df = docs(spark, [(i, t, "", "", 0) for i, t, _ in corpus])
    one = sorted(map(str, decontam.find_contamination(df, items).collect()))
    total = sum(len(r["text"].encode()) for r in items.collect())
    for parts in (2, 5):
        monkeypatch.setattr(decontam, "ITEM_BYTES", -(-total // parts))
        assert len(list(decontam.item_blocks(items, "item_id", "text"))) >= parts
        assert sorted(map(str, decontam.find_contamination(df, items).collect())) == one


# ---------------------------------------------------------------- op9


def brute_components(rows, percent, k=5):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    comp = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]]
    while changed:
        changed = False
        for a, b in links:
            least = min(comp[a], comp[b])
            if comp[a] != least or comp[b] != least:
                comp[a] = comp[b] = least
                changed = True
    return {i: (len(sets[i]), c) for i, c in comp.items()}


def test_near_duplicates_of_the_corpus(spark, corpus):
    rows = [(i, t) for i, t, _ in corpus]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op9_near_duplicates"](spark, SF).collect()}
    assert got == brute_components(rows, 85)


@pytest.mark.parametrize("block", [2048, 8])
def test_near_duplicates_in_a_crowd(spark, monkeypatch, block):
    """Many edits of one text: links that no leader gives, borderline pairs, and blocks smaller than a bucket."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in rng.integers(0, len(w), int(rng.integers(0, 5))):
            w[at] = f"x{i}{at}"
        rows.append((i + 10, " ".join(w)))
    rows += [(5, rows[3][1].upper()), (200, "a b"), (201, "A  b"), (202, "a c"), (203, ""), (204, None), (205, " ".join(base[:119]))]
    got = neardup.near_duplicates(docs(spark, [(i, t, "", "", 0) for i, t in rows]), percent=80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows, 80)


def test_near_duplicates_odd_rows(spark):
    out = neardup.near_duplicates(docs(spark, ODD)).collect()
    assert len(out) == len(ODD) and all(r["kept"] for r in out) and [r["component_id"] for r in out if r["doc_id"] is None] == [None]
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_sketches_estimate_similarity():
    """XOR counts of sketches of MinHash samples give the similarity of sets, small and large, and let pairs at the threshold pass."""
    rng = np.random.default_rng(1)
    batch, true = [], []
    for n in (30, 300, 3000, 20_000):
        for changed in (0, n // 40, n // 12, n // 3):
            w = [f"v{n}x{x}" for x in range(n)]
            v = list(w)
            for at in rng.choice(n, changed, replace=False):
                v[at] = f"q{at}"
            batch += [" ".join(w), " ".join(v)]
            true.append(len(shingles(batch[-2], 1) & shingles(batch[-1], 1)) / len(shingles(batch[-2], 1) | shingles(batch[-1], 1)))
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(batch))), pa.array(batch)], names=["id", "text"])
    signed = pa.Table.from_batches(neardup.signer(1, 2)(iter([rows]))).to_pylist()
    for a, b, like in zip(signed[::2], signed[1::2], true, strict=True):
        odd = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a["sketch"], b["sketch"], strict=True))
        left = max(1 - 2 * odd / neardup.BITS, 1 / neardup.BITS)
        differ = -neardup.BITS / 2 * math.log(left)
        sizes = np.array([a["n_shingles"], b["n_shingles"], a["n_samples"], b["n_samples"]], float)
        assert max(sizes[2:]) <= neardup.SAMPLES and (sizes[2:] <= sizes[:2]).all()
        noise = 5 * max(3, 0.15 * differ)
        # What differs is at most what is allowed at a similarity just below the true one, and not at one far above it.
        assert differ <= neardup.allowed(100 * like - 1e-6, *sizes, neardup.NUMPY) + noise
        if like < 0.9 and left > 0.05:
            assert differ > neardup.allowed(100 * like + 9, *sizes, neardup.NUMPY) - noise


def test_no_pair_at_the_threshold_is_lost(spark):
    """10,000 documents in 5,000 pairs of 85 to 90 % of like shingles, all unlike otherwise: every pair is found."""
    rng = np.random.default_rng(2)
    rows, true = [], {}
    for p in range(5000):
        w = [f"w{p}x{x}" for x in range(int(rng.integers(60, 90)))]
        v = [*w[: len(w) - int(len(w) * 0.05)], *(f"y{p}x{x}" for x in range(int(len(w) * 0.05)))]
        rows += [(2 * p, " ".join(w), "", "", 0), (2 * p + 1, " ".join(v), "", "", 0)]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        if 100 * len(a & b) >= 85 * len(a | b):
            true[2 * p + 1] = 2 * p
    assert len(true) > 3000
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, rows), percent=85).collect()}
    assert got == {i: true.get(i, i) for i in range(10_000)}


# ---------------------------------------------------------------- op10


@given(st.lists(st.tuples(st.sampled_from(["s", "t", None]), st.sampled_from(["x", "y", "", None, "z1", "z2", "z3"])), max_size=60), st.integers(1, 5))
@settings(max_examples=6, deadline=None)
def test_shards(spark, rows, n):
    data = [(i, t, "", s, 0) for i, (s, t) in enumerate(rows)]
    out = sharding.interleave(docs(spark, data), n).collect()
    counts = Counter(r["shard"] for r in out)
    assert len(out) == len(data) and (not out or max(counts.values()) - min(counts.get(s, 0) for s in range(n)) <= 1)
    for s in counts:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    assert all(r["size"] == len((rows[r["doc_id"]][1] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((rows[r["doc_id"]][1] or "").encode()) for r in out)


def test_mixture_and_groups(spark):
    data = [(i, f"t{i // 2}" if i < 40 else f"u{i}", "", "big" if i % 3 else "small", 0) for i in range(600)]
    out = sharding.interleave(docs(spark, [*data, *ODD]), 4).collect()
    for s in range(4):
        mine = [r for r in out if r["shard"] == s]
        assert abs(sum(r["source"] == "small" for r in mine) / len(mine) - 1 / 3) < 0.1
    where = {}
    for r in out:
        if r["doc_id"] is not None and 6 <= r["doc_id"] < 40:
            where.setdefault(r["doc_id"] // 2, set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def homes(out):
    """The shards of the rows of each text."""
    found = {}
    for r in out:
        found.setdefault(r["doc_id"] // 100_000, set()).add(r["shard"])
    return found


@pytest.mark.parametrize(
    ("sizes", "singles", "n", "split"),
    [
        ([6] * 6, 4, 4, 2),  # four shards of ten hold one group of six each
        ([2] * 100, 0, 4, 0),
        ([40] * 5, 800, 16, 0),  # groups of 4 % of the rows
        ([3] * 300 + [2] * 50, 0, 16, 16),
        ([70, 30, 30, 20], 50, 4, 1),  # one group is larger than a shard
        ([50, 50, 50, 50], 0, 4, 0),
        ([2] * 500 + [17, 9, 5] * 10, 700, 16, 0),
        ([], 7, 16, 0),
    ],
)
def test_groups_stay_whole(spark, sizes, singles, n, split):
    """Groups of at most a shard's rows stay in one shard wherever there is room; counts are exact. doc_id: 100,000 * group + row."""
    data = [(g * 100_000 + i, f"text {g}", "", f"s{g % 3}", 0) for g, m in enumerate(sizes) for i in range(m)]
    data += [((len(sizes) + i) * 100_000, f"own {i}", "", f"s{i % 3}", 0) for i in range(singles)]
    out = sharding.interleave(docs(spark, data), n).collect()
    counts = Counter(r["shard"] for r in out)
    assert len(out) == len(data) and max(counts.values()) - min(counts.get(s, 0) for s in range(n)) <= 1
    assert sum(len(s) > 1 for s in homes(out).values()) <= split


def test_sharding_ignores_clashing_columns(spark):
    df = docs(spark, [*ODD, (7, "Zz", "", "a", 1)])
    clash = df.withColumns({c: F.lit("own") for c in ("part", "pos", "shard", "slot", "group", "m", "first", "mix", "size")})
    assert sorted(map(str, sharding.interleave(clash, 3).collect())) == sorted(map(str, sharding.interleave(df, 3).collect()))


def test_tokenizer_file_is_json():
    with open(queries.word_tokenizer(), encoding="utf-8") as f:
        assert json.load(f)["model"]["type"] == "BPE"
