"""Nearest neighbours, runs of words and phrases: against brute force and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import collocations, curves, queries, runs
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "x y", None, "a", 3), (3, "\n\n", "fr", "b", 2), (4, "Zz " * 3000, "fr", "b", 9000), (4, "Zz " * 3000, "fr", "b", 9000), (5, "é ß 漢字 \U0001f600", "de", "c", 8)]


# ---------------------------------------------------------------- nearest neighbours


@pytest.mark.parametrize("dimensions, bits", [(2, 4), (3, 3), (5, 2), (1, 6)])
def test_hilbert_visits_all_places_step_by_step(dimensions, bits):
    axes = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    keys = curves.hilbert(axes, bits)
    assert sorted(keys) == list(range(len(axes)))
    path = axes[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def brute_neighbours(rows, asked, k):
    ok = {i: v for i, v in sorted(rows, key=lambda r: str(r[1]), reverse=True) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids, m = np.array(sorted(ok)), np.array([np.float32(ok[i]) for i in sorted(ok)], np.float64)
    out = {}
    for i in asked:
        if i in ok:
            far = np.sqrt(((m - np.float32(ok[i]).astype(np.float64)) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, far)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), far[j]) for j in order]
    return out


def found_by(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    assert got.keys() == want.keys() and all(len(got[i]) == len(want[i]) for i in want)
    for rows in got.values():
        assert rows == sorted(rows, key=lambda x: (x[1], x[0]))
    return sum(len({v for v, _ in got[i]} & {v for v, _ in want[i]}) for i in want) / max(1, sum(map(len, want.values())))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_neighbours_are_found(spark, sf):
    sf = SF.replace("sf0.001", sf)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_neighbours(rows, [i for i, _ in rows if i % 100 == 0], 10)
    got = found_by(queries.QUERIES["op11_hilbert_neighbours"](spark, sf))
    assert recall(got, want) >= 0.9
    exact = {(i, v): d for i, hits in want.items() for v, d in hits}
    assert all(abs(exact.get((i, v), d) - d) < 1e-9 for i, hits in got.items() for v, d in hits)


def test_neighbours_over_many_cells(spark, monkeypatch):
    """Clusters, a vector that a third of all rows have, and windows that cross cells."""
    monkeypatch.setattr(curves, "CELL", 64)
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + 0.1 * r.standard_normal(16)).astype(np.float32).tolist()) for i in range(3000)]
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    items = spark.createDataFrame(rows, "id long, vector array<float>")
    got = found_by(curves.nearest_neighbours(items.where("id % 10 = 0"), items, k=10, least_window=24))
    assert recall(got, brute_neighbours(rows, range(0, 3000, 10), 10)) >= 0.95
    assert [v for v, _ in got[0]] == [3 * j for j in range(1, 11)] and [v for v, _ in got[300]] == [3 * j for j in range(10)]


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.0, -0.0]), (None, [1.0, 1.0]), (7, []), (8, [2.0]), (9, [-0.0, 5.0])]
    odd = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, vector array<float>, rank string, cell int")
    got = found_by(curves.nearest_neighbours(odd, odd, k=3))
    assert got == {0: [(1, 0.0), (8, 1.0), (9, 26**0.5)], 1: [(0, 0.0), (8, 1.0), (9, 26**0.5)], 8: [(0, 1.0), (1, 1.0), (9, 29**0.5)], 9: [(0, 26**0.5), (1, 26**0.5), (8, 29**0.5)]}
    assert curves.nearest_neighbours(odd, odd.limit(0)).count() == 0 and curves.nearest_neighbours(odd.limit(0), odd).count() == 0
    one = odd.where("id = 0")
    assert curves.nearest_neighbours(one, one).count() == 0


def test_windows_widen_until_neighbours_are_in_them():
    gaps = np.tile(np.arange(1001) * 10, (24, 1))
    assert curves.fitted_window(gaps, 10) == 9501 and curves.fitted_window(gaps[:, :0], 10) == 10
    gaps[5] = 3
    assert curves.fitted_window(gaps, 10) == 10


# ---------------------------------------------------------------- runs


def brute_runs(w, least=6, times=4):
    n, out = len(w), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            long = j + p - i
            if j > i and long >= max(least, times * p) and not any(all(w[x] == w[x + q] for x in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, long, p))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, found):
    gone = {j for s, n, q in found for j in range(s + q, s + n)}
    return " ".join(x for j, x in enumerate(w) if j not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(0, 59), st.integers(1, 12), st.sampled_from([3, 4, 5]))
def test_runs_are_all_found(w, a, p, times):
    w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    got = list(zip(*(x.tolist() for x in runs.find_runs(np.array(w, np.int64), 6, times)), strict=True))
    assert got == brute_runs(w, 6, times)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.data())
def test_range_successors(values, data):
    order = np.argsort(np.argsort(values, kind="stable"), kind="stable")
    low = data.draw(st.integers(0, len(values)))
    high = data.draw(st.integers(low, len(values)))
    bound = data.draw(st.integers(0, len(values) - 1))
    got = runs.WaveletTree(order).successor(np.array([low]), np.array([high]), np.array([bound]))
    assert got[0] == min((v for v in order[low:high] if v > bound), default=-1)


def planted(doc_id, w):
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def run_row(doc_id, text):
    w = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = brute_runs(w)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(brute_collapsed(w, found)))


def test_runs_of_documents(spark, tmp_path):
    """Short documents of the table, planted ones among them, and odd rows, each against brute force."""
    small = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"] or "") < 3000]
    odd = [(r[0], r[1][:600] if r[1] else r[1]) for r in ODD] + [(i, " a\x0bb\tA b a b a b\n" * 3 + f"c {i}") for i in range(1000, 1040)]
    spark.createDataFrame(small + odd, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((run_row(*r) for r in small + odd), key=str)
    assert sum(r[1] > 0 for r in got) > 20


def test_runs_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ODD], DOCS + ", runs string").withColumnRenamed("runs", "__text")
    got = {(r["doc_id"], r["collapsed"]): [tuple(x) for x in r["runs"]] for r in runs.periodic_runs(docs, keep=["doc_id"]).collect()}
    assert got == {(1, ""): [], (2, ""): [], (None, "x y"): [], (3, ""): [], (4, "Zz"): [(0, 3000, 1)], (5, "é ß 漢字 \U0001f600"): []}
    assert runs.periodic_runs(docs.limit(0), keep=["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="times"):
        runs.periodic_runs(docs, keep=[], times=2)


def test_long_texts_are_searched_whole():
    """A run over most of a text of 400,000 words, whose period is a quarter of it."""
    r = np.random.default_rng(5)
    w = np.concatenate([r.integers(0, 500, 1000), np.tile(r.integers(0, 500, 99_000), 5)[:399_000]])
    start, length, period = runs.find_runs(w, 6, 4)
    assert (1000, 399_000, 99_000) in set(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) or (w[999] == w[99_999])


# ---------------------------------------------------------------- phrases


def brute_phrases(rows, least, covered=50, top=2000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out, f = [], {}
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                f.setdefault("und" if lang is None else lang, Counter()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= covered * a for q, b in candidates.items()):
                continue
            cuts = [(1000000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        n = sum(c for p, c in count.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def test_phrases_of_random_texts(spark, monkeypatch):
    """Chunks, portions and batches of a few words; hot words; marks and odd bytes; null languages."""
    monkeypatch.setattr(collocations, "CHUNK", 40)
    r = random.Random(4)
    text = lambda: "".join(r.choice(["the ", "The ", "cat ", "sat ", "on ", "É ", "a\x00b ", "x\ty ", ". ", "\n", "w%d " % r.randrange(30)]) for _ in range(r.randrange(60)))
    rows = [(text(), r.choice(["en", "fr", None, "und"])) for _ in range(200)] + [(None, "en"), ("", None), (" . \n", "de"), ("one", "de")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "text string, lang string, a int").repartition(5)
    for least in (2, 10):
        got = sorted(tuple(x[:8]) for x in collocations.collocations(docs, least=least, top=50).collect())
        assert got == brute_phrases(rows, least, top=50) and got
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert {"the"} < {w for x in got for w in x[2].split()}


def test_counts_beyond_64_bits(spark, monkeypatch):
    """Scores of counts whose products pass 64 bits are exact."""
    a, l, r = 123_456_789_012, 523_456_789_013, 323_456_789_017
    counts = spark.createDataFrame([("en", "x", None, None, l), ("en", "y", None, None, r), ("en", "x", "y", None, a)], "lang string, a string, b string, c string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda docs, least: counts)
    (row,) = collocations.collocations(None).collect()
    assert row["score"] == int(Fraction(1000000 * a * a, l * r)) and row["n"] == l + r


def test_stripes_of_a_hot_word_are_cut(spark):
    """No part of a stripe has much more than a thousandth of all words, and nothing is lost by the cut."""
    rows = [(" ".join(f"hot w{i * 7 % 5000} w{i % 90}" for i in range(j, j + 400)), "en") for j in range(0, 8000, 400)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = {(r["a"], r["b"], r["c"]): r["n"] for r in collocations.phrase_counts(docs, 2).collect()}
    want = Counter()
    for text, _ in rows:
        w = text.split()
        want.update((w[i], None, None) for i in range(len(w)))
        want.update((*w[i : i + 2], None) for i in range(len(w) - 1))
        want.update(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    assert got == {p: n for p, n in want.items() if n >= 2 or p[1] is None}
    shares = collocations.parts_of({"hot": 334})
    batch = docs.toArrow().to_batches()[0].select(["lang", "text"])
    cut = [b.column("part").to_pylist() for b in shares(iter([batch]))]
    assert len(set(sum(cut, []))) > 300
