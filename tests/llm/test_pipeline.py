"""The corpus pipeline, stage by stage, against brute force."""

import hashlib
import re
from collections import Counter

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm.common import LOWER, UPPER, shared_dir, stored
from rankloom.llm.queries import QUERIES, word_tokenizer
from tests.conftest import SF
from tests.llm.test_operators import ODD, brute_components, docs


def dirty(text, items):
    """Whether 5 % of a text's words lie in windows of 13 words, or whole shorter items."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(str.maketrans(UPPER, LOWER)))
    windows = {tuple(w[i : i + min(13, len(w))]) for w in map(split, items) for i in range(max(1, len(w) - 12)) if w}
    w, hit = split(text), set()
    for n in {len(x) for x in windows}:
        hit |= {p for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages_on_the_corpus(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in df.collect()}
    steps = []
    for name, stage in P.STAGES:
        df = stored(stage(spark, df, SF), "test-stage")
        steps.append((name, {r["doc_id"]: r for r in df.collect()}))
    named = dict(steps)
    assert set(named["language_id"]) == {i for i, t in before.items() if t and re.search(r"[^\W\d_]", t)}
    predicted = {r["doc_id"]: r["lang_pred"] for r in QUERIES["op7_language_id"](spark, SF).collect()}
    assert all(r["lang"] == predicted[i] for i, r in named["language_id"].items())

    lines = {i: r["text"].split("\n") for i, r in named["language_id"].items()}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    seen = Counter(k for ls in lines.values() for k in {key(x) for x in ls} if k)
    used, expected = set(), {}
    for i in sorted(lines):
        kept = []
        for x in lines[i]:
            k = key(x)
            if not k or seen[k] < 10 or k not in used:
                kept.append(x)
            if k:
                used.add(k)
        expected[i] = "\n".join(kept)
    assert {i: r["text"] for i, r in named["line_dedup"].items()} == expected and all(r["n_chars"] == len(r["text"]) for r in named["line_dedup"].values())

    groups = brute_components([(i, t) for i, t in expected.items()], 80)
    assert set(named["near_dedup"]) == {i for i, (_, c) in groups.items() if i == c}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(named["decontaminate"]) == {i for i, r in named["near_dedup"].items() if not dirty(r["text"], items)} < set(named["near_dedup"])
    plain = Tokenizer.from_file(word_tokenizer())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(named["tokenize"]) == set(named["decontaminate"])
    for i, r in named["tokenize"].items():
        ids = plain.encode(named["decontaminate"][i]["text"], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"] for r in P.run(spark, SF).collect()} == set(named["tokenize"])


def test_stages_on_odd_and_no_rows(spark):
    for rows in (ODD, []):
        df = docs(spark, rows).withColumns({"score": F.lit(1), "lang_pred": F.lit("x"), "items": F.lit(2), "words": F.lit(3)})
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns
            df = stored(out, "odd")
        assert P.STAGES[-1][1](spark, df, SF).count() == df.count()


def test_copies_emptied_by_line_dedup_go(spark):
    copies = [(i, "Same line\n\n  other LINE ", "en", "a", 0) for i in range(12)]
    rest = [(20, "same line\nown words", "en", "a", 0), (21, "\n \n", "en", "a", 0), (22, "", "en", "a", 0), (23, None, "en", "a", 0)]
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in P.line_dedup(spark, docs(spark, copies + rest), SF).collect()}
    assert out == {0: (copies[0][1], 24), 20: ("own words", 9), 21: ("\n \n", 3), 22: ("", 0), 23: (None, None)}
    df = docs(spark, copies)
    for name, stage in P.STAGES[1:]:
        df = stored(stage(spark, df, SF), name)
    assert [r["doc_id"] for r in df.collect()] == [0]


def test_a_cluster_must_name_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)
