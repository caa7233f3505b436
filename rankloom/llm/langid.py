"""Language identification by cross-parsing entropy over suffix automata of labelled text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import bounded_batches
from rankloom.llm.textvec import blocks, text_bytes

#: Bound of what is learned from: whole labelled documents a language, fewer as soon as they have SAMPLE_CHARS characters.
#: Documents of more than ROW_CHARS are taken only where a language has too few others.
SAMPLE_DOCS, SAMPLE_CHARS, ROW_CHARS = 20, 100_000, 10_000
#: Characters of a text that are parsed side by side with others; what pieces begin with is parsed again from where the one before ended.
PIECE = 512


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The transitions of the states of the least automaton that reads all substrings of a text; state 0 begins."""
    step: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def packed(step: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A place for each state, no two the same, and one array of transitions: that of the state at place p by a letter
    (below ``width``) is at p + letter, if the upper half of the entry is p; the lower half is the next state's place.

    States of several letters try places drawn at random, those of most letters first; the others fill the gaps.
    """
    edges = sum(map(len, step))
    size = 2 * max(edges, len(step)) + 2 * width
    draw = Random(edges)
    used, taken, place = bytearray(size), bytearray(size), [0] * len(step)
    for s in sorted(range(len(step)), key=lambda s: -len(step[s])):
        letters = tuple(step[s])
        at = draw.randrange(size - width)
        while taken[at] or any(used[at + c] for c in letters):
            at = draw.randrange(size - width)
        place[s], taken[at] = at, 1
        for c in letters:
            used[at + c] = 1
    table, places = np.full(size, -1, np.int64), np.array(place, np.int64)
    owner = np.repeat(places, [len(x) for x in step])
    target = places[np.fromiter((t for x in step for t in x.values()), np.int64, edges)]
    table[owner + np.fromiter((c for x in step for c in x), np.int64, edges)] = owner << 32 | target
    return places, table


@cache
def lower_letters() -> tuple[np.ndarray, np.ndarray]:
    """The code points of all letters, and of their lower-case forms (the first, if it has several)."""
    points = [cp for cp in range(0x110000) if chr(cp).isalpha()]
    return np.array(points), np.array([ord(chr(cp).lower()[0]) for cp in points])


def letters_of(samples: dict[str, str]) -> list[str]:
    """The lower-case letters of all samples."""
    return sorted({low for text in samples.values() for ch in text if ch.isalpha() and (low := ch.lower()[:1])})


def classes_of(letters: list[str]) -> np.ndarray:
    """The number of each code point: 0 for no letter, then those of the samples' letters, last one for all other letters."""
    of = np.full(0x110000, len(letters) + 1, np.int32)
    of[[ord(ch) for ch in letters]] = range(1, len(letters) + 1)
    points, lower = lower_letters()
    classes = np.zeros(0x110000, np.int32)
    classes[points] = of[lower]
    return classes


def automaton_of(text: str, classes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """A language's sample as the places where each letter leads from the beginning (-1: nowhere), the transitions, and the logarithm of its length."""
    codes = classes[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    codes = codes[(codes != 0) | (np.concatenate([[0], codes[:-1]]) != 0)]
    step = suffix_automaton(codes.tolist())
    places, table = packed(step, width)
    root = np.full(width, -1, np.int64)
    root[list(step[0])] = places[list(step[0].values())]
    return root, table, float(np.log2(max(2, len(codes))))


def build(samples: dict[str, str], spark: SparkSession | None = None) -> dict:
    """The automata of all languages as one: the number of each letter (0: no letter, last: in no sample), of all states
    where their transitions lie, and of each language where every letter leads from its beginning. State 0 leads nowhere.

    With a session a task builds one language's automaton; all of them are as large as the bounded samples.
    """
    letters, names = letters_of(samples), sorted(samples)
    width = len(letters) + 2

    parts = {}
    if spark is None:
        parts = {n: automaton_of(samples[n], classes_of(letters), width) for n in names}
    elif names:
        texts = spark.sparkContext.broadcast([samples[n] for n in names])

        def automata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    root, table, log = automaton_of(texts.value[k], classes_of(letters), width)
                    yield pa.RecordBatch.from_pylist([{"lang": names[k], "root": root.tobytes(), "steps": table.tobytes(), "log": log}])

        made = spark.range(0, len(names), 1, len(names)).mapInArrow(automata, "lang string, root binary, steps binary, log double")
        parts = {r["lang"]: (np.frombuffer(r["root"], np.int64), np.frombuffer(r["steps"], np.int64), r["log"]) for r in made.collect()}
    # The state at place 0 has no transitions.
    tables, roots, size = [np.full(width, -1, np.int64)], [], width
    for name in names:
        root, table, _ = parts[name]
        roots.append(np.where(root >= 0, root + size, 0))
        tables.append(np.where(table >= 0, table + (size << 32 | size), -1))
        size += len(table)
    if size >= 1 << 31:
        raise ValueError("The samples are too large; learn from fewer characters or languages.")
    logs = np.array([parts[n][2] for n in names])
    return {"classes": classes_of(letters), "names": names, "table": np.concatenate(tables), "root": np.array(roots, np.int64).reshape(len(names), width), "logs": logs}


def parse(model: dict, codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Phrases of each text by language (languages x texts), each the longest match from where the one before ends.

    Pieces of all texts are parsed in step, as if a phrase began with each. Then the beginning of each piece is
    parsed again from where the piece before really ended, until a phrase begins where one began before: from
    there on both are the same. Where none does, the next piece is parsed again too.
    """
    table, root = model["table"], model["root"]
    n_langs, size = len(root), np.diff(off)
    pieces = -(-size // PIECE)
    text = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = off[:-1][text] + nth * PIECE
    end = np.minimum(begin + PIECE, off[1:][text])

    def stepped(lang: np.ndarray, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry = table[state + c]
        broke = entry >> 32 != state
        return np.where(broke, root[lang, c], entry & 0xFFFFFFFF), broke

    order = np.argsort(begin - end, kind="stable")
    lengths = (end - begin)[order]
    longest = int(lengths.max(initial=0))
    inside = np.arange(longest)[:, None] < lengths[None]
    read = np.zeros(inside.shape, codes.dtype)
    places = (begin[order][None] + np.arange(longest)[:, None])[inside]
    read[inside] = codes[places]
    lang = np.arange(n_langs)[:, None]
    state = np.zeros((n_langs, len(order)), np.int64)
    ends = np.zeros((longest, n_langs, len(order)), bool)
    for t, n in enumerate(inside.sum(1).tolist()):
        state[:, :n], ends[t, :, :n] = stepped(lang, state[:, :n], read[t, :n][None])
    flags = np.zeros((n_langs, len(codes)), bool)
    for k in range(n_langs):
        flags[k, places] = ends[:, k][inside]
    final = np.zeros_like(state)
    final[:, order] = state

    lanes = [(x.ravel()) for x in np.meshgrid(np.arange(n_langs), np.flatnonzero(nth > 0), indexing="ij")]
    while len(lanes[0]):
        lang, piece = lanes
        state, at = final[lang, piece - 1], begin[piece].copy()
        changed: list[tuple[np.ndarray, np.ndarray]] = []
        while len(lang):
            state, broke = stepped(lang, state, codes[at])
            apart = ~(broke & flags[lang, at])
            lang, piece, state, at, broke = (x[apart] for x in (lang, piece, state, at, broke))
            flags[lang, at] = broke
            at = at + 1
            over = at == end[piece]
            if over.any():
                moved = over & (final[lang, piece] != state)
                final[lang[moved], piece[moved]] = state[moved]
                changed.append((lang[moved], piece[moved] + 1))
                lang, piece, state, at = (x[~over] for x in (lang, piece, state, at))
        lang, piece = (np.concatenate(x) for x in zip(*changed, strict=True)) if changed else (lang, piece)
        same = piece < len(nth)
        lang, piece = lang[same], piece[same]
        lanes = [lang[nth[piece] > 0], piece[nth[piece] > 0]]
    return np.stack([np.diff(np.concatenate([[0], np.cumsum(f)])[off]) for f in flags])


def predictor(held, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds lang_pred and score to rows whose column ``at`` is the text. held: broadcast of what ``build`` gives."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            data, off = text_bytes(batch.column(at))
            langs: list[str] = []
            scores: list[float] = []
            for i, j in blocks(off, 2 << 20):
                b = data[off[i] : off[j]]
                points = np.frombuffer(b.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
                where = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])[off[i : j + 1] - off[i]]
                codes = model["classes"][points]
                before = np.concatenate([codes[:1] * 0, codes[:-1]])
                heads = where[:-1][where[:-1] < len(codes)]
                before[heads] = 0
                stay = (codes != 0) | (before != 0)
                letters = np.diff(np.concatenate([[0], np.cumsum(codes != 0)])[where])
                where = np.concatenate([[0], np.cumsum(stay)])[where]
                if model["names"]:
                    bits = parse(model, codes[stay], where) * model["logs"][:, None]
                    best = bits.argmin(0)
                    ranked = np.sort(bits, 0)
                    second = ranked[min(1, len(ranked) - 1)]
                    score = 1 - ranked[0] / np.maximum(second, 1e-9) if len(ranked) > 1 else np.ones(j - i)
                    known = letters > 0
                    langs += [model["names"][k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                    scores += np.where(known, np.clip(score, 0, 1), 0.0).tolist()
                else:
                    langs += ["und"] * (j - i)
                    scores += [0.0] * (j - i)
            rest = [i for i in range(batch.num_columns) if i != at]
            names = [batch.schema.names[i] for i in rest]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return predict


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """A bounded sample of labelled text by language: ``docs`` whole documents at most, drawn by a hash of their id and text.

    Documents of more than ROW_CHARS characters come after all others, the shorter first, and no further one is
    taken once a language has ``chars`` characters. Null texts and languages are left out, as are languages
    without a letter. Repeated rows may be drawn each.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.greatest(F.char_length(text_col), F.lit(ROW_CHARS)).alias("size"), F.xxhash64(id_col, text_col).alias("mix"), F.col(text_col).alias("text"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("size", "mix", "text"))).where(F.col("nth") <= docs)
    out: dict[str, str] = {}
    for r in rows.orderBy("lang", "nth").toLocalIterator():
        if len(out.setdefault(r["lang"], "")) < chars:
            out[r["lang"]] = f"{out[r['lang']]} {r['text']}"
    return {k: v for k, v in out.items() if any(c.isalpha() for c in v)}


def identify(docs: DataFrame, samples: dict[str, str], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text) with lang_pred and score.

    Text is lower-cased and runs of anything but letters are one space. It is cut greedily into the longest
    phrases that a language's sample holds, as its suffix automaton reads them; a letter that the sample lacks is
    a phrase of its own. Phrases * log2(sample length) / length estimates the cross entropy, and the language of
    the least wins, ties to the first name. score is 1 - least / second least. A null text, or one without a
    letter, is ``und`` with score 0. Every text is parsed whole, very long ones too. An empty sample makes every
    text ``und``; an empty table gives no rows. Repeated rows are kept apart. Kept columns that are named
    lang_pred or score are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, "lang_pred", "score")]
    rows = docs.select(*keep, text_col)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.drop(text_col).dtypes)
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(build(samples, docs.sparkSession))
    return rows.mapInArrow(predictor(held, len(keep)), f"{kinds}, lang_pred string, score double")
