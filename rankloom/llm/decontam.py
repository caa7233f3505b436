"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import bounded_batches

#: UTF-8 bytes of test items that one automaton holds, and that a test set may have at most. A test set of more than
#: one automaton is scanned for in turn over BUFFER bytes of texts at a time, so that no task holds more than one of them.
ITEM_BYTES, MOST_BYTES, BUFFER = 16 << 20, 512 << 20, 64 << 20
#: Places of a piece in the items up to which each is looked at by itself.
SHARED = 8

OUT = "n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long>>"


def normal_table() -> bytes:
    """Bytes of a text -> A-Z lower-cased, a-z, 0-9 and all of non-ASCII kept, anything else a space."""
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in keep else 32 for b in range(256))


class Windows:
    """An Aho-Corasick automaton over the words of test items, and where it finds their windows.

    A window of w words of an item holds a whole piece of (w + 1) / 2 words of the item's cut into such pieces,
    so the automaton has the pieces, each word of an item once. Items of fewer than w words are pieces of their
    own. A word is two symbols of about the square root of the number of words, as a state's transitions are
    searched one by one. A piece that few items have is extended to both sides along each of them. Of a piece in more than SHARED
    places all windows that hold it are listed once, with the items that have them, and are looked up around each
    find: as many steps as a window has places for its piece, however many items share it.
    """

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        import ahocorasick

        table, self.size = normal_table(), (window + 1) // 2
        self.window, self.number, self.items = window, {}, []
        pieces: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, text in items:
            words = tuple(self.number.setdefault(w, len(self.number) + 1) for w in text.translate(table).split())
            if not words:
                continue
            nth = len(self.items)
            self.items.append((item, array("i", words)))
            for at in range(0, len(words) - self.size + 1, self.size) if len(words) >= window else (0,):
                pieces.setdefault(words[at : at + self.size] if len(words) >= window else words, []).append((nth, at))
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.base = isqrt(len(self.number)) + 1
        #: Lists of items, each once.
        self.lists: dict[tuple[int, ...], tuple[int, ...]] = {}
        for piece, places in pieces.items():
            self.found.add_word(self.symbols(piece), (len(piece), places, self.around(places) if len(places) > SHARED else None))
        if pieces:
            self.found.make_automaton()

    def symbols(self, words: Iterable[int]) -> tuple[int, ...]:
        """Two for each word."""
        return tuple(chain.from_iterable(divmod(w, self.base) for w in words))

    def around(self, places: list[tuple[int, int]]) -> dict[tuple[int, int], dict[bytes, tuple[int, ...]]]:
        """The windows that hold a piece, by the number of words before it and of the window: its words, and the items that have it."""
        out: dict[tuple[int, int], dict[bytes, list[int]]] = {}
        for nth, at in places:
            own = self.items[nth][1]
            width = min(self.window, len(own))
            # A short item is its own piece and only window.
            for before in range(max(0, at + width - len(own)), min(at, width - self.size) + 1) if width == self.window else (0,):
                has = out.setdefault((before, width), {}).setdefault(own[at - before : at - before + width].tobytes(), [])
                if not has or has[-1] != nth:
                    has.append(nth)
        return {where: {w: self.lists.setdefault(t, t) for w, t in ((w, tuple(has)) for w, has in some.items())} for where, some in out.items()}

    def runs(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int | None]]:
        """(first word, word after the last) of passages of a text whose words are all in windows, and the ids of their items."""
        if not words or not len(self.found):
            return [], set()
        text = array("i", map(self.number.get, words, repeat(0)))
        done: dict[tuple[int, int], int] = {}
        spans: list[tuple[int, int]] = []
        seen: set[int] = set()
        listed: dict[int, tuple[int, ...]] = {}
        for last, (size, places, around) in self.found.iter(self.symbols(text)):
            # What ends within a word is no find.
            if last % 2 == 0:
                continue
            start = last // 2 + 1 - size
            if around is not None:
                for (before, width), windows in around.items():
                    low, high = start - before, start - before + width
                    has = windows.get(text[low:high].tobytes()) if low >= 0 and high <= len(text) else None
                    if has is not None:
                        spans.append((low, high))
                        listed[id(has)] = has
                continue
            for nth, at in places:
                own = self.items[nth][1]
                # A run along one item at one offset is found by its first piece.
                if done.get((nth, start - at), -1) > start:
                    continue
                low, high = at, at + size
                while low and start - at + low and own[low - 1] == text[start - at + low - 1]:
                    low -= 1
                while high < len(own) and start - at + high < len(text) and own[high] == text[start - at + high]:
                    high += 1
                done[nth, start - at] = start - at + high
                if high - low >= min(self.window, len(own)):
                    spans.append((start - at + low, start - at + high))
                    seen.add(nth)
        for has in listed.values():
            seen.update(has)
        return spans, {self.items[nth][0] for nth in seen}


def scanner(held: list, window: int, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds OUT to rows whose column ``at`` is the text in UTF-8. held: broadcasts {"items": [(id, text)]}, one for each automaton."""

    def automaton(part) -> Windows:
        state = part.value
        if len(held) > 1:
            return Windows(state["items"], window)
        if "built" not in state:
            state["built"] = Windows(state["items"], window)
        return state["built"]

    def words_of(value: pa.BinaryScalar, table: bytes) -> bytes:
        raw = value.as_buffer()
        return bytes(raw).translate(table) if raw is not None else b""

    def result(flat: bytes, runs: list[tuple[int, int]], ids: set[int | None]) -> tuple[int, int, list[int], list[dict]]:
        words = flat.split()
        if not runs:
            return len(words), 0, [], []
        hit = np.zeros(len(words) + 1, np.int64)
        np.add.at(hit, [s for s, _ in runs], 1)
        np.add.at(hit, [e for _, e in runs], -1)
        hit = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
        # Where hit words stand in the text itself, in UTF-8 bytes.
        b = np.frombuffer(flat, np.uint8) != 32
        heads = np.flatnonzero(b & ~np.concatenate([[False], b[:-1]]))
        cuts = np.flatnonzero(np.diff(hit) > 1)
        starts, stops = hit[np.concatenate([[0], cuts + 1])], hit[np.concatenate([cuts, [len(hit) - 1]])]
        spans = [{"start": int(heads[s]), "end": int(heads[e]) + len(words[e])} for s, e in zip(starts, stops, strict=True)]
        return len(words), len(hit), sorted(ids - {None}), spans

    def scanned(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = normal_table()
        runs: list[list[tuple[list, set]]] = [[([], set()) for _ in range(b.num_rows)] for b in batches]
        for part in held:
            patterns = automaton(part)
            for batch, found in zip(batches, runs, strict=True):
                for value, (spans, ids) in zip(batch.column(at), found, strict=True):
                    more, of = patterns.runs(words_of(value, table).split())
                    spans += more
                    ids |= of
        for batch, found in zip(batches, runs, strict=True):
            n_words, n_hit, items, spans = zip(*(result(words_of(v, table), *r) for v, r in zip(batch.column(at), found, strict=True)), strict=True)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, kind)]
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *cols], names=[*(batch.schema.names[i] for i in rest), "n_words", "n_hit", "items", "spans"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = BUFFER if len(held) > 1 else 0
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.column(at).nbytes
            if size > most:
                yield from scanned(waiting)
                waiting, size = [], 0
        if waiting:
            yield from scanned(waiting)

    return scan


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, bytes]]]:
    """The test items in blocks of ITEM_BYTES or of one longer item, of which the driver holds one at a time; at least one block."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t"))
    total = rows.select(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    if total > MOST_BYTES:
        raise ValueError(f"A test set of {total} bytes is over the {MOST_BYTES} that are broadcast; give it in parts.")
    block: list[tuple[int | None, bytes]] = []
    size = 0
    for r in rows.toLocalIterator():
        if block and size + len(r["t"]) > ITEM_BYTES:
            yield block
            block, size = [], 0
        block.append((r["i"], bytes(r["t"])))
        size += len(r["t"])
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, percent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per document the columns ``keep`` (the id) and n_words, n_hit, n_items, items, spans, contaminated.

    Texts are lower-cased in A-Z; words are runs of ASCII letters, digits and all non-ASCII. A window is
    ``window`` words of an item in a row, or a whole shorter item. A document word inside any occurrence of a
    window is hit; spans are the hit passages of the original text as UTF-8 byte offsets. Contaminated: some
    word is hit and at least ``percent`` % of the words are.

    A test set is a fixed list that doesn't grow with the corpus: its size is checked before it is read, and one
    over MOST_BYTES is refused. Up to ITEM_BYTES it is one automaton; a larger one is several, whose finds are
    joined word by word, so the result doesn't depend on how items are cut. The corpus is never shuffled. Null
    texts and texts without words have no words and no hits. Items without words match nothing; items with a null
    id count as hits but aren't listed; repeated ids are listed once. Rows are kept apart, repeated ids too. An
    empty table gives no rows. Kept columns that are named like a result are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")
    keep = [c for c in ([id_col] if keep is None else keep) if c not in own]
    docs = docs.select(*keep, F.col(text_col).cast("binary").alias("__scanned"))
    schema = "".join(f"`{c}` {t}, " for c, t in docs.drop("__scanned").dtypes) + OUT
    parts = [spark.sparkContext.broadcast({"items": block}) for block in item_blocks(benchmark, item_col, item_text_col)]
    out = docs.mapInArrow(scanner(parts, window, len(keep)), schema)
    over = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", over)
