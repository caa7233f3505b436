"""BPE encoding with content-defined chunks that are encoded once, and decoding."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.common import bounded_batches
from rankloom.llm.textvec import U64, blocks, mix, tables, text_bytes

#: Bytes whose rolling hash decides on a cut, and the share of word starts (1 / KEEP) that are cuts.
WINDOW, KEEP = 8, 16
#: Chunks and words in each of the two generations that a Python worker remembers; a full one becomes the old one.
CHUNKS, MEMO = 60_000, 300_000
#: The pre-tokenizer pattern of tokenizers that drop white space, their normalizers, and white space as one of them states it.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZERS = ("NFC", "Lowercase", "Replace")
SPACES = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
#: A character that stands alone between white space, to tell words apart that are encoded in one call.
MARK = "\x01"


def steps(part: dict | None, inner: str) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer, alone or in sequence."""
    if part is None:
        return []
    return part[inner] if part["type"] == "Sequence" else [part]


def splits_at_space(spec: dict) -> bool:
    """Whether a text may be cut at any white space, as far as this file can tell.

    The pattern's alternatives hold no white space and look at nothing around them, and what lies between
    matches is dropped, so matching begins anew after white space. Normalizers work on characters (with the
    combining ones after them; none combines with a space). Added tokens must not hold white space.
    """
    norm, pre = steps(spec["normalizer"], "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers")
    if spec["model"]["type"] != "BPE" or not pre or pre[0]["type"] != "Split" or pre[0]["pattern"] != {"Regex": WORD_PATTERN}:
        return False
    if pre[0]["behavior"] != "Removed" or not pre[0]["invert"] or any(p["type"] != "ByteLevel" or p["use_regex"] or p["add_prefix_space"] for p in pre[1:]):
        return False
    if any(n["type"] not in NORMALIZERS or (n["type"] == "Replace" and n != SPACES) for n in norm):
        return False
    return not any(any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])


class Memory:
    """Two generations of what was encoded, by bytes."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def all(self, keys: list[bytes], make: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The ids of each key; ``make`` gives those of the keys that aren't remembered, each once."""
        if len(self.new) > self.size:
            self.new, self.old = {}, self.new
        found = list(map(self.new.get, keys))
        if None in found:
            missing = dict.fromkeys(k for k, f in zip(keys, found, strict=True) if f is None)
            fresh = []
            for k in missing:
                ids = self.old.get(k)
                if ids is None:
                    fresh.append(k)
                else:
                    self.new[k] = ids
            if fresh:
                self.new.update(zip(fresh, make(fresh), strict=True))
            found = list(map(self.new.__getitem__, keys))
        return found


class Codec:
    """Encodes texts through remembered chunks; exactly what the tokenizer gives for the whole text."""

    def __init__(self, tokenizer_json: str, keep: int = KEEP, memo: int = MEMO, chunks: int = CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keep, self.chunks, self.pairs, self.words = keep, Memory(chunks), Memory(chunks), Memory(memo)
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype(np.uint16 if n <= 1 << 16 else np.uint32)
        self.pieces = [self.tokenizer.id_to_token(i) or "" for i in range(n)] if self.tokenizer.decoder is None else None
        spec = json.loads(tokenizer_json)
        self.proven = splits_at_space(spec)
        self.lowers = self.proven and any(n["type"] == "Lowercase" for n in steps(spec["normalizer"], "normalizers"))
        # An added token could begin or end inside a word, and is told before letters are lower-cased: texts that hold one go whole.
        self.added = [t["content"].encode().lower() for t in spec["added_tokens"]]
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = np.arange(n) == mark[0] if len(mark) == 1 else None
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(n)]) if suffix and self.proven else None
        self.repairs = 0

    def whole(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as the tokenizer gives them."""
        out: list[bytes] = []
        for i in range(0, len(texts), 1024):
            found = self.tokenizer.encode_batch_fast([t.decode() for t in texts[i : i + 1024]], add_special_tokens=False)
            out += [np.array(e.ids, self.kind).tobytes() for e in found]
        return out

    def split(self, words: list[bytes], sep: bytes, last: np.ndarray, skip: int) -> list[bytes]:
        """The ids of words that are encoded in one text with ``sep`` between them. ``last`` tells of each id whether a
        word ends at it (skip 0) or before it (skip 1)."""
        ids = np.array(self.tokenizer.encode_batch_fast([sep.join(words).decode()], add_special_tokens=False)[0].ids, self.kind)
        w, raw = self.kind.itemsize, ids.tobytes()
        ends = np.flatnonzero(last[ids]) + 1 - skip
        if len(ends) != len(words) - skip:
            return self.whole(words)
        starts, stops = [0, *((ends + skip) * w).tolist()], [*(ends * w).tolist(), len(raw)]
        return [raw[s:e] for s, e in zip(starts[: len(words)], stops[: len(words)], strict=True)]

    def apart(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word. Words go in long texts, as a call for each costs more than its encoding.

        A word of ASCII letters is one match of the pattern and ends with the one id that has the suffix of word
        ends; between other words there is a mark.
        """
        done: dict[bytes, bytes] = {}
        plain = [w for w in words if w.isalpha()] if self.ends is not None else []
        for i in range(0, len(plain), 2048):
            part = plain[i : i + 2048]
            done.update(zip(part, self.split(part, b" ", self.ends, 0), strict=True))
        rest = [w for w in words if w not in done]
        for i in range(0, len(rest), 2048):
            part = rest[i : i + 2048]
            marked = self.mark is not None and not any(MARK.encode() in w for w in part)
            done.update(zip(part, self.split(part, f" {MARK} ".encode(), self.mark, 1) if marked else self.whole(part), strict=True))
        return list(map(done.__getitem__, words))

    def cuts(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where chunks begin: every text, and the word starts that the rolling hash of the bytes before them picks."""
        space = tables()[1][b]
        at = np.flatnonzero(space[:-1] & ~space[1:]) + (1 if self.proven else 0)
        at = at[at >= WINDOW]
        h = np.zeros(len(at), U64)
        for j in range(1, WINDOW + 1):
            h = (h << U64(8)) | b[at - j].astype(U64)
        cut = np.zeros(len(b) + 1, bool)
        cut[at[mix(h) % U64(self.keep) == 0]] = cut[off] = True
        return np.flatnonzero(cut[:-1])

    def by_words(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of chunks by their words: runs without white space, cut again where ASCII marks other than ' follow an ASCII letter.

        At the second cut one alternative of the pattern ends and another begins, whatever is around it.
        """
        raw = b" ".join(chunks)
        b = np.frombuffer(raw, np.uint8)
        ink = np.concatenate([[False], ~tables()[1][b], [False]])
        inner = np.flatnonzero(letter_table()[b[:-1]] & mark_table()[b[1:]]) + 1
        starts, ends = np.flatnonzero(ink[1:] & ~ink[:-1]), np.flatnonzero(ink[:-1] & ~ink[1:])
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        ids = self.words.all([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], self.apart)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)])).tolist()
        return [b"".join(ids[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """The ids of some texts of one buffer, by their n + 1 offsets."""
        b = data[off[0] : off[-1]]
        off = off - off[0]
        raw = b.tobytes()
        given, low = raw, raw.lower()
        special = [any(t in low[s:e] for t in self.added) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)] if any(t in low for t in self.added) else []
        if self.lowers:
            raw, b = low, np.frombuffer(low, np.uint8)
        if not raw:
            return [np.zeros(0, self.kind)] * (len(off) - 1)
        starts = self.cuts(b, off)
        ends = np.append(starts[1:], len(b))
        chunks = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids = self.chunks.all(chunks, self.by_words if self.proven else self.whole)
        first = np.searchsorted(starts, off).tolist()
        agree = np.ones(len(chunks), bool)
        if not self.proven:
            inner = np.flatnonzero(~np.isin(starts, off)).tolist()
            both = self.pairs.all([chunks[k - 1] + chunks[k] for k in inner], self.whole)
            agree[inner] = [x == ids[k - 1] + ids[k] for k, x in zip(inner, both, strict=True)]
        out = []
        for d, (i, j) in enumerate(zip(first[:-1], first[1:], strict=True)):
            if special and special[d]:
                joined = self.whole([given[off[d] : off[d + 1]]])[0]
            else:
                joined = b"".join(ids[i:j]) if agree[i + 1 : j].all() else self.repaired(chunks[i:j], ids[i:j])
            out.append(np.frombuffer(joined, self.kind))
        return out

    def repaired(self, chunks: list[bytes], ids: list[bytes]) -> bytes:
        """The ids of chunks in a row some of which don't agree with their neighbours.

        Two neighbours agree where both encoded together give the ids of each alone. Where they don't, they are
        one run from there on, encoded as one, which grows to the left and right until both its ends agree. A
        row of tokens is what BPE gives as soon as it gives every two neighbours of it, so this is enough.
        """
        runs: list[tuple[bytes, bytes]] = []
        for c, i in zip(chunks, ids, strict=True):
            while runs:
                before, known = runs[-1]
                both = self.whole([before + c])[0]
                if both == known + i:
                    break
                runs.pop()
                c, i = before + c, both
                self.repairs += 1
            runs.append((c, i))
        return b"".join(i for _, i in runs)

    def decode(self, ids: list[int]) -> str:
        if self.pieces is None:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.pieces.__getitem__, ids))


def letter_table() -> np.ndarray:
    """ASCII letters."""
    out = np.zeros(256, bool)
    out[[*range(65, 91), *range(97, 123)]] = True
    return out


def mark_table() -> np.ndarray:
    """Printing ASCII that is neither letter nor digit nor '."""
    out = np.zeros(256, bool)
    out[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
    out[ord("'")] = False
    return out


def codec(held) -> Codec:
    """The worker's codec. held: broadcast {"json": ..., "keep": ...}."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    state = held.value
    if "built" not in state:
        state["built"] = Codec(state["json"], state["keep"])
    return state["built"]


def encoder(held, at: int, digests: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces column ``at``, the text, by n_tokens and ids, or by n_tokens and the digests of ids and decoded text."""

    def digest(c: Codec, digits: list[str], ids: list[int]) -> tuple[str, str]:
        listed = " ".join(map(digits.__getitem__, ids))
        return hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held)
        digits = [str(i) for i in range(c.tokenizer.get_vocab_size(with_added_tokens=True))] if digests else []
        for batch in batches:
            data, off = text_bytes(batch.column(at))
            rest = [i for i in range(batch.num_columns) if i != at]
            names = [*(batch.schema.names[i] for i in rest), "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids"])]
            for i, j in blocks(off):
                ids = c.encode(data, off[i : j + 1])
                if digests:
                    two = [digest(c, digits, x.tolist()) for x in ids]
                    found = [pa.array([x[k] for x in two], pa.string()) for k in (0, 1)]
                else:
                    found = [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in rest), pa.array([len(x) for x in ids], pa.int64()), *found], names=names)

    return encode


def _held(df: DataFrame, tokenizer_path: str, keep: int):
    bounded_batches(df.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast({"json": f.read(), "keep": keep})


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: int = KEEP, digests: bool = False) -> DataFrame:
    """All columns but the text, with n_tokens and ids (array<int>), or with ``digests`` ids_sha256 and decoded_sha256.

    Ids are those of the tokenizer for the whole text, without special tokens added. Texts are cut at word
    starts where a rolling hash of the bytes before says so (one in ``keep``), so equal passages of different
    documents give equal chunks. A worker encodes each chunk once and remembers CHUNKS of them and MEMO words
    that new chunks are made of, each in two generations; a task needs no other task, and nothing is shuffled.
    Joins are right by construction where ``splits_at_space`` holds of the tokenizer; with others every join
    is checked by encoding both sides together and repaired by encoding longer and longer runs of chunks as
    one until both ends agree. Null texts are empty. Very long texts are one block of work. Columns that are
    named like a result are replaced.
    """
    rest = [c for c in docs.columns if c not in (text_col, "n_tokens", "ids", "ids_sha256", "decoded_sha256")]
    kinds = "".join(f"`{c}` {t}, " for c, t in docs.select(*rest).dtypes)
    out = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    held = _held(docs, tokenizer_path, keep)
    return docs.select(*rest, text_col).mapInArrow(encoder(held, len(rest), digests), f"{kinds}n_tokens long, {out}")


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns but the ids, with the decoded text; null ids are none."""
    rest = [c for c in encoded.columns if c not in (ids_col, "text")]
    kinds = "".join(f"`{c}` {t}, " for c, t in encoded.select(*rest).dtypes)
    held = _held(encoded, tokenizer_path, KEEP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held)
        for batch in batches:
            texts = [c.decode(x.as_py() or []) for x in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], names=[*rest, "text"])

    return encoded.select(*rest, ids_col).mapInArrow(run, f"{kinds}text string")
