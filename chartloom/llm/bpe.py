"""BPE encoding and decoding with a contiguous rank array for each word.

A short word is a row of parts; its part ids and the merge ranks of adjacent parts lie in two contiguous rows. The
smallest rank is found by a scan, the boundary it stands for is deleted, and the two ranks beside it are refreshed, until
no rank is left. Different words of equal width share a matrix, so that one step scans all of them. Words of more than `SCAN` parts,
where scanning would be quadratic, go through a heap over the same merges.

Reads a tokenizers file of the kind "BPE with word ends" (NFC, white space to one blank, lower case; byte-level symbols).
Ids are those of the tokenizers library with add_special_tokens=False; strings of special tokens in a text give their ids.

Cases: null text is an empty text; an empty text or one of white space only has no ids and decodes to an empty text;
repeated rows and null document ids each give a row; columns not asked for are left out.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Parts up to which a word's ranks are scanned.
SCAN = 128
#: Characters merged at a time, and rows handled at a time inside a batch; a matter of memory only.
CHARS = 1_500_000
ROWS = 512
#: The rules that the file must state.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Letters, numbers and lower cases (offset) of Unicode 16 and later, which unicodedata may lack.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
NEW_LOWER = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
]

#: Above every rank; ranks are held with a word's place in 7 bits.
_NONE = np.int32(2**24 - 1)
#: Characters whose lower case needs a table.
_ODD = re.compile("[\u03a3\u1c89\ua7cb-\ua7dc\U00010d50-\U00016eb8]")
#: What the tokenizer takes for white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile("[" + BLANKS + "]")
_BLANK, _LETTER, _NUMBER, _OTHER = range(4)
_BYTE_HASH = np.random.default_rng(8).integers(1, 1 << 63, 256, np.uint64)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@cache
def _kinds() -> np.ndarray:
    """Of each code point: blank, letter, number or other."""
    kinds = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    first = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    kinds[first == "L"], kinds[first == "N"] = _LETTER, _NUMBER
    for kind, spans in ((_LETTER, NEW_LETTERS), (_NUMBER, NEW_NUMBERS)):
        for a, b in spans:
            kinds[a : b + 1] = kind
    kinds[[ord(c) for c in BLANKS]] = _BLANK
    return kinds


@cache
def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and their inverses."""
    up, down = _power_table(1 << max(16, n.bit_length()))
    return up[:n], down[: n + 1]


def _stretches(text: str) -> Iterator[str]:
    """A long text in parts that end before white space, where no word goes on."""
    at = 0
    while len(text) - at > CHARS:
        cut = _SPACE.search(text, at + CHARS)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _lower_table() -> dict[int, str]:
    """Each character is lowered by itself: the final sigma has no form of its own here."""
    return {0x3A3: "σ"} | {c: chr(c + by) for a, b, by in NEW_LOWER for c in range(a, b + 1)}


class WordBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"].get("normalizers", [])]
        if model["type"] != "BPE" or kinds != NORMALIZERS or spec.get("post_processor") or spec.get("decoder"):
            raise ValueError(f"not a word-end BPE file: {path}")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([vocab[s] for s in byte_symbols()], np.int32)
        self.last = np.array([vocab[s + end] for s in byte_symbols()], np.int32)
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(model["merges"])}
        self.merged = np.array([vocab[a + b] for a, b in model["merges"]], np.int32)
        self._fill_table()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | special).items()}
        self.special = {t: array("I", [i]).tobytes() for t, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.lower = _lower_table()
        self.kinds = _kinds()

    # Ranks of pairs in an open-addressing table, for look-ups by the array.

    def _fill_table(self) -> None:
        keys = np.array([a << 32 | b for a, b in self.ranks], np.int64)
        self.mask = (1 << (len(keys) * 8).bit_length()) - 1
        self.slots = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, _NONE, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slots[at] < 0
            here, first = np.unique(at[free], return_index=True)
            got = left[free][first]
            self.slots[here], self.values[here] = keys[got], got
            stay = ~np.isin(left, got)
            left, at = left[stay], (at[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ keys >> 29) * 0x9E3779B97F4A7C1 >> 20) & self.mask

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 32 | b).ravel()
        at = self._slot(keys)
        found = self.slots[at]
        hit = found == keys
        out = np.where(hit, self.values[at], _NONE)
        open_ = np.flatnonzero(~hit & (found >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            k, next_ = keys[open_], (at[open_] + 1) & self.mask
            at[open_], found = next_, self.slots[next_]
            hit = found == k
            out[open_[hit]] = self.values[next_[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out.reshape(a.shape)

    def _scan(self, raw: np.ndarray, starts: np.ndarray, width: int, flat: np.ndarray, counts: np.ndarray, who: np.ndarray) -> None:
        """Merge words of one width, a column each; ids go to `flat` where the word's bytes lie in `raw`."""
        chars = raw[starts + np.arange(width)[:, None]]
        parts = self.inner[chars]
        parts[-1] = self.last[chars[-1]]
        ranks = self.rank(parts[:-1], parts[1:]) << 7 | np.arange(width - 1, dtype=np.int32)[:, None]
        for w in range(width, 0, -1):
            least = ranks.min(0) if w > 1 else np.full(len(who), _NONE << 7, np.int32)
            go = least < _NONE << 7
            done = ~go
            counts[who[done]] = w
            flat[starts[done] + np.arange(w)[:, None]] = parts[:, done]
            if not go.any():
                return
            who, starts, parts, ranks, least = who[go], starts[go], parts[:, go], ranks[:, go], least[go]
            low, column = least & 127, np.arange(len(who))
            parts[low, column] = self.merged[least >> 7]
            # Delete the boundary (ranks carry their place), and refresh the ranks on both sides of the new part.
            parts = np.where(np.arange(w - 1)[:, None] <= low, parts[:-1], parts[1:])
            ranks = np.where(np.arange(w - 2)[:, None] < low, ranks[:-1], ranks[1:] - 1)
            for side in (low - 1, low):
                inside = np.flatnonzero((side >= 0) & (side < w - 2))
                at = side[inside]
                ranks[at, inside] = self.rank(parts[at, inside], parts[at + 1, inside]) << 7 | at

    def _heap(self, word: bytes) -> list[int]:
        parts = [int(self.inner[b]) for b in word[:-1]] + [int(self.last[word[-1]])]
        n, ranks, merged = len(parts), self.ranks, self.merged
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (r := ranks.get((parts[i], parts[after[i]]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = int(merged[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def plain(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return (text.translate(self.lower) if _ODD.search(text) else text).lower()

    def _words(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end: contractions, runs of letters, single numbers, runs of anything else but white space."""
        kind = self.kinds[code]
        begins = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)]))
        ends = np.append(begins[1:], len(code))
        tick = np.flatnonzero((code[begins[:-1]] == 0x27) & (ends[:-1] - begins[:-1] == 1) & (kind[begins[1:]] == _LETTER))
        if len(tick):
            at = ends[tick]
            one = code[at]
            two = np.where(at + 1 < ends[tick + 1], code[np.minimum(at + 1, len(code) - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.isin(one << 8 | two, [ord(c[0]) << 8 | ord(c[1]) for c in ("re", "ve", "ll")])
            take = np.where(short, 1, np.where(long, 2, 0))
            ends[tick] += take
            begins[tick + 1] += take
        real = (kind[begins.clip(max=len(code) - 1)] != _BLANK) & (begins < ends)
        return begins[real], ends[real]

    def _merge(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the words of a plain text: place of each in the text, number of its ids, and all ids in order."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begins, ends = self._words(code)
        places = begins
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) > len(code):
            at = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])
            begins, ends = at[begins], at[ends]
        # Each different word is merged once: words are told apart by a hash, and then held against the word that stands for them.
        power, back = _powers(len(raw))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_HASH[raw] * power)])
        length = ends - begins
        _, first, same = np.unique((sums[ends] - sums[begins]) * back[begins] ^ length.astype(np.uint64), return_index=True, return_inverse=True)
        here = np.repeat(begins - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        if not (length[first][same] == length).all() or not (raw[here + np.repeat(begins[first][same] - begins, length)] == raw[here]).all():
            first = same = np.arange(len(begins))
        starts, widths = begins[first], length[first]
        flat, counts = np.zeros(len(raw), np.int32), np.zeros(len(first), np.int64)
        order = np.argsort(widths, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(widths[order])) + 1):
            if len(group) and widths[group[0]] <= SCAN:
                self._scan(raw, starts[group], int(widths[group[0]]), flat, counts, group)
            else:
                for g in group:
                    ids = self._heap(raw[starts[g] : starts[g] + widths[g]].tobytes())
                    flat[starts[g] : starts[g] + len(ids)] = ids
                    counts[g] = len(ids)
        number = counts[same]
        to = np.concatenate([[0], np.cumsum(number)])
        return places, to, flat[np.repeat(starts[same] - to[:-1], number) + np.arange(to[-1])]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        queue: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            if not queue:
                return
            begin = np.cumsum([0, *(len(p) + 1 for _, p in queue)])
            places, to, ids = self._merge(" ".join(p for _, p in queue) + " ")
            bounds = to[np.searchsorted(places, begin)]
            data = ids.astype("<u4").tobytes()
            for (i, _), a, b in zip(queue, bounds, bounds[1:]):
                out[i].append(data[4 * a : 4 * b])
            queue.clear()

        for i, text in enumerate(texts):
            for part in self.cut.split(text) if text and "<|" in text else [text or ""]:
                if part in self.special:
                    flush()
                    out[i].append(self.special[part])
                    continue
                for stretch in _stretches(self.plain(part)):
                    queue.append((i, stretch))
                    size += len(stretch)
                    if size >= CHARS:
                        flush()
                        size = 0
        flush()
        return [b"".join(o) for o in out]

    def decode(self, all_ids: Sequence[bytes | None]) -> list[str]:
        """Token strings joined by blanks, special tokens included; ids that the vocabulary lacks are skipped."""
        out = []
        for ids in all_ids:
            numbers = array("I")
            numbers.frombytes(ids or b"")
            try:
                out.append(" ".join(map(self.tokens.__getitem__, numbers)))
            except KeyError:
                out.append(" ".join([self.tokens[i] for i in numbers if i in self.tokens]))
        return out


@cache
def tokenizer(path: str) -> WordBpe:
    """One tokenizer for each file and Python worker."""
    return WordBpe(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _mapped(df: DataFrame, keep: Sequence[str], source: str, out: T.StructField, work) -> DataFrame:
    if out.name in keep or len(set(keep)) < len(keep):
        raise ValueError(f"columns clash: {[*keep, out.name]}")
    schema = T.StructType([*(df.schema[c] for c in keep), out])
    kind = pa.binary() if isinstance(out.dataType, T.BinaryType) else pa.string()

    def run(batches):
        f = work()
        for b in slices(batches):
            made = pa.array(f(b.column(len(keep)).to_pylist()), kind)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), made], names=[*keep, out.name])

    return df.select(*keep, source).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and `ids`: binary, little-endian unsigned 32-bit."""
    return _mapped(docs, keep, text, T.StructField("ids", T.BinaryType()), lambda: tokenizer(path).encode)


def decode_documents(encoded: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The kept columns and `decoded`: the text of the ids."""
    return _mapped(encoded, keep, ids, T.StructField("decoded", T.StringType()), lambda: tokenizer(path).decode)
