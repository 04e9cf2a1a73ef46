"""BPE encoding and decoding with a public vocabulary file.

A word is encoded exactly in linear time by backtracking: Aho-Corasick finds
the longest token at each place; a token stays if its neighbour before it is
compatible (re-encoding the two together would give the two), else the next
shorter token is tried, and a place from which none fits is never tried again.
Which pairs are compatible is memoised from the merges. Decoding slices one
buffer by an offset table.

The vocabulary file is read on the driver (or any worker that has it) and is
broadcast: a few MB, whatever the corpus; a file whose normalizer, splitting,
model or decoder this encoder does not implement is an error. Defined results: a null text counts
as empty (no ids, empty decoded text); texts are never cut; the strings of
special tokens in a text become these tokens, as in the tokenizers library;
other columns pass through ``encode`` unless named as an output.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_arrow, worker_cache

#: Entries of a worker's cache of encoded chunks, in each of its two generations; a miss is computed again.
CACHE = 200_000


# The settings of a vocabulary file that this encoder implements; others are an error.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


class Memo(dict):
    """``make(key)``, remembered in two generations of at most ``size`` entries."""

    def __init__(self, make: Callable, size: int = CACHE):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, more = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], more = chr(more), more + 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merges, ids and special tokens of a BPE file of the tokenizers library whose words end in a suffix."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        differs = [k for k, v in SETTINGS.items() if spec.get(k) != v]
        differs += [k for k, v in MODEL.items() if (model.get(k) or v) != v]
        differs += ["added_tokens"] * any(x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not self.suffix or differs:
            raise ValueError(f"this encoder does not follow the vocabulary's {differs or 'words without an end'}")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ids = model["vocab"]
        letters = byte_letters()
        # One character a symbol: a byte inside a word, or (from U+E000 on) a byte that ends it.
        self.inner = letters
        self.final = {c: chr(0xE000 + b) for b, c in enumerate(letters)}
        symbols = [*letters, *self.final.values()]
        names = [*letters, *(c + self.suffix for c in letters)]
        spell = dict(zip(names, symbols, strict=True))
        #: By rank: text over symbols, id, left and right part (itself for a symbol).
        self.text, self.ids, self.left, self.right = list(symbols), [ids[x] for x in names], [*range(512)], [*range(512)]
        self.pair: dict[tuple[int, int], int] = {}
        rank = {x: i for i, x in enumerate(names)}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if a + b in rank:
                continue
            k = rank[a + b] = len(self.text)
            spell[a + b] = spell[a] + spell[b]
            self.text.append(spell[a + b])
            self.ids.append(ids[a + b])
            self.left.append(rank[a])
            self.right.append(rank[b])
            self.pair[rank[a], rank[b]] = k
        self.length = [len(x) for x in self.text]
        by_text = {x: i for i, x in enumerate(self.text)}
        self.shorter = [next((by_text[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in by_text), -1) for x in self.text]
        self.machine = ahocorasick.Automaton()
        for i, x in enumerate(self.text):
            self.machine.add_word(x, i)
        self.machine.make_automaton()
        self.fits = Memo(self._compatible)
        size = max([*ids.values(), *self.special.values()]) + 1
        named: list[bytes] = [b""] * size
        for x, i in [*ids.items(), *self.special.items()]:
            named[i] = x.encode()
        #: Decoding: token i is buffer[offsets[i]:offsets[i + 1]].
        self.buffer = b"".join(named)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in named])]).tolist()
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
        self.blank = regex.compile(r"\p{White_Space}+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks = Memo(self._chunk)
        self.known = Memo(self._word)

    def _compatible(self, pair: int) -> bool:
        """Whether two tokens by rank (a << 32 | b) stay two when encoded together."""
        a, b = pair >> 32, pair & 0xFFFFFFFF
        below = len(self.text) + 1  # merges of this rank or more can no longer cross the seam
        while True:
            made = self.pair.get((a, b))
            if made is not None and made < below:
                return False
            # Undo the later of the two merges; once a side is a symbol, go on with the other.
            if (a > b and self.right[a] != a) or self.left[b] == b:
                if self.right[a] == a:
                    return True
                below, a = a, self.right[a]
            else:
                below, b = b + 1, self.left[b]

    def spell(self, word: str) -> str:
        letters = [self.inner[b] for b in word.encode()]
        letters[-1] = self.final[letters[-1]]
        return "".join(letters)

    def _word(self, word: str) -> list[int]:
        """Ids of one word of the pattern."""
        text = self.spell(word)
        n, length, shorter, fits = len(text), self.length, self.shorter, self.fits
        longest = [-1] * n
        for end, token in self.machine.iter(text):  # at each end the longest comes first
            at = end - length[token] + 1
            if longest[at] < 0 or length[token] > length[longest[at]]:
                longest[at] = token
        usable = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            end = at + length[token]
            if usable[end] and (not out or fits[out[-1] << 32 | token]):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
                continue
            token = shorter[token]
            if token < 0:
                usable[at] = 0
                token = out.pop()
                at -= length[token]
        return [self.ids[t] for t in out]

    def _plain(self, part: str) -> list[int]:
        part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
        return [i for w in self.words.findall(part) for i in self.known[w]]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of text without white space, as little-endian unsigned 32-bit integers."""
        if self.cut and "<" in chunk and any(x in chunk for x in self.special):
            ids = [i for k, x in enumerate(self.cut.split(chunk)) for i in ([self.special[x]] if k % 2 else self._plain(x))]
        else:
            ids = self._plain(chunk)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text: words never cross white space, so chunks are encoded one by one."""
        parts = self.blank.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        chunks = self.chunks
        return np.frombuffer(b"".join([chunks[x] for x in parts]), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: the tokens, a space between two."""
        buffer, offsets = self.buffer, self.offsets
        return b" ".join([buffer[offsets[i] : offsets[i + 1]] for i in ids.tolist()])


def vocabulary(file: bytes) -> Vocabulary:
    """One a worker process and file."""
    return worker_cache(("bpe", hashlib.sha256(file).digest()), lambda: Vocabulary(file))


def _mapped(df: DataFrame, text_col: str, path: str, fields: list[tuple[str, T.DataType, pa.DataType]], make: Callable) -> DataFrame:
    """Columns of ``df`` but the text, then ``fields`` from make(vocabulary, text) for each row."""
    with open(path, "rb") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())
    names = {n for n, _, _ in fields}
    rest = [c for c in df.columns if c != text_col and c not in names]
    schema = T.StructType([*[df.schema[c] for c in rest], *[T.StructField(n, t) for n, t, _ in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(file.value)
        for batch in batches:
            step = max(1, min(1000, int(batch.num_rows * 4e6 / max(1, batch.nbytes))))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                got = [make(v, t.as_py() or "") for t in part.column(len(rest))]
                cols = [pa.array([x[i] for x in got], t) for i, (_, _, t) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *cols], names=[*rest, *[n for n, _, _ in fields]])

    taken = df.select(*rest, F.col(text_col).alias("__text"))
    return map_arrow(taken, run, schema)


def encode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with its text replaced by ``ids`` (array of int)."""
    return _mapped(df, text_col, path, [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], lambda v, t: (v.encode(t).astype("<i4"),))


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with its ids replaced by ``decoded`` (string; null ids: empty)."""
    return _mapped(df, ids_col, path, [("decoded", T.StringType(), pa.string())], lambda v, ids: (v.decode(np.array(ids or [], "<u4")).decode(),))


def round_trip(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Digests of ids and of the text decoded from them, without either leaving its worker."""

    def make(v: Vocabulary, text: str) -> tuple:
        ids = v.encode(text)
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(v.decode(ids)).hexdigest()

    fields = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    return _mapped(df, text_col, path, fields, make)


def coded(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with its text replaced by ``ids`` (array of int) and the columns of ``round_trip``."""

    def make(v: Vocabulary, text: str) -> tuple:
        ids = v.encode(text)
        return ids.astype("<i4"), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(v.decode(ids)).hexdigest()

    fields = [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    return _mapped(df, text_col, path, fields, make)
