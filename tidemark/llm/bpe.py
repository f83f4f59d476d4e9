"""BPE encoding and decoding (operator 7).

A pre-token's symbols form a doubly linked list; a heap holds (merge rank, position) of neighbouring pairs. The least
rank is merged first, the leftmost of equal ranks; entries whose symbols have changed since are stale and skipped.
Decoding concatenates vocabulary strings. Results per pre-token are kept in a bounded cache of each worker, named by the
tokenizer file's digest.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import map_columns, shared, worker_state

#: Entries of a worker's cache; a full cache is emptied.
CACHE = 400_000
NEAR = "\u024f"

# The published split patterns of the two tokenizer files.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|[^\s{l}{n}]+"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable, else from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


@dataclass
class Codec:
    """What a worker needs of a tokenizer file; small (a few MB), so it travels with the function."""

    start: list[int]  # symbol of a byte
    last: list[int]  # symbol of a pre-token's last byte
    merges: dict[tuple[int, int], tuple[int, int]]  # pair of symbols -> (rank, merged symbol)
    strings: dict[int, str]
    special: dict[str, int]
    words: bool  # the lower-casing kind with word ends
    pattern: str  # splits a text into pre-tokens
    latin: str  # the same for texts without characters beyond NEAR: small classes are several times as fast
    key: str  # digest of the file's content: workers keep what they cache under it
    lower: dict[int, str] = field(default_factory=dict)


def char_class(chars: list[str]) -> str:
    """Ranges of a regular expression's class. Explicit classes suit the standard re module, which is some 40 times as
    fast here as property classes of the regex module."""
    out, codes = [], sorted(map(ord, chars))
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if a != b else f"\\U{a:08x}" for a, b in out)


def load(path: str) -> Codec:
    """Read a tokenizers file of one of the two public kinds: byte-level pre-tokens, or lower-cased words with ends."""
    from tokenizers import Tokenizer

    with open(path, "rb") as f:
        content = f.read()
    spec = json.loads(content)
    vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
    letters = byte_letters()
    merges = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    library = Tokenizer.from_file(path)
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    kinds: dict[str, list[str]] = {"L": [], "N": [], "Cn": [], "S": []}
    for c in every:
        kind = unicodedata.category(c)
        if kind[0] in "LN" or kind == "Cn":
            kinds[kind if kind == "Cn" else kind[0]].append(c)
        elif c.isspace() and not "\x1c" <= c <= "\x1f":
            kinds["S"].append(c)
    # What unicodedata's version does not know is asked of the library, as far as the regex module calls it letter or digit.
    late = regex.findall(r"[\p{L}\p{N}]", "".join(kinds["Cn"]))
    for c in late:
        for kind, near in (("L", "aa"), ("N", "11")):
            said = library.pre_tokenizer.pre_tokenize_str(f"{near[0]}{c}")
            digit = kind == "N" and bool(regex.match(r"\p{N}", c)) and bool(spec["normalizer"])
            if len(said) == 1 or digit:
                kinds[kind].append(c)
    lower = {}
    if spec["normalizer"]:
        lower = {ord(c): low for c in (*late, "Σ") if (low := library.normalizer.normalize_str(c)) != c.lower() or c == "Σ"}
    base = (WORD_SPLIT if spec["normalizer"] else BYTE_SPLIT).replace(r"\s", "{S}").replace(r"\S", "{nS}")

    def pattern(most: str) -> str:
        words, digits, blanks = (char_class([c for c in kinds[k] if c <= most]) for k in "LNS")
        return base.replace("[^{S}{l}{n}]", f"[^{blanks}{words}{digits}]").replace("{L}", f"[{words}]").replace("{N}", f"[{digits}]").replace("{nS}", f"[^{blanks}]").replace("{S}", f"[{blanks}]")

    return Codec(
        [vocab[x] for x in letters], [vocab[x + end] for x in letters], merges, {i: s for s, i in vocab.items()} | {i: s for s, i in special.items()},
        special, bool(spec["normalizer"]), pattern(chr(0x10FFFF)), pattern(NEAR), hashlib.sha256(content).hexdigest(), lower,
    )


def merge(codec: Codec, data: bytes) -> list[int]:
    """Ids of one pre-token."""
    n = len(data)
    if not n:
        return []
    symbols = [codec.start[b] for b in data]
    symbols[-1] = codec.last[data[-1]]
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    merges, heap = codec.merges, []
    for i in range(n - 1):
        if found := merges.get((symbols[i], symbols[i + 1])):
            heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
    heapq.heapify(heap)
    while heap:
        _, i, x, y, made = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != x or j < 0 or symbols[j] != y:
            continue  # stale
        symbols[i], symbols[j] = made, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if found := merges.get((made, symbols[k])):
                heapq.heappush(heap, (found[0], i, made, symbols[k], found[1]))
        if (h := before[i]) >= 0 and (found := merges.get((symbols[h], made))):
            heapq.heappush(heap, (found[0], h, symbols[h], made, found[1]))
    return [s for s in symbols if s >= 0]


class Splitter:
    """Text -> segments between special tokens, and their pre-tokens."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self.special = re.compile("|".join(re.escape(x) for x in sorted(codec.special, key=len, reverse=True)) or r"(?!)")
        self.findall, self.near = re.compile(codec.pattern).findall, re.compile(codec.latin).findall
        self.far = re.compile(f"[^\0-{NEAR}]").search
        self.odd = re.compile(f"[{char_class([chr(c) for c in codec.lower])}]").search if codec.lower else None

    def normalise(self, text: str) -> str:
        if not self.codec.words or text.isascii():
            return text.lower() if self.codec.words else text
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if self.odd and self.odd(text):
            text = text.translate(self.codec.lower)
        return text.lower()

    def pieces(self, text: str) -> list[str]:
        text = self.normalise(text)
        return (self.near if text.isascii() or not self.far(text) else self.findall)(text)

    def segments(self, text: str) -> tuple[list[str], list[str]]:
        """n + 1 texts and the n special tokens between them."""
        if "<|" not in text and all("<|" in x for x in self.codec.special):
            return [text], []
        return self.special.split(text), self.special.findall(text)


class Cache(dict):
    """pre-token -> whatever made(pre-token) gives."""

    def __init__(self, made: Callable[[str], object]) -> None:
        super().__init__()
        self.made = made

    def __missing__(self, word: str):
        if len(self) >= CACHE:
            self.clear()
        out = self.made(word)
        if len(word) <= 64:
            self[word] = out
        return out


class Decoder:
    """Ids to text: the strings of the vocabulary, put together.

    Word files name no decoder; the library then puts a blank between two strings. Byte-level files write a letter for
    each byte: the strings' bytes are put together and read as UTF-8, what is none becoming U+FFFD."""

    def __init__(self, codec: Codec) -> None:
        back = {x: b for b, x in enumerate(byte_letters())}
        self.glue = b" " if codec.words else b""
        own = lambda s: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        # a special token is its own text; the letters of bytes stand only in the vocabulary's other strings
        special = set(codec.special.values())
        self.bytes = {i: s.encode() if codec.words or i in special else own(s) for i, s in codec.strings.items()}

    def decode(self, ids: list[int]) -> str:
        return self.glue.join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class Encoder:
    """Whole texts to packed ids and back."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.split, self.decoder = codec, Splitter(codec), Decoder(codec)
        self.cache = Cache(lambda word: self.packed(merge(codec, word.encode())))

    def packed(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b"".join(i.to_bytes(4, "little") for i in ids), self.decoder.glue.join(map(self.decoder.bytes.__getitem__, ids))

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian unsigned 32-bit integers, and the bytes of the vocabulary strings put together."""
        ids, strings = [], []
        texts, specials = self.split.segments(text)
        for k, part in enumerate(texts):
            for a, b in map(self.cache.__getitem__, self.split.pieces(part)):
                ids.append(a)
                strings.append(b)
            if k < len(specials):
                ids.append(self.codec.special[specials[k]].to_bytes(4, "little"))
                strings.append(specials[k].encode())
        return b"".join(ids), self.decoder.glue.join(strings)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per document: key, n_tokens, ids_sha256, decoded_sha256; with keep_ids also ids (array of int) and decoded.

    A null text counts as empty: no ids and an empty decoded text. Other columns of docs are ignored, whatever their
    names; repeated rows and null keys are kept as they are; an empty table gives no rows.
    """
    codec = shared(docs.sparkSession, load(path))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def make():
        encoder = worker_state(f"bpe-{codec().key}", lambda: Encoder(codec()))

        def work(keys: pa.Array, texts: pa.Array) -> dict:
            out: dict = {key: keys, "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for t in texts.to_pylist():
                ids, decoded = encoder.encode(t or "")
                if not encoder.codec.words:  # bytes of broken characters are replaced, as the library does
                    decoded = decoded.decode("utf-8", "replace").encode()
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                if keep_ids:
                    out["ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
                    out["decoded"].append(decoded.decode())
            return out

        return work

    return map_columns(docs, [key, text], schema, make)


def decode(rows: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, decoded) of rows with a column of ids: the vocabulary's strings put together, special tokens included.

    Null ids give a null text, no ids an empty one, an id that the vocabulary lacks is an error. Other columns are
    ignored; repeated rows and null keys stay; an empty table gives no rows."""
    codec = shared(rows.sparkSession, load(path))
    kind = rows.schema[key].dataType.simpleString()

    def make():
        decoder = worker_state(f"decode-{codec().key}", lambda: Decoder(codec()))

        def work(keys: pa.Array, lists: pa.Array) -> dict:
            return {key: keys, "decoded": [None if x is None else decoder.decode(x) for x in lists.to_pylist()]}

        return work

    return map_columns(rows, [key, ids], f"{key} {kind}, decoded string", make)
