"""Byte-pair encoding as a streaming transducer with bounded lookahead.

Whether a place in a word stays a token boundary depends on what follows only through chains of merges: a merge is
prevented by an earlier merge that takes its right part, that one by a still earlier one, and so on. Ranks fall along a
chain, so the longest chain of the merge list bounds the text it spans: the sufficient lookahead. A word is read into a
buffer; tokens that end at least this far before the buffer's end are stable, are emitted, and leave the buffer. What is
left starts at a boundary and is merged as if it stood alone. Memory does not grow with the word.
"""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from matchloom.llm.common import encoded, pieces, small_batches

#: Symbols read beyond the lookahead before stable tokens are emitted.
READ_SYMBOLS = 256
#: Chunks of text remembered by a worker, for each of two generations.
REMEMBERED = 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: a visible Latin-1 character for
    itself, the others in order from code point 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """Symbols after a place that can decide on a boundary there.

    Merges are taken by rank. The reach of a merge (a, b) is the length of b and the furthest reach of an earlier merge
    that starts with b or with a last part of it; the reach of a symbol is the furthest of the merges it starts.
    """
    parts: dict[str, tuple[str, str]] = {}
    reach: dict[str, int] = {}
    length = lambda s: len(s.removesuffix(suffix)) if suffix else len(s)
    furthest = 0
    for a, b in merges:
        further, s = 0, b
        while s is not None:
            further = max(further, reach.get(s, 0))
            s = parts[s][1] if s in parts else None
        span = length(b) + further
        reach[a] = max(reach.get(a, 0), span)
        furthest = max(furthest, span)
        parts.setdefault(a + b, (a, b))
    return furthest


class Transducer:
    """Encoder and decoder of a tokenizers file with normalised text, split words and byte-level merges."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        self._definition, self._library = definition, None
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in reversed(list(enumerate(merges)))}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lookahead = sufficient_lookahead(merges, self.suffix)
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.tokens = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.joined = spec.get("decoder") is None  # without a decoder, tokens are joined by blanks
        self._read_steps(spec)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.words_known: dict[str, bytes] = {}

    def _read_steps(self, spec: dict) -> None:
        normal = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
        self.steps = [n["type"] for n in normal.get("normalizers", [normal])]
        pre = spec["pre_tokenizer"]
        pattern = [p["pattern"]["Regex"] for p in pre.get("pretokenizers", [pre]) if p["type"] == "Split"]
        if not pattern or set(self.steps) - {"NFC", "Replace", "Lowercase"}:
            raise ValueError("files with an NFC, blank and lower-case normaliser and a split by pattern are supported")
        self.words = regex.compile(pattern[0])

    def _normal(self, text: str) -> str:
        # white space is dropped by the split, so the step that makes it blanks changes nothing
        if "NFC" in self.steps:
            text = unicodedata.normalize("NFC", text)
        if "Lowercase" in self.steps:
            text = text.replace("Σ", "σ").lower()  # each character by itself: no final sigma
        return text

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge by rank, leftmost first, until no pair is left."""
        ranks, none = self.ranks.get, len(self.ranks)
        found = [ranks(p, none) for p in zip(symbols, symbols[1:])]
        while found:
            least = min(found)
            if least == none:
                break
            at = found.index(least)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del found[at]
            if at < len(found):
                found[at] = ranks((symbols[at], symbols[at + 1]), none)
            if at:
                found[at - 1] = ranks((symbols[at - 1], symbols[at]), none)
        return symbols

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word from its symbols, as soon as they are stable."""
        if isinstance(symbols, str) and 0 < len(symbols) <= READ_SYMBOLS:  # the buffer would take it whole
            yield from self.merged([*symbols[:-1], symbols[-1] + self.suffix])
            return
        buffer: list[str] = []
        for symbol in symbols:
            if len(buffer) >= self.lookahead + READ_SYMBOLS:
                stable, done = len(buffer) - self.lookahead, 0
                for token in self.merged(buffer.copy()):
                    if done + len(token) > stable:
                        break
                    yield token
                    done += len(token)
                buffer = buffer[done:]
            buffer.append(symbol)
        if buffer:
            buffer[-1] += self.suffix
            yield from self.merged(buffer)

    def _split(self, text: str) -> list[str]:
        """Words as byte symbols. For characters newer than this Python's tables the library's own steps are asked."""
        if text.isascii() or all(unicodedata.category(c) != "Cn" for c in text):
            return ["".join(map(self.symbols.__getitem__, w.encode())) for w in self.words.findall(self._normal(text))]
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._definition)
        normal = self._library.normalizer.normalize_str(text)
        return [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(normal)]

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk in self.older:
            return self.older[chunk]
        return b"".join([self.words_known.get(w) or self._word(w) for w in self._split(chunk.decode())])

    def _word(self, word: str) -> bytes:
        ids = np.array([self.vocabulary[t] for t in self.stream(word)], dtype="<u4").tobytes()
        if len(self.words_known) > REMEMBERED:
            self.words_known.clear()
        if len(word) <= READ_SYMBOLS:
            self.words_known[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a text."""
        out = []
        for part in self._specials.split(text or "") if self.special else [text or ""]:
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
                continue
            for piece in pieces(encoded(part)):  # words of the split do not reach across ASCII white space
                if len(self.known) > REMEMBERED:
                    self.older, self.known = self.known, {}
                chunks = piece.split()
                for c in set(chunks):
                    if c not in self.known:
                        self.known[c] = self._chunk(c)
                out.append(b"".join(map(self.known.__getitem__, chunks)))
        return b"".join(out)

    def decoder(self) -> "Decoder":
        return Decoder(self)

    def decode(self, ids: bytes) -> str:
        machine = self.decoder()
        values = np.frombuffer(ids, dtype="<u4")
        parts = [machine.feed(values[at : at + 65536].tolist()) for at in range(0, len(values), 65536)]
        return "".join([*parts, machine.finish()])


class Decoder:
    """State machine from ids to text. Without a decoder in the file its state is whether a token came before; for byte
    levels it is the beginning of a character whose bytes are not complete."""

    def __init__(self, tool: Transducer):
        self.tokens, self.joined, self.begun = tool.tokens, tool.joined, False
        self.bytes = {s: b for b, s in enumerate(tool.symbols)}
        self.partial = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        found = [self.tokens[i] for i in ids if i in self.tokens]
        if self.joined:
            text = (" " if self.begun and found else "") + " ".join(found)
            self.begun = self.begun or bool(found)
            return text
        return self.partial.decode(b"".join(self._raw(t) for t in found))

    def _raw(self, token: str) -> bytes:
        if all(c in self.bytes for c in token):
            return bytes(self.bytes[c] for c in token)
        return token.encode()

    def finish(self) -> str:
        return "" if self.joined else self.partial.decode(b"", final=True)


_TOOLS: dict[int, Transducer] = {}


def transducer(definition: str) -> Transducer:
    key = hash(definition)
    if key not in _TOOLS:
        _TOOLS[key] = Transducer(definition)
    return _TOOLS[key]


def _definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(text: Column | str, tokenizer: str) -> Column:
    """Ids of each whole text as binary, little-endian 32 bits each; ``tokenizer`` is the path of a tokenizers file.
    Null and empty texts have no ids. Strings of special tokens in a text become their ids."""
    definition = _definition(tokenizer)

    @pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = transducer(definition)
        for texts in batches:
            yield pd.Series([tool.encode(t) for t in texts], dtype=object)

    return run(text)


def decode(ids: Column | str, tokenizer: str) -> Column:
    """Text of binary ids, special tokens included. Null gives an empty text."""
    definition = _definition(tokenizer)

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = transducer(definition)
        for rows in batches:
            yield pd.Series([tool.decode(r if r is not None else b"") for r in rows], dtype=object)

    return run(ids)


def encode_decode(text: Column | str, tokenizer: str) -> Column:
    """``ids`` and ``decoded`` of each whole text as one struct: ``encode``, then ``decode``, in one worker with one
    copy of the tables."""
    definition = _definition(tokenizer)

    @pandas_udf("ids binary, decoded string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tool = transducer(definition)
        for texts in batches:
            ids = [tool.encode(t) for t in texts]
            columns = {"ids": ids, "decoded": [tool.decode(i) for i in ids]}
            yield pd.DataFrame({name: pd.Series(c, dtype=object) for name, c in columns.items()})

    return run(text)


def round_trip(docs, tokenizer: str):
    """``doc_id``, ``n_tokens``, ``ids`` (binary) and ``decoded`` for every row; repeated rows and null doc_ids are kept,
    an empty table gives an empty result, other columns are not read."""
    found = small_batches(docs).select("doc_id", encode_decode("text", tokenizer).alias("_found"))
    found = found.select("doc_id", F.col("_found.ids").alias("ids"), F.col("_found.decoded").alias("decoded"))
    return found.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")
