"""Byte-level byte-pair encoding and decoding for a published vocabulary file.

A pre-token's bytes form a doubly linked list of symbols.  All neighbouring pairs that have a merge rank are in
a priority queue, by rank and then place; the lowest is taken, skipped if one of its symbols has changed since (a
stale entry), else merged, and the pairs with the new symbol's neighbours are queued.  Decoding concatenates the
vocabulary's byte strings.

Text between special tokens is cut into pre-tokens in two steps: words with the space before them, then the
published pattern inside a word; as every alternative of the pattern stays inside such a word, the cuts are the
same, and whole words can be remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame

from wordloom.llm.common import map_rows, pick, shared

#: Unicode white space, as the published pattern's \s.
WHITE = r"\t-\r \x85\xa0  -     　"
WORDS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Fixed pattern of the vocabulary file's byte-level pre-tokenizer, inside one word.
INSIDE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+")
#: Words (and pre-tokens) that a codec remembers in each of two generations, and the longest of them; bounds its memory.
REMEMBERED, LONGEST = 200_000, 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such vocabulary files: printable Latin-1 bytes stand for
    themselves, all others for the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Memory:
    """A bounded dictionary: when the young generation is full it becomes the old one, which takes the old one's place."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, w: str) -> bytes | None:
        got = self.young.get(w)
        if got is None and (got := self.old.get(w)) is not None:
            self.put(w, got)
        return got

    def put(self, w: str, got: bytes) -> None:
        if len(w) <= LONGEST:
            if len(self.young) >= REMEMBERED:
                self.young, self.old = {}, self.young
            self.young[w] = got


class Codec:
    def __init__(self, tokenizer_json: str) -> None:
        spec = json.loads(tokenizer_json)
        model, letters = spec["model"], byte_letters()
        as_byte = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes: dict[int, bytes] = {i: bytes(as_byte[c] for c in t) for t, i in vocab.items() if all(c in as_byte for c in t)}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [vocab[c] for c in letters]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: For each left symbol the ranks of its pairs by their right symbol.
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocab[a]][vocab[b]] = rank
        self.merged = [vocab[a + b] for a, b in pairs]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.shown = [str(i).encode() for i in range(max([*vocab.values(), *self.special.values()]) + 1)]
        self.words, self.parts = Memory(), Memory()

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token.  A queue entry is a number: the rank, then the place of the pair's left symbol."""
        ids = [self.byte_id[b] for b in data]
        n, ranks = len(ids), self.ranks
        wide = n.bit_length()
        queue = [r << wide | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := ranks[a].get(b)) is not None]
        if not queue:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heapq.heapify(queue)
        pop, push, last = heapq.heappop, heapq.heappush, (1 << wide) - 1
        while queue:
            entry = pop(queue)
            i = entry & last
            j = after[i]
            if j < 0 or ids[i] < 0 or ranks[ids[i]].get(ids[j]) != entry >> wide:
                continue
            ids[i] = new = self.merged[entry >> wide]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks[new].get(ids[k])) is not None:
                    push(queue, r << wide | i)
            h = before[i]
            if h >= 0 and (r := ranks[ids[h]].get(new)) is not None:
                push(queue, r << wide | h)
        return [x for x in ids if x >= 0]

    def _part(self, p: str) -> bytes:
        got = self.parts.get(p)
        if got is None:
            got = np.array(self.merge(p.encode()), "<u4").tobytes()
            self.parts.put(p, got)
        return got

    def _word(self, w: str) -> bytes:
        got = self.words.get(w)
        if got is None:
            got = b"".join([self._part(p) for p in INSIDE.findall(w)])
            self.words.put(w, got)
        return got

    def _words(self, text: str) -> bytes:
        young, word = self.words.young, self._word
        return b"".join([young.get(w) or word(w) for w in WORDS.findall(text)])

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._words(text)
        return b"".join([np.array([self.special[part]], "<u4").tobytes() if i % 2 else self._words(part) for i, part in enumerate(self.cut.split(text))])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decimal(self, ids: list[int]) -> bytes:
        """The ids as decimal numbers joined by commas."""
        shown = self.shown
        return b",".join([shown[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Concatenated vocabulary strings; bytes that aren't UTF-8 become U+FFFD, ids outside the vocabulary nothing."""
        table = self.token_bytes
        try:
            data = b"".join([table[i] for i in ids])
        except KeyError:
            data = b"".join([table.get(i, b"") for i in ids])
        return data.decode("utf-8", "replace")


class CompiledCodec(Codec):
    """The same ids, with the merges of words that aren't remembered left to tiktoken's compiled loop.

    That loop ranks a pair by the id of the token it makes, so it is taken only where ids are in the merges' order.
    """

    def __init__(self, tokenizer_json: str) -> None:
        super().__init__(tokenizer_json)
        import tiktoken

        ordinary = {b: i for i, b in self.token_bytes.items() if i not in self.special.values()}
        self.compiled = tiktoken.Encoding("own", pat_str=INSIDE.pattern, mergeable_ranks=ordinary, special_tokens={}) if self.merged == sorted(self.merged) else None

    def _word(self, w: str) -> bytes:
        if self.compiled is None:
            return super()._word(w)
        got = self.words.get(w)
        if got is None:
            got = np.array(self.compiled.encode_ordinary(w), "<u4").tobytes()
            self.words.put(w, got)
        return got


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int), one row for each row; null texts are empty and have no ids.

    ``tokenizer`` is the path of the vocabulary file on the driver, from where a broadcast of its 2 MB or so takes it along.
    """
    kept = shared(df, read_spec(tokenizer), Codec)

    def start():
        c = kept()
        return lambda keys, texts: [(k, c.encode(t or "")) for k, t in zip(keys, texts)]

    return map_rows(pick(df, key, text), f"doc_id {dict(df.dtypes)[key]}, ids array<int>", start)


def decode(df: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text, one row for each row; null ids give an empty text, ids outside the vocabulary nothing."""
    kept = shared(df, read_spec(tokenizer), Codec)

    def start():
        c = kept()
        return lambda keys, lists: [(k, c.decode(x or [])) for k, x in zip(keys, lists)]

    return map_rows(pick(df, key, ids), f"doc_id {dict(df.dtypes)[key]}, text string", start)


def round_trip(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256, one row for each row.

    Each text is encoded and its ids decoded in one step, so ids never leave the task.
    """
    kept = shared(df, read_spec(tokenizer), Codec)

    def start():
        c = kept()
        digest = lambda b: hashlib.sha256(b).hexdigest()

        def f(keys: list, texts: list) -> list[tuple]:
            out = []
            for k, t in zip(keys, texts):
                ids = c.encode(t or "")
                out.append((k, len(ids), digest(c.decimal(ids)), digest(c.decode(ids).encode())))
            return out

        return f

    return map_rows(pick(df, key, text), f"doc_id {dict(df.dtypes)[key]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", start)
