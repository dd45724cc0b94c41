"""Token counts by byte-pair merging on a heap and a linked list.

The vocabulary file's normaliser and word pattern are applied to each white-space chunk of a text (neither
looks across white space), then each word's byte symbols are merged: a heap holds the adjacent pairs by
rank and place, a doubly linked list the symbols; the lowest pair is popped until none is left. A word's
count is its symbols minus its merges; no identifier is made.

Edge cases: null text counts as empty (0 bytes, 0 tokens); a text of white space only has 0 tokens; one
word of any length is merged whole; repeated rows are counted each; an empty table gives an empty one;
other columns of the input are ignored, whatever their names; a null id stays null.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrade.llm.common import blocks, raw_texts, record

#: Chunks and words that a worker keeps counts of, in each of two generations.
CACHE_ENTRIES = 400_000
#: Longer chunks are counted anew each time.
CACHED_BYTES = 64


class TwoGenerations:
    """A bounded map: when the young half is full it becomes the old half, and what was not asked for again goes."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.young, self.old, self.entries = {}, {}, entries

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.young[key] = found
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.entries:
            self.young, self.old = {}, self.young
        self.young[key] = value


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself where it is printable, else the next free one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges the symbols of one word take."""
    n = len(symbols)
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    if not heap:
        return 0
    heapq.heapify(heap)
    after, before, done = [*range(1, n), -1], [*range(-1, n - 1)], 0
    while heap:
        rank, i = heapq.heappop(heap)
        left = symbols[i]
        j = after[i] if left is not None else -1
        if j < 0 or ranks.get((left, symbols[j])) != rank:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = left + symbols[j], None
        done += 1
        k, h = after[j], before[i]
        after[i] = k
        if k >= 0:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if h >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return done


class Rules:
    """How one vocabulary file cuts a text into words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: only lower-casing byte-level BPE is known here, not {kinds}")
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in spec["added_tokens"]))

    def words(self, piece: str) -> list[str]:
        """The words of a text without special strings and without white space that ASCII has."""
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")  # no final-sigma rule
        return self.pattern.findall(piece.lower())


class Counter(Rules):
    """Counts the tokens of texts by the rules in one vocabulary file."""

    def __init__(self, path: str):
        super().__init__(path)
        spec = self.spec
        self.end, self.symbol = spec["model"]["end_of_word_suffix"] or "", byte_symbols()
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.by_word, self.by_chunk = TwoGenerations(), TwoGenerations()

    def word(self, word: str) -> int:
        found = self.by_word.get(word)
        if found is None:
            symbol = self.symbol
            symbols = [symbol[b] for b in word.encode()]
            symbols[-1] += self.end
            found = len(symbols)
            found -= merges(symbols, self.ranks)
            if len(word) <= CACHED_BYTES:
                self.by_word.put(word, found)
        return found

    def chunk(self, chunk: bytes) -> int:
        """Tokens of a text without white space that ASCII has; the special strings in it are a token each."""
        text, n = chunk.decode(), 0
        if "<|" in text:
            n = len(self.special.findall(text))
            pieces = self.special.split(text)
        else:
            pieces = (text,)
        for piece in pieces:
            n += sum(map(self.word, self.words(piece)))
        if len(chunk) <= CACHED_BYTES:
            self.by_chunk.put(chunk, n)
        return n

    def text(self, text: bytes) -> int:
        young, n = self.by_chunk.young, 0
        for chunk in text.split():
            found = young.get(chunk)
            if found is None:
                found = self.by_chunk.get(chunk)
                if found is None:
                    found = self.chunk(chunk)
                young = self.by_chunk.young
            n += found
        return n


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: the id, n_bytes, n_tokens and over_limit (more tokens than limit). vocabulary: a .json file's path on every machine."""
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in blocks(batches, text_col):
            texts = raw_texts(batch, text_col)
            n = [count.text(x) for x in texts]
            ids = batch.column(id_col)
            out = pa.schema([pa.field(id_col, ids.type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
            yield record(out, **{id_col: ids, "n_bytes": [len(x) for x in texts], "n_tokens": n, "over_limit": [x > limit for x in n]})

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
