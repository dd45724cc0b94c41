"""Line-first cleaning: each line is judged on its own, failing lines go, then documents that lost too much go.

Lines are what \\n separates; a word is a run without ASCII white space. A line with a word fails as
  repeated     it equals an earlier line of the text;
  boilerplate  it holds one of BOILERPLATE, in any case;
  navigation   a third or more of its words are a lone | or > or an arrow;
  symbols      more than one character in six of its words is one of #*$%&|<>;
  shouting     three words or more, ASCII capitals and no ASCII small letters;
  punctuation  a ! for every two words or more, or fewer than five words and a last character that is an
               ASCII letter, digit or bar (a heading or menu entry, no sentence);
  monotony     ten words or more, of which under a quarter differ.
A document is rejected if its failing lines hold over half of its words, or if the base rules fail: under
20 words, or over 30 % of them in eight-word windows found twice or more.

Edge cases: null text counts as empty: no words, base_failed, not kept. Lines without a word never fail and
weigh nothing. Repeated rows are judged each alike; very long texts are judged whole, in one task's memory.
An empty table gives an empty one. Other columns, whatever their names, are ignored. A null id stays null.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrade.llm.common import blocks, raw_texts, record, windows, word_ids

SYMBOLS = b"#*$%&|<>"
BOILERPLATE = ("all rights reserved", "cookie", "enable javascript", "licensed under", "log in to", "lorem ipsum", "privacy policy", "public license", "sign up for", "subscribe to our", "terms of service", "terms of use")
_boiler = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
_bar = re.compile(rb"(?<![^ \t\n\r\x0b\x0c])(?:\||>|\xc2\xbb|\xe2\x86\x92)(?![^ \t\n\r\x0b\x0c])")
_tail = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789|")
_space = b" \t\n\r\x0b\x0c"
_continuation = bytes(range(0x80, 0xC0))


def length(text: bytes) -> int:
    """Code points."""
    return len(text) if text.isascii() else len(text.translate(None, _continuation))


def verdict(line: bytes, words: list[bytes]) -> str:
    """The first rule that a line with words fails, else an empty string."""
    n, shown = len(words), line.translate(None, _space)
    if _boiler.search(line.lower()):
        return "boilerplate"
    if (b"|" in line or b">" in line or not line.isascii()) and 3 * len(_bar.findall(line)) >= n:
        return "navigation"
    if 6 * (len(shown) - len(shown.translate(None, SYMBOLS))) > length(shown):
        return "symbols"
    if n >= 3 and line.isupper():
        return "shouting"
    if 2 * line.count(b"!") >= n or n < 5 and words[-1][-1] in _tail:
        return "punctuation"
    if n >= 10 and 4 * len(set(words)) < n:
        return "monotony"
    return ""


def judge(text: bytes) -> tuple[list[bytes], int, int]:
    """The lines that stay, the number of repeated lines, and the words in lines that fail."""
    seen, stay, repeated, lost = set(), [], 0, 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            if line in seen:
                repeated += 1
                lost += len(words)
                continue
            seen.add(line)
            if verdict(line, words):
                lost += len(words)
                continue
        stay.append(line)
    return stay, repeated, lost


def repeated_words(ids: np.ndarray, starts: np.ndarray, width: int = 8) -> np.ndarray:
    """For each text, the words that lie in a window of width words found twice or more in it."""
    at, rank = windows(ids, starts, width)
    text = np.searchsorted(starts, at, side="right") - 1
    order = np.lexsort((rank, text))
    same = (text[order][1:] == text[order][:-1]) & (rank[order][1:] == rank[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + width, -1)
    inside = np.cumsum(np.cumsum(edge)[:-1] > 0) if len(ids) else np.zeros(0, np.int64)
    total = np.concatenate(([0], inside))
    return total[starts[1:]] - total[starts[:-1]]


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """Per row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words, and the cleaned text if asked for."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, " + "".join(f"{c} long, " for c in counts) + "base_failed boolean, kept boolean, lost_words long" + ", cleaned string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            texts = raw_texts(batch, text_col)
            ids, starts = word_ids(texts, defaultdict(count().__next__))
            n_words, n_repeat = np.diff(starts), repeated_words(ids, starts)
            judged = [judge(x) for x in texts]
            lost = np.array([x[2] for x in judged], np.int64)
            base = (n_words < least_words) | (100 * n_repeat > most_repeated * n_words)
            out = {
                id_col: batch.column(id_col), "n_words": n_words, "word_chars": [length(x.translate(None, _space)) for x in texts],
                "n_symbols": [len(x) - len(x.translate(None, SYMBOLS)) for x in texts], "n_dup_lines": [x[1] for x in judged], "n_repeat_words": n_repeat,
                "base_failed": base, "kept": ~base & (2 * lost <= n_words), "lost_words": lost,
            }
            if with_text:
                out["cleaned"] = [b"\n".join(x[0]).decode() for x in judged]
            fields = [(id_col, batch.column(id_col).type), *((c, pa.int64()) for c in counts), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost_words", pa.int64())]
            yield record(pa.schema(fields + [("cleaned", pa.string())] * with_text), **out)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
