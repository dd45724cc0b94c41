"""Removal of repeated passages: every byte that a 50-byte string covers which also starts in a document with a smaller id.

Equal strings meet in three steps, none of which holds more than a bucket of bounded size.

1. A string of WIDTH bytes is known by the smallest hash of its GRAM-byte grams. Neighbouring strings with the
   same one form a run of at most WIDTH - GRAM + 1 strings. Only the hashes are dealt to buckets; a bucket
   answers which of its runs have a hash that another document has as well (an exact filter: equal strings have
   equal hashes).
2. The texts of those runs are dealt by hash. A bucket's strings are the suffixes of its texts, sorted deep-shallow:
   a multikey quicksort orders them by eight bytes at a time down to SHALLOW bytes, going on inside groups of equal
   ones only; a blind trie orders each group that is left. Equal neighbours give the smallest document of a string,
   and each occurrence in a greater one is a stretch to be removed.
3. Stretches are joined to the texts by document and cut.

Frequent passages: of equal runs in one block of a task only the smallest document's goes on, as the others are
removed whatever the rest holds; a hash with too many runs (a passage in a large share of all documents, each time
among other words) is dealt anew by whole strings, so that no bucket grows with a passage. The list of such hashes
has a proven bound: all runs divided by the limit, which grows with them.

Edge cases: null and empty texts have no bytes; texts under WIDTH bytes keep all; rows with a null id are compared
with none and keep all; rows with one id do not take from each other, equal or not, and each gets a row; ties in
the order of occurrences do not matter, as only smaller ids count; an empty table gives an empty one; only the id
and text columns are read, so extra columns may have any name. A text of any length is read whole, in pieces.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrade.llm.common import blocks, flat, raw_texts, record, written

WIDTH, GRAM, SHALLOW = 50, 16, 24
#: Bytes of text whose hashes one array step holds; bytes of text that one bucket stands for; runs of one hash that a bucket takes in any case.
PIECE, BUCKET_BYTES, HOT_RUNS = 1 << 18, 8 << 20, 100_000
#: Bytes of text of a block.
BLOCK = 2 << 20
#: At most so many hashes are dealt anew by whole strings: the limit of a hash is at least all runs divided by this.
MOST_HOT = 1 << 18

ASKED = pa.schema([("bucket", pa.int32()), ("resolved", pa.bool_()), ("ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("starts", pa.binary()), ("sizes", pa.binary()), ("hashes", pa.binary()), ("weights", pa.binary())])
#: A run of a document is start * 64 + size. Rows without a document: tag TOTAL has the bucket's number of runs, tag HOT a hash and its number of runs.
SHARED = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("run", pa.int64()), ("hash", pa.int64())])
TOTAL, HOT = 0, 1
SNIPPETS = pa.schema([("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("tags", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("starts", pa.binary()), ("sizes", pa.binary()), ("texts", pa.binary()), ("ends", pa.binary())])
STRETCHES = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

_ddl = lambda s: ", ".join(f"{f.name} {_type(f.type)}" for f in s)


def _type(t: pa.DataType) -> str:
    if pa.types.is_list(t):
        return f"array<{_type(t.value_type)}>"
    return {"int64": "long", "int32": "int", "binary": "binary", "string": "string", "bool": "boolean"}[str(t)]


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """At each place the eight bytes from there as one number, in byte order."""
    v = data.astype(np.uint64)
    for k in (1, 2, 4):
        v = (v[:-k] << np.uint64(8 * k)) | v[k:]
    return v


def runs(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of strings, hash) of each run of neighbouring strings with one smallest hash, inside the texts that ends part."""
    starts, sizes, hashes, span = [], [], [], width - gram + 1
    for a in range(0, len(data) - width + 1, piece):
        part = data[a : a + piece + width - 1]
        words = eights(part)
        h = _mix(_mix(words[: len(part) - gram + 1]) + words[gram - 8 :])
        have = 1
        while 2 * have <= span:
            h, have = np.minimum(h[:-have], h[have:]), 2 * have
        if have < span:
            h = np.minimum(h[: len(part) - width + 1], h[span - have :])
        t = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(np.clip(ends - a, 0, len(part))))
        inside = t[: len(h)] == t[width - 1 :]
        new = np.ones(len(h) + 1, bool)
        new[1:-1] = (h[1:] != h[:-1]) | (t[1 : len(h)] != t[: len(h) - 1]) | (inside[1:] != inside[:-1])
        at = np.flatnonzero(new)
        whole = inside[at[:-1]]
        starts.append(a + at[:-1][whole])
        sizes.append(np.diff(at)[whole])
        hashes.append(h[at[:-1][whole]])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    start, size, h = np.concatenate(starts), np.concatenate(sizes), np.concatenate(hashes)
    cuts = -(-size // span)  # a text that repeats itself has one hash over many strings: such runs are cut, so that a size fits a byte
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    return np.repeat(start, cuts) + nth * span, np.minimum(np.repeat(size, cuts) - nth * span, span), np.repeat(h, cuts)


def _groups(order_key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the length at the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], order_key[1:] != order_key[:-1]])), [len(order_key)]]) if len(order_key) else np.zeros(1, np.int64)


def _dealt(bucket: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each bucket: its number, the rows in it by document, and those documents with their numbers of rows."""
    o = np.lexsort((doc, bucket))
    cuts = _groups(bucket[o])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = o[a:b]
        g = _groups(doc[rows])
        yield int(bucket[rows[0]]), rows, doc[rows[g[:-1]]], np.diff(g)


def _key(h40: np.ndarray, bucket: np.ndarray | int, n: int) -> np.ndarray:
    return h40 * np.uint64(n) + np.asarray(bucket, np.uint64)


def _ask(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Of each block: a row for each bucket with the hashes that the block can't answer itself, and the runs whose hash two of its documents have."""
    for batch in blocks(batches, limit=BLOCK):
        ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
        data, ends = flat(raw_texts(batch))
        at, size, h = runs(data, ends)
        if not len(at):
            continue
        doc = np.searchsorted(ends, at, side="right") - 1
        bucket = (h % np.uint64(n)).astype(np.int32)
        h40 = (h // np.uint64(n)) & np.uint64((1 << 40) - 1)
        o = np.lexsort((ids[doc], h40, bucket))
        g = _groups(_key(h40, bucket, n)[o])
        first, last = o[g[:-1]], o[g[1:] - 1]
        many = ids[doc[first]] != ids[doc[last]]
        weight = np.ones(len(at), np.uint32)
        weight[first[many]] = np.diff(g)[many]
        answered = np.zeros(len(at), bool)
        answered[o] = np.repeat(many, np.diff(g))
        asks = ~answered
        asks[first[many]] = True  # the smallest document's run still has to meet those of other blocks
        rows = []
        for resolved, chosen in ((False, asks), (True, answered)):
            of = np.flatnonzero(chosen)
            to = (_mix(tags.view(np.uint64))[doc[of]] % np.uint64(n)).astype(np.int32) if resolved else bucket[of]
            for b, rs, docs, counts in _dealt(to, doc[of]):
                r = of[rs]
                hashes = _key(h40[r], bucket[r], n).tobytes() if resolved else np.ascontiguousarray(h40[r].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
                rows.append((b, resolved, ids[docs], tags[docs], counts.astype(np.int32), (at[r] - ends[doc[r]]).astype("<u4").tobytes(), size[r].astype(np.uint8).tobytes(), hashes, weight[r].astype("<u4").tobytes() if (weight[r] > 1).any() and not resolved else b""))
        yield record(ASKED, **{f.name: [r[i] for r in rows] for i, f in enumerate(ASKED)})


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    return itertools.groupby((r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()), key=lambda r: r["bucket"])


def _owners(rows: list[dict], field: str = "ids") -> np.ndarray:
    return np.concatenate([np.repeat(np.array(r[field], np.int64), r["counts"]) for r in rows])


def _blob(rows: list[dict], field: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(r[field] for r in rows), kind)


def _answer(batches: Iterator[pa.RecordBatch], n: int, hot_runs: int) -> Iterator[pa.RecordBatch]:
    """Of each bucket: the runs whose hash several documents have, and the hashes with more runs than hot_runs."""
    for bucket, group in _by_bucket(batches):
        parts, rest = [], list(group)
        for r in (r for r in rest if r["resolved"]):
            parts.append((_owners([r]), _owners([r], "tags"), _blob([r], "starts", "<u4"), _blob([r], "sizes", np.uint8), _blob([r], "hashes", "<u8")))
        rows, n_runs, busy, load = [r for r in rest if not r["resolved"]], 0, [], []
        if rows:
            ids, tags, starts, sizes = _owners(rows), _owners(rows, "tags"), _blob(rows, "starts", "<u4"), _blob(rows, "sizes", np.uint8)
            h40 = np.zeros((len(ids), 8), np.uint8)
            h40[:, :5] = _blob(rows, "hashes", np.uint8).reshape(-1, 5)
            h40 = h40.reshape(-1).view("<u8")
            weights = np.concatenate([np.frombuffer(r["weights"], "<u4") if r["weights"] else np.ones(len(r["sizes"]), "<u4") for r in rows]).astype(np.int64)
            o = np.lexsort((ids, h40))
            g = _groups(h40[o])
            shared = ids[o[g[:-1]]] != ids[o[g[1:] - 1]]
            load = np.add.reduceat(weights[o], g[:-1])
            keep = o[np.repeat(shared, np.diff(g))]
            keys = _key(h40, bucket, n)
            parts.append((ids[keep], tags[keep], starts[keep], sizes[keep], keys[keep]))
            hot = load > hot_runs
            n_runs, busy, load = int(weights.sum()), keys[o[g[:-1][hot]]].view(np.int64).tolist(), load[hot].tolist()
        ids, tags, starts, sizes, hashes = (np.concatenate(c) for c in zip(*parts, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, tags, starts.astype(np.int64) * 64 + sizes, hashes.view(np.int64))], schema=SHARED)
        yield record(SHARED, doc_id=[None] * (1 + len(busy)), tag=[TOTAL] + [HOT] * len(busy), run=[n_runs, *load], hash=[None, *busy])


def _lists(column: pa.ListArray) -> tuple[list[np.ndarray], np.ndarray]:
    """The fields of a column of lists of structures, flat, and where each row's begin (one more entry than rows)."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return [f.to_numpy(zero_copy_only=False) for f in column.flatten().flatten()], np.concatenate([[0], np.cumsum(sizes)])


def _texts_of_runs(batches: Iterator[pa.RecordBatch], n: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each block: a row for each bucket with the texts of the runs it has to sort; of equal texts those of the smallest document."""
    for batch in blocks(batches, "z", BLOCK):
        pieces: dict[bytes, int] = {}
        columns: list[tuple] = []  # of each document: its place, and the start, hash and piece of each run
        asked = batch.filter(batch.column("runs").is_valid())
        ids, tags = asked.column("doc_id").to_numpy(), asked.column("tag").to_numpy()
        (all_runs, all_hashes), cuts = _lists(asked.column("runs"))
        for at, row in enumerate(asked.select(["z", "n_bytes"]).to_pylist()):
            text, mine = pa.decompress(row["z"], row["n_bytes"], codec="zstd", asbytes=True), slice(cuts[at], cuts[at + 1])
            found, first = np.unique(all_runs[mine], return_index=True)
            starts, sizes, hashes = found >> 6, found & 63, all_hashes[mine][first].view(np.uint64)
            if len(hot) and (anew := np.isin(hashes, hot)).any():
                single = np.concatenate([np.arange(s, s + c) for s, c in zip(starts[anew].tolist(), sizes[anew].tolist(), strict=True)])
                starts, sizes = np.concatenate([starts[~anew], single]), np.concatenate([sizes[~anew], np.ones(len(single), np.int64)])
                hashes = np.concatenate([hashes[~anew], np.array([xxhash.xxh64_intdigest(text[j : j + WIDTH]) for j in single.tolist()], np.uint64)])
            which = [pieces.setdefault(text[a:b], len(pieces)) for a, b in zip(starts.tolist(), (starts.astype(np.int64) + sizes + (WIDTH - 1)).tolist(), strict=True)]
            columns.append((np.full(len(which), at), starts, hashes, np.array(which, np.int64)))
        if not columns:
            continue
        doc, starts, hashes, which = (np.concatenate(c) for c in zip(*columns, strict=True))
        texts = list(pieces)
        lens = np.array([len(t) for t in texts], np.int64)
        least = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(least, which, ids[doc])
        first = ids[doc] == least[which]
        kept, gone = np.flatnonzero(first), np.flatnonzero(~first)
        rows = []
        for b, rs, docs, counts in _dealt((_mix(hashes[kept]) % np.uint64(n)).astype(np.int32), doc[kept]):
            r = kept[rs]
            rows.append((b, ids[docs], tags[docs], counts.astype(np.int32), starts[r].astype("<u4").tobytes(), (lens[which[r]] - WIDTH + 1).astype(np.uint8).tobytes(), pa.compress(b"".join([texts[k] for k in which[r].tolist()]), codec="zstd", asbytes=True), b""))
        ready = _stretches(ids[doc[gone]], tags[doc[gone]], starts[gone].astype(np.int64), starts[gone] + lens[which[gone]])
        other = np.flatnonzero((ready[0][1:] != ready[0][:-1]) | (ready[1][1:] != ready[1][:-1])) + 1
        cuts = [0, *other.tolist(), len(ready[0])] if len(ready[0]) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            to = int(_mix(ready[1][a : a + 1].view(np.uint64))[0] % np.uint64(n))
            rows.append((to, ready[0][a : a + 1], ready[1][a : a + 1], [b - a], ready[2][a:b].astype("<u4").tobytes(), b"", b"", ready[3][a:b].astype("<u4").tobytes()))
        yield record(SNIPPETS, **{f.name: [r[i] for r in rows] for i, f in enumerate(SNIPPETS)})


def _stretches(ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The stretches by document (id, tag, start, end), touching ones of a document joined."""
    o = np.lexsort((starts, ids, tags))
    ids, tags, starts, ends = ids[o], tags[o], starts[o], ends[o]
    if not len(ids):
        return ids, tags, starts, ends
    other = np.concatenate([[False], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])
    ahead = np.cumsum(other) << 33  # keeps documents apart; a text has under 2^31 bytes
    starts, ends = joined(starts + ahead, ends + ahead)
    document = starts >> 33
    first = np.concatenate([[0], np.flatnonzero(other)])[document]
    return ids[first], tags[first], starts - (document << 33), ends - (document << 33)


def joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches (starts ascending) with those that touch or overlap made one."""
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([new[1:], [True]])]


def blind_trie(keys: list[bytes]) -> list[list[int]]:
    """The places of the keys (of one length) in order, those of equal keys together: a trie whose nodes know only the byte they branch on; a key
    goes down blindly, is compared once with the leaf that it reaches, and branches off at the first byte that differs."""
    root: list = []
    for i, key in enumerate(keys):
        if not root:
            root = [key, [i]]
            continue
        node = root
        while type(node[0]) is int:
            node = node[1].get(key[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == key:
            node[1].append(i)
            continue
        differ = len(key) - ((int.from_bytes(key) ^ int.from_bytes(other)).bit_length() + 7) // 8
        above, node = None, root
        while type(node[0]) is int and node[0] < differ:
            above, node = node, node[1][key[node[0]]]
        leaf = [key, [i]]
        if node[0] == differ and type(node[0]) is int:
            node[1][key[differ]] = leaf
            continue
        branch = [differ, {other[differ]: node, key[differ]: leaf}]
        if above is None:
            root = branch
        else:
            above[1][key[above[0]]] = branch
    out, left = [], [root] if root else []
    while left:
        node = left.pop()
        if type(node[0]) is int:
            left += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out.append(node[1])
    return out


def deep_shallow(data: bytes, at: np.ndarray, owner: np.ndarray | None = None, width: int = WIDTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The places in order of the width bytes that begin there, and where in that order each group of equal strings begins (and the length).
    The quicksort partitions by eight bytes at once and goes deeper only where they are equal. With owner, a group that is left of one owner only is not ordered further: each of its places stands alone."""
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(width + 8, np.uint8)])
    words = eights(padded)
    o = np.argsort(words[at], kind="quicksort")
    order, head = at[o], np.ones(len(at), bool)
    owners = None if owner is None else owner[o]
    key = words[order]
    head[1:] = key[1:] != key[:-1]
    for depth in range(8, shallow, 8):
        starts = np.flatnonzero(head)
        size = np.diff(np.append(starts, len(order)))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if not len(tied):
            break
        group, key = np.repeat(np.arange(len(size)), size)[tied], words[order[tied] + depth]
        o = np.lexsort((key, group))
        order[tied] = order[tied[o]]
        if owners is not None:
            owners[tied] = owners[tied[o]]
        head[tied[1:]] |= key[o][1:] != key[o][:-1]
    starts = np.flatnonzero(head)
    size = np.diff(np.append(starts, len(order)))
    if owners is not None and len(order):
        alone = np.minimum.reduceat(owners, starts) == np.maximum.reduceat(owners, starts)
        head |= np.repeat(alone, size)
        starts, size = starts[~alone], size[~alone]
    # A trie of two keys is one comparison: all of them at once.
    a = starts[size == 2]
    if len(a):
        left, right = order[a], order[a + 1]
        less, equal = np.zeros(len(a), bool), np.ones(len(a), bool)
        for depth in [*range(shallow, width - 8, 8), width - 8]:
            x, y = words[left + depth], words[right + depth]
            less |= equal & (y < x)
            equal &= x == y
        order[a], order[a + 1] = np.where(less, right, left), np.where(less, left, right)
        head[a + 1] = ~equal
    for a, n in zip(starts[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        places = order[a : a + n].copy()
        at_ = a
        for leaf in blind_trie([data[p + shallow : p + width] for p in places.tolist()]):
            order[at_ : at_ + len(leaf)] = places[leaf]
            head[at_ : at_ + len(leaf)] = False
            head[at_] = True
            at_ += len(leaf)
    return order, np.append(np.flatnonzero(head), len(order))


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket: the stretches to be removed, by document."""
    for _, group in _by_bucket(batches):
        rows = list(group)
        for r in (r for r in rows if r["ends"]):
            yield _stretch_batch(_owners([r]), _owners([r], "tags"), _blob([r], "starts", "<u4"), _blob([r], "ends", "<u4"))
        rows = [r for r in rows if not r["ends"]]
        if rows:
            ids, tags, starts, sizes = _owners(rows), _owners(rows, "tags"), _blob(rows, "starts", "<u4").astype(np.int64), _blob(rows, "sizes", np.uint8).astype(np.int64)
            texts: dict[bytes, int] = {}
            which, k = np.empty(len(ids), np.int64), 0
            for r in rows:
                lens = np.frombuffer(r["sizes"], np.uint8).astype(np.int64) + WIDTH - 1
                whole, ends = pa.decompress(r["texts"], int(lens.sum()), codec="zstd", asbytes=True), np.cumsum(lens).tolist()
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    which[k] = texts.setdefault(whole[a:b], len(texts))
                    k += 1
            least = np.full(len(texts), np.iinfo(np.int64).max)
            np.minimum.at(least, which, ids)
            lens = np.array([len(t) for t in texts], np.int64)
            begins = np.cumsum(lens) - lens
            strings = lens - WIDTH + 1
            text_of = np.repeat(np.arange(len(lens)), strings)
            at = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings) + begins[text_of]
            first = np.repeat(least, strings)
            order, heads = deep_shallow(b"".join(texts), at, first)
            of_place = np.empty(begins[-1] + lens[-1], np.int32)
            of_place[at] = np.arange(len(at), dtype=np.int32)
            slot = of_place[order]
            smallest = np.empty(len(at), np.int64)
            smallest[slot] = np.repeat(np.minimum.reduceat(first[slot], heads[:-1]), np.diff(heads))
            # Each occurrence of a text: its strings with an owner that is smaller than the occurrence's document.
            base = (np.cumsum(strings) - strings)[which]
            occurrence = np.repeat(np.arange(len(ids)), sizes)
            offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            gone = smallest[base[occurrence] + offset] < ids[occurrence]
            occurrence, offset = occurrence[gone], offset[gone]
            if len(occurrence):
                new = np.concatenate([[True], (occurrence[1:] != occurrence[:-1]) | (offset[1:] != offset[:-1] + 1)])
                f, t = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(new)) - 1
                of = occurrence[f]
                yield _stretch_batch(*_stretches(ids[of], tags[of], starts[of] + offset[f], starts[of] + offset[t] + WIDTH))


def _stretch_batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype()), f.type) for c, f in zip(columns, STRETCHES, strict=True)], schema=STRETCHES)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "z"):
        rows = []
        (starts, ends), cuts = _lists(batch.column("stretches"))
        for at, row in enumerate(batch.select(["doc_id", "z", "n_bytes"]).to_pylist()):
            text = pa.decompress(row["z"], row["n_bytes"], codec="zstd", asbytes=True) if row["n_bytes"] else b""
            kept, n_spans = remaining(text, starts[cuts[at] : cuts[at + 1]], ends[cuts[at] : cuts[at + 1]])
            rows.append((row["doc_id"], len(text), len(text) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()))
        yield record(CUT, **{f.name: [r[i] for r in rows] for i, f in enumerate(CUT)})


def remaining(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int]:
    """The bytes outside the stretches, and how many runs of bytes those make."""
    if not len(starts):
        return text, 0
    o = np.argsort(starts, kind="stable")
    starts, ends = joined(starts[o], ends[o])
    return b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)], strict=True)), len(starts)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        texts = raw_texts(batch)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array([len(t) for t in texts], pa.int64()), pa.array([pa.compress(t, codec="zstd", asbytes=True) if t else b"" for t in texts], pa.binary())], names=["doc_id", "tag", "n_bytes", "z"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_runs: int = HOT_RUNS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans and kept_sha256. Integer ids."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"), F.col(text_col).alias("text"))
    known = named.where("doc_id is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(4, -(-total // bucket_bytes))  # buckets of hashes; their texts take twice as many
    tasks = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), n), 50_000)

    asked = known.mapInArrow(partial(_ask, n=n), _ddl(ASKED)).repartition(tasks, F.xxhash64("bucket")).sortWithinPartitions("bucket")
    shared = written(asked.mapInArrow(partial(_answer, n=n, hot_runs=hot_runs), _ddl(SHARED)), "repeats-shared")
    limit = max(hot_runs, (shared.where(F.col("doc_id").isNull() & (F.col("tag") == TOTAL)).agg(F.sum("run")).first()[0] or 0) // MOST_HOT)
    hot = np.array([r.hash for r in shared.where(F.col("doc_id").isNull() & (F.col("tag") == HOT) & (F.col("run") > limit)).select("hash").collect()], np.int64).view(np.uint64)

    packed = known.mapInArrow(_packed, "doc_id long, tag long, n_bytes long, z binary")
    by_doc = ["doc_id", "tag"]
    # A left join as below, so that both read one exchange of the texts; rows without runs are passed over by the function.
    with_runs = packed.join(shared.where("doc_id is not null").groupBy(*by_doc).agg(F.collect_list(F.struct("run", "hash")).alias("runs")), by_doc, "left")
    snippets = with_runs.mapInArrow(partial(_texts_of_runs, n=2 * n, hot=hot), _ddl(SNIPPETS)).repartition(tasks, F.xxhash64("bucket")).sortWithinPartitions("bucket")
    stretches = snippets.mapInArrow(_sorted, _ddl(STRETCHES)).groupBy(*by_doc).agg(F.collect_list(F.struct("start", "end")).alias("stretches"))
    others = named.where("doc_id is null").mapInArrow(_packed, "doc_id long, tag long, n_bytes long, z binary").withColumn("stretches", F.lit(None).cast("array<struct<start:int,end:int>>"))
    return packed.join(stretches, by_doc, "left").unionByName(others).mapInArrow(_cut, _ddl(CUT))
