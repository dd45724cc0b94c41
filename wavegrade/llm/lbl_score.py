"""Language-model scores: a log-bilinear model trained in numpy by noise-contrastive estimation.

Counts of all words come from every training text. The VOCABULARY most frequent words (the end of a text
always among them) have vectors of their own; all other words share one more class, in which they are told
apart by smoothed counts. P(word) = P(class | two words before) * P(word | class, two words before): the
vectors of the two words before, each times its matrix, predict a vector, whose products with the vectors of
the classes and of the class's words are the scores. Classes hold CLASS_WORDS words of neighbouring frequency,
so both normalisers are sums over a bounded number of words, taken by batched matrix products.

Training: all positions of all training texts. A position belongs to one of ROUNDS rounds, by its place in its block. In each
round every partition trains on its positions from the same start by noise-contrastive estimation (noise
classes by their frequency; noise words by theirs within the class), and Spark sums the changes, weighed by
positions, in two steps; the driver only holds one model. The start is the smoothed unigram.

Counts of frequent words (FREQUENT at most) are sent to the tasks; the other words of a text are joined to
their counts by Spark.

Edge cases: null and empty texts are one end token; words never seen have count 0 and a smoothed share; a
null id is held out or not by the crc32 of empty text; repeated rows are scored each; a very long text is
scored whole; without training rows base_score follows its formula with N = V = 0 and the model is its start;
an empty table gives an empty one; only the id and text columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrade.llm.common import blocks, raw_texts, written

VOCABULARY, CLASS_WORDS, FREQUENT = 16_384, 128, 50_000
SIZE, NOISE, WORD_NOISE, BATCH, ROUNDS, RATE = 16, 48, 4, 256, 2, 0.1
#: Pieces that a model is cut into to be summed, pairs of words that one step of scoring holds, and tokens among which equal ones are scored once.
PIECES, STEP_TOKENS, ALIKE = 32, 1 << 14, 1 << 20
#: Tokens that a task of training takes at least, so that small tables aren't learned in crumbs, and positions that it has as rows at a time.
TASK_TOKENS, STRETCH = 8_000_000, 500_000
#: Batches whose noise words are drawn together.
DRAWN = 64
END = b""


def words_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts; the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for batch in blocks(batches, text_col):
            for t in raw_texts(batch, text_col):
                seen.update(words_of(t))
            if len(seen) > 200_000:
                yield out()
                seen = Counter()
        if seen:
            yield out()

    return docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def triples(c: np.ndarray, n: int) -> np.ndarray:
    """A row for each token of a flat list of texts: the two words before it and itself."""
    at = np.flatnonzero(c != n + 1)
    return np.stack([c[at - 2], c[at - 1], c[at]], 1)


class Model:
    """ids: word -> number by frequency; n: known words, also the number of the class's stand-in "other word"; n + 1 stands before a text."""

    NAMES = ("context", "mix", "class_vector", "class_bias", "word_vector", "word_bias")

    def __init__(self, counts: dict[bytes, int], all_mass: float):
        self.words = sorted(counts, key=lambda w: (-counts[w], w))
        self.ids, self.n = {w: i for i, w in enumerate(self.words)}, len(self.words)
        self.classes = -(-self.n // CLASS_WORDS)  # and one more for other words
        share = np.array([counts[w] + 0.5 for w in self.words])
        self.other_mass = max(all_mass - share.sum(), 0.5)
        padded = np.concatenate([share, np.zeros(self.classes * CLASS_WORDS - self.n)]).reshape(self.classes, CLASS_WORDS)
        mass = np.append(padded.sum(1), self.other_mass)
        self.class_share, self.word_share = mass / mass.sum(), padded / padded.sum(1, keepdims=True)
        rng = np.random.default_rng(3)
        with np.errstate(divide="ignore"):
            word_bias = np.log(self.word_share)  # places past the last word can't be drawn
        f = np.float32
        self.values = {
            "context": rng.normal(0, 0.1, (self.n + 2, SIZE)).astype(f), "mix": np.stack([np.eye(SIZE)] * 2).astype(f), "class_vector": np.zeros((self.classes + 1, SIZE), f),
            "class_bias": np.log(self.class_share).astype(f), "word_vector": np.zeros((self.classes * CLASS_WORDS, SIZE), f), "word_bias": word_bias.ravel().astype(f),
        }

    def flat(self, texts: list[list[bytes]], ids: dict[bytes, int] | None = None) -> np.ndarray:
        """The numbers of all texts' words, two marks before each text. ids: other numbers than the model's own."""
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.full(lengths.sum() + 2 * len(texts), self.n + 1, np.int64)
        at = np.arange(lengths.sum()) + 2 * np.repeat(np.arange(1, len(texts) + 1), lengths)
        flat[at] = np.fromiter(map((ids or self.ids).get, chain.from_iterable(texts), repeat(self.n)), np.int64, len(at))
        return flat

    def numbers(self, texts: list[list[bytes]]) -> np.ndarray:
        return triples(self.flat(texts), self.n)

    def log10(self, rows: np.ndarray) -> np.ndarray:
        """log10 P of each row's word after the two before it; of other words P of their class. Equal rows are found once, and what depends on the two before once for each two."""
        p, one = self.values, lambda x: np.concatenate([x[0], x[1][:, None]], 1)
        by_class, by_word = one((p["class_vector"], p["class_bias"])), one((p["word_vector"], p["word_bias"]))
        left, right = (p["context"] @ p["mix"][k] for k in (0, 1))
        out, base = np.zeros(len(rows)), self.n + 2
        for k in range(0, len(rows), ALIKE):
            a, b, w = rows[k : k + ALIKE].T
            alike, which = np.unique((a * base + b) * base + w, return_inverse=True)
            two, word = np.divmod(alike, base)
            new = np.concatenate(([True], two[1:] != two[:-1]))
            pairs, of = two[new], np.cumsum(new) - 1
            cuts = np.append(np.flatnonzero(new), len(alike))
            logs = np.zeros(len(alike))
            for j in range(0, len(pairs), STEP_TOKENS):
                step = pairs[j : j + STEP_TOKENS]
                q = np.ones((len(step), SIZE + 1), np.float32)  # the last column meets the bias
                q[:, :SIZE] = left[step // base] + right[step % base]
                here = slice(cuts[j], cuts[j + len(step)])
                logs[here] = self._log(of[here] - j, word[here], q, by_class, by_word)
            out[k : k + ALIKE] = logs[which]
        return out / np.log(10)

    def _log(self, row: np.ndarray, word: np.ndarray, q: np.ndarray, by_class: np.ndarray, by_word: np.ndarray) -> np.ndarray:
        """Of each word its log P after the pair of words whose vector is that row of q."""
        of = np.minimum(word // CLASS_WORDS, self.classes).astype(np.int16)
        of[word == self.n] = self.classes
        out = chosen(q @ by_class.T, row, of)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(self.classes + 1))
        for c in range(self.classes):
            at = order[cuts[c] : cuts[c + 1]]
            if len(at):
                out[at] += chosen(q[row[at]] @ by_word[c * CLASS_WORDS : (c + 1) * CLASS_WORDS].T, np.arange(len(at)), word[at] - c * CLASS_WORDS)
        return out

    def trained(self, parts: Iterator[np.ndarray], seed: int, rate: float = RATE) -> dict[str, np.ndarray]:
        """The change of each value after one pass over the rows of all parts."""
        rng = np.random.default_rng(seed)
        with np.errstate(divide="ignore", invalid="ignore"):
            class_bias = self.values["class_bias"] - np.log(NOISE * self.class_share).astype(np.float32)
            word_bias = self.values["word_bias"] - np.log(WORD_NOISE * self.word_share).ravel().astype(np.float32)
        wide = lambda vectors, bias: np.column_stack([vectors, np.where(np.isfinite(bias), bias, 0), np.zeros_like(bias)])
        # A bias is a column behind its vector and has the noise's share taken off; one more column makes rows whole pairs. Places past the last word are never drawn.
        start = {
            "context": self.values["context"], "mix": self.values["mix"].reshape(-1, SIZE),
            "class": wide(self.values["class_vector"], class_bias), "word": wide(self.values["word_vector"], word_bias),
        }
        p = {k: v.copy() for k, v in start.items()}
        square = {k: np.full_like(v, 1e-2) for k, v in p.items()}
        keep, other_word = aliases(self.word_share)

        def down_all(name: str, grad: np.ndarray) -> None:
            square[name] += grad * grad
            p[name] -= rate * grad / np.sqrt(square[name])

        def down(name: str, index: np.ndarray, grad: np.ndarray) -> None:
            order = np.argsort(index, kind="stable")  # 16 bits: by radix
            index = index.take(order)
            at = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
            # Pairs of columns are added as one complex number, in half the steps.
            g, i = np.add.reduceat(grad.take(order, 0).view(np.complex64), at, 0).view(np.float32), index.take(at)
            s, v = square[name].take(i, 0), p[name].take(i, 0)
            s += g * g
            square[name][i] = s
            g *= np.float32(rate)
            g /= np.sqrt(s, out=s)
            v -= g
            p[name][i] = v

        def steps() -> Iterator[tuple[np.ndarray, ...]]:
            """Of each batch the words before, classes, how often each class was drawn as noise, and for its first rows, those with a known word, that word and noise from its class."""
            for rows in parts:
                rows = rows[rng.permutation(len(rows))]
                rows = rows[np.argsort(np.arange(len(rows)) // BATCH * 2 + (rows[:, 2] == self.n), kind="stable")]
                before, w = rows[:, :2].astype(np.uint16), rows[:, 2]
                of = np.where(w == self.n, self.classes, w // CLASS_WORDS).astype(np.uint16)
                starts = range(0, len(rows), BATCH)
                known = np.add.reduceat((w != self.n).astype(np.int64), starts)
                noise = rng.multinomial(NOISE, self.class_share, len(known))
                for j, k in enumerate(starts):
                    if j % DRAWN == 0:
                        own = np.minimum(w[k : k + DRAWN * BATCH], self.n - 1)
                        drawn = rng.random((len(own), WORD_NOISE), np.float32) * np.float32(CLASS_WORDS)
                        place = drawn.astype(np.int32)
                        drawn -= place
                        place += (own // CLASS_WORDS * CLASS_WORDS).astype(np.int32)[:, None]
                        words = np.concatenate([own[:, None], np.where(drawn < keep.take(place), place, other_word.take(place))], 1).astype(np.uint16)
                    here = k % (DRAWN * BATCH)
                    yield before[k : k + BATCH], of[k : k + BATCH], noise[j], words[here : here + known[j]]

        ones, nth = np.zeros((BATCH, SIZE + 2), np.float32), np.arange(BATCH)
        ones[:, SIZE] = 1  # meets the bias
        for before, of, drawn, words in steps():
            r, q1, k = p["context"].take(before, 0).reshape(len(before), -1), ones[: len(before)], len(words)
            np.matmul(r, p["mix"], out=q1[:, :SIZE])
            # Classes: one draw of noise serves the whole batch.
            s, g, own = p["class"] @ q1.T, np.zeros((self.classes + 1, len(before)), np.float32), (of, nth[: len(before)])
            at = np.flatnonzero(drawn)
            g[at] = sigmoid(s.take(at, 0)) * drawn[at].astype(np.float32)[:, None]
            g[own] += sigmoid(s[own]) - 1
            dq = g.T @ p["class"][:, :SIZE]
            down_all("class", g @ q1)
            # Words of the class, for the rows with a known word.
            if k:
                u = p["word"].take(words, 0)
                g = sigmoid(np.einsum("nd,nkd->nk", q1[:k], u))
                g[:, 0] -= 1
                dq[:k] += np.einsum("nk,nkd->nd", g, u)[:, :SIZE]
                down("word", words.ravel(), (g[:, :, None] * q1[:k, None, :]).reshape(-1, SIZE + 2))
            back = dq @ p["mix"].T
            down_all("mix", r.T @ dq)
            down("context", before.ravel(), back.reshape(-1, SIZE))
        change = {k: p[k] - start[k] for k in p}
        return {
            "context": change["context"], "mix": change["mix"].reshape(self.values["mix"].shape),
            "class_vector": change["class"][:, :SIZE], "class_bias": change["class"][:, SIZE], "word_vector": change["word"][:, :SIZE], "word_bias": change["word"][:, SIZE],
        }


def aliases(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of shares that sum to 1 what is needed to draw from a row in one step: a place is drawn evenly; it counts itself
    by the chance in keep, else the place in other counts (both flat, over all rows)."""
    rows, k = share.shape
    left, row = share * k, np.arange(rows)
    keep, other, done = np.ones((rows, k)), np.tile(np.arange(k), (rows, 1)), np.zeros((rows, k), bool)
    for _ in range(k - 1):
        small, big = np.where(done, np.inf, left).argmin(1), np.where(done, -np.inf, left).argmax(1)
        keep[row, small], other[row, small], done[row, small] = left[row, small], big, True
        left[row, big] -= 1 - keep[row, small]
    return keep.ravel().astype(np.float32), (other + row[:, None] * k).ravel().astype(np.int32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """x is overwritten."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def chosen(s: np.ndarray, row: np.ndarray, which: np.ndarray) -> np.ndarray:
    """log softmax of rows at places, a row and a place each; s is overwritten."""
    out = s[row, which].astype(float)
    if s.max(initial=0) > 80:  # exp would overflow
        top = s.max(1)
        s -= top[:, None]
        out -= top[row]
    np.exp(s, out=s)
    return out - np.log(s @ np.ones(s.shape[1], s.dtype))[row]


def positions(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """The numbers (16 bits each) of all words of all texts, two marks n + 1 before each text: every position, and what stands before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text_col):
            yield pa.RecordBatch.from_arrays([pa.array([model.flat([words_of(t) for t in raw_texts(batch, text_col)]).astype(np.uint16).tobytes()], pa.binary())], names=["numbers"])

    return docs.select(text_col).mapInArrow(run, "numbers binary")


def stretches(parts: Iterator[np.ndarray], n: int, turn: int) -> Iterator[np.ndarray]:
    """Rows of the positions whose turn it is, STRETCH or somewhat more at a time."""
    held, size = [], 0
    for part in parts:
        rows = triples(part.astype(np.int64), n)[turn::ROUNDS]
        held.append(rows)
        size += len(rows)
        if size >= STRETCH:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def summed(parts: DataFrame) -> DataFrame:
    """Sums of the pieces (float32, binary) in each piece number, a row for each number and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("piece").to_pylist(), batch.column("values").to_pylist(), strict=True):
                x = np.frombuffer(x, np.float32)
                total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["piece", "values"])

    return parts.mapInArrow(run, "piece int, values binary")


def improved(model: Model, rows: DataFrame, seed: int) -> None:
    """One round: each partition's changes, summed by Spark and added to the model."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        seen = 0

        def mine() -> Iterator[np.ndarray]:
            nonlocal seen
            for rows in stretches((np.frombuffer(x, np.uint16) for batch in batches for x in batch.column("numbers").to_pylist()), model.n, seed):
                seen += len(rows)
                yield rows

        change = model.trained(mine(), seed, RATE / (1 + seed))
        if not seen:
            return
        flat = np.concatenate([change[k].ravel() for k in model.NAMES]).astype(np.float32) * np.float32(seen)
        pieces = np.array_split(np.append(flat, np.float32(seen)), PIECES)
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([x.tobytes() for x in pieces], pa.binary())], names=["piece", "values"])

    changes = rows.mapInArrow(run, "piece int, values binary")
    # The first step leaves PIECES rows at most for each of the shuffle's tasks, the second PIECES rows in all.
    once = summed(changes.withColumn("_salt", F.spark_partition_id() % 64).repartition("piece", "_salt").drop("_salt"))
    got = {r["piece"]: np.frombuffer(r["values"], np.float32) for r in summed(once.repartition(PIECES, "piece")).collect()}
    sent.unpersist()
    if len(got) < PIECES:
        return
    flat = np.concatenate([got[k] for k in range(PIECES)])
    flat, at = flat[:-1] / flat[-1], 0
    for name in model.NAMES:
        v = model.values[name]
        model.values[name] = v + flat[at : at + v.size].reshape(v.shape)
        at += v.size


def fit(docs: DataFrame, counts: DataFrame, text_col: str = "text") -> tuple[Model, dict[bytes, int], int, int]:
    """The model, counts of frequent words, and the number of tokens and of distinct words. counts: of all training words."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.max(F.when(F.col("word") == F.lit(END), F.col("n"))).alias("end")).first()
    n, v = total["n"] or 0, total["v"]
    frequent = {bytes(r["word"]): r["n"] for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()}
    frequent[END] = total["end"] or 0
    named = sorted((w for w in frequent if w != END), key=lambda w: (-frequent[w], w))[: VOCABULARY - 1]
    model = Model({w: frequent[w] for w in [END, *named]}, n + 0.5 * (v + 1))
    if not n:
        del frequent[END]
        return model, frequent, n, v
    rows = written(positions(docs, model, text_col), "positions").coalesce(max(1, n // TASK_TOKENS))
    for k in range(ROUNDS):
        improved(model, rows, k)
    return model, frequent, n, v


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, held_out, n_tokens, n_known, train_tokens, base_score and score. learn: which rows are learned from, by the id."""
    training = docs.where(learn)
    counts = written(word_counts(training, text_col), "words")
    model, frequent, n, v = fit(training, counts, text_col)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((frequent, model))  # both bounded by parameters
    log_all, log_other = float(np.log10(n + 0.5 * (v + 1))), float(np.log10(model.other_mass))
    of_id = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, model = sent.value
        # Numbers of words: the model's own, n for those that are joined to their counts, and from n + 2 other frequent ones.
        ids = model.ids | {w: model.n + 2 + k for k, w in enumerate(w for w in frequent if w not in model.ids)}
        counts = np.zeros(model.n + 2 + len(ids) - len(model.ids), np.int64)
        counts[list(ids.values())] = [frequent.get(w, 0) for w in ids]
        log_count = np.log10(counts + 0.5)
        log_count[model.n] = 0
        log_share = log_count - log_other  # of other words, in their class
        log_share[: model.n] = 0
        for batch in blocks(batches, text_col):
            texts = [words_of(t) for t in raw_texts(batch, text_col)]
            starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
            flat = model.flat(texts, ids)
            modelled = model.log10(triples(np.where(flat > model.n + 1, model.n, flat), model.n))
            flat = flat[flat != model.n + 1]
            each = lambda values: np.add.reduceat(values, starts[:-1])  # noqa: B023, E731
            at = np.flatnonzero(flat == model.n)
            cuts, words = np.searchsorted(at, starts).tolist(), [*chain.from_iterable(texts)]
            left = [Counter([words[i] for i in at[a:b].tolist()]) for a, b in zip(cuts, cuts[1:], strict=False)]
            rare = pa.StructArray.from_arrays([pa.array([*chain.from_iterable(left)], pa.binary()), pa.array([*chain.from_iterable(x.values() for x in left)], pa.int64())], names=["word", "times"])
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in left]))), pa.int32()), rare)
            n_tokens = np.diff(starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), batch.column("_held"), pa.array(n_tokens), pa.array(each((counts[flat] > 0).astype(np.int64))), pa.array(each(log_count[flat]) - n_tokens * log_all), pa.array(each(modelled + log_share[flat])), rare],
                names=[id_col, "held_out", "n_tokens", "known", "base", "model", "rare"],
            )

    part = docs.select(id_col, text_col, (~learn).alias("_held")).mapInArrow(run, f"`{id_col}` {of_id}, held_out boolean, n_tokens long, known long, base double, model double, rare array<struct<word:binary,times:long>>")
    part = written(part.withColumn("_row", F.monotonically_increasing_id()), "partial-scores")
    found = part.select("_row", F.inline("rare")).join(counts, "word", "left").groupBy("_row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    return part.drop("rare").join(found, "_row", "left").select(
        id_col, "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score")
    )
