"""Log-bilinear language model, trained with noise-contrastive estimation.

Words are counted over the whole corpus. The most frequent ones are classes of their own, other
frequent ones (the head, broadcast, whose size grows slowly with the corpus) form classes by rank,
all further and unknown words are one class, the tail. Two nets make the probability of a head word:

* ``Bilinear`` predicts the class from the two classes before it: a bilinear score of a
  position-weighted sum of context vectors with the target vector, plus a bias.
* ``Members`` predicts the word within its class from the word before it: every head word has a
  target vector, the ``WORD_CONTEXTS`` most frequent words have context vectors of their own, other
  words that of their class. A word's weight is its share of the class's counts times the
  exponential of the bilinear score.

Every task runs noise-contrastive estimation of both in numpy over all training texts it holds, and
parameters are averaged, in a few rounds over disjoint slices of the corpus; a word's vectors are
averaged over the tasks that met it, by how often they did. So scores depend a little on how the
input is split. For scoring, batched matrix products over all contexts give log-probabilities that
are normalised over the classes, and over the words of each class; in the tail a word's share comes
from the counts, with absolute discounting that leaves a part for unknown words. Tail counts are
joined, never broadcast.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import id_and_text, id_bucket, schema_of, stored, text_slices, words

HEAD = 200_000
HEAD_TOKENS = 20_000_000
OWN = 200
WORD_CONTEXTS = 2048
PER_OCTAVE = 4
WORD_BYTES = 64
DIM = 16
NOISE = 64
BATCH = 4096
RATE = 0.08
WORD_RATE = 0.3
WORD_PRIOR = 1.0
WORD_BATCH = 8192
WORD_BLOCK = 4096
SCORE_BYTES = 2 << 20
SLICES = 8
ROUNDS = ((0, 1), (1, 4), (4, 8))
END = b" "  # no word holds a blank
KEYS_IN_TASK = 600_000


def _count(batches):
    """(token, c) of a task's texts, given out whenever many different words are held."""
    held: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "c"])
        held.clear()
        return out

    for _, texts in text_slices(batches):
        for t in texts:
            held.update(words(t))
        held[END] += len(texts)
        if len(held) > KEYS_IN_TASK:
            yield flush()
    yield flush()


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c): occurrences of every word, and of the end, over all rows (doc_id, text)."""
    return docs.mapInArrow(_count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def head_size(total: int) -> int:
    """Words of the head: ``HEAD``, and from ``HEAD_TOKENS`` tokens on the sixth root of the growth more."""
    return int(HEAD * max(1.0, total / HEAD_TOKENS) ** (1 / 6))


class Vocabulary:
    """The head: for each word its place; for each place class, count and log10 share of its class."""

    def __init__(self, tokens: list[bytes], counts: list[int], total: int, types: int, ones: int, twos: int):
        order = sorted(range(len(tokens)), key=lambda i: (-counts[i], tokens[i]))
        if END in tokens:  # the end is a class of its own at any count
            order.remove(at := tokens.index(END))
            order.insert(0, at)
        self.tokens = [tokens[i] for i in order]
        self.counts = np.array([counts[i] for i in order], np.int64)
        rank = np.arange(len(order))
        bins = np.floor(PER_OCTAVE * np.log2(np.maximum(rank, OWN) / OWN)).astype(np.int64)
        self.classes = np.where(rank < OWN, rank, OWN + bins)
        _, self.classes = np.unique(self.classes, return_inverse=True)
        self.n = int(self.classes.max()) + 2 if len(order) else 1
        self.tail = self.n - 1
        mass = np.bincount(self.classes, self.counts, self.n) if len(order) else np.zeros(1)
        self.share = np.log10(self.counts / mass[self.classes]) if len(order) else np.zeros(0)
        self.total, self.types = total, types
        mass[self.tail] = total - self.counts.sum()
        self.mass = mass
        self.tail_types = types - len(order)
        self.discount = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1

    def places(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.tokens)}


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by row number."""
    flat = (rows[:, None] * DIM + np.arange(DIM)).ravel()
    return np.bincount(flat, values.ravel(), n * DIM).reshape(n, DIM).astype(np.float32)


class Bilinear:
    """Parameters: context vectors (one more class: before the text), target vectors, position weights, biases."""

    def __init__(self, n: int, mass: np.ndarray):
        rng = np.random.default_rng(7)
        self.r = rng.normal(0, 0.3, (n + 1, DIM))
        self.q = rng.normal(0, 0.05, (n, DIM))
        self.w = np.stack([np.ones(DIM), np.full(DIM, 0.5)])
        self.noise = (mass + 0.5) / (mass + 0.5).sum()
        self.b = np.log(self.noise)
        for name in ("r", "q", "w", "b"):
            setattr(self, name, getattr(self, name).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.w, self.b)]).astype(np.float64)

    def load(self, flat: np.ndarray) -> Bilinear:
        at = 0
        for name in ("r", "q", "w", "b"):
            x = getattr(self, name)
            setattr(self, name, flat[at:at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return self

    def train(self, near: np.ndarray, far: np.ndarray, target: np.ndarray, rng, square: dict) -> None:
        """One pass of noise-contrastive estimation with AdaGrad over (two context classes, class)."""
        log_noise = np.log(NOISE * self.noise).astype(np.float32)
        cumulative = np.cumsum(self.noise)
        for at in range(0, len(target), BATCH):
            h1, h2, t = near[at:at + BATCH], far[at:at + BATCH], target[at:at + BATCH]
            z = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), len(self.b) - 1)
            a, c = self.r[h1], self.r[h2]
            p = a * self.w[0] + c * self.w[1]
            qt, qz = self.q[t], self.q[z]
            gt = 1 / (1 + np.exp(np.clip((p * qt).sum(1) + self.b[t] - log_noise[t], -30, 30)))
            gz = -1 / (1 + np.exp(-np.clip(p @ qz.T + self.b[z] - log_noise[z], -30, 30)))
            dp = gt[:, None] * qt + gz @ qz
            grads = {k: np.zeros_like(getattr(self, k)) for k in ("r", "q", "w", "b")}
            grads["r"] += _scatter(h1, dp * self.w[0], len(self.r)) + _scatter(h2, dp * self.w[1], len(self.r))
            grads["q"] += _scatter(t, gt[:, None] * p, len(self.q)) + _scatter(z, gz.T @ p, len(self.q))
            grads["w"][:] = (dp * a).sum(0), (dp * c).sum(0)
            grads["b"] += np.bincount(t, gt, len(self.b)) + np.bincount(z, gz.sum(0), len(self.b))
            for k, g in grads.items():
                g /= np.float32(len(t))
                square[k] = square.get(k, np.float32(1e-8)) + g * g
                setattr(self, k, getattr(self, k) + np.float32(RATE) * g / np.sqrt(square[k]))

    def table(self) -> np.ndarray:
        """log10 probability of each class after each pair of context classes (far * (n + 1) + near), normalised."""
        rows = np.empty((len(self.r), len(self.r), len(self.b)), np.float32)
        for i, far in enumerate(self.r):
            s = ((self.r * self.w[0] + far * self.w[1]) @ self.q.T + self.b).astype(np.float64)
            s -= s.max(1, keepdims=True)
            rows[i] = (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)
        return rows.reshape(-1, len(self.b))


class Members:
    """Words within their classes: target vectors of all head words, then context vectors, in one matrix.

    Contexts are the ``own`` first words of the head, then the classes, the tail and the place before a text.
    """

    def __init__(self, classes: np.ndarray, share: np.ndarray, n_classes: int, own: int):
        self.words, self.own = len(classes), min(own, len(classes))
        self.contexts = self.own + n_classes + 1
        self.first = np.searchsorted(classes, np.arange(n_classes + 1))  # classes are runs of ranks
        self.classes, self.share = classes, 10.0 ** share
        self.weights = np.zeros((self.words + self.contexts, DIM), np.float32)
        self.weights[self.words:] = np.random.default_rng(5).normal(0, 0.3, (self.contexts, DIM))

    def shared(self) -> np.ndarray:
        """Classes of more than one word."""
        return np.flatnonzero(np.diff(self.first) > 1)

    def context(self, place: np.ndarray, cls: np.ndarray, lengths: np.ndarray, before: int) -> np.ndarray:
        """For each token the context that the token before it makes."""
        made = np.where((place >= 0) & (place < self.own), place, self.own + cls)
        made = np.r_[self.own + before, made[:-1]]
        made[np.cumsum(lengths) - lengths] = self.own + before
        return made

    def inside(self, place: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Numbers of the tokens that share their class with other words."""
        return np.flatnonzero((place >= 0) & (np.diff(self.first) > 1)[cls])

    def train(self, context: np.ndarray, place: np.ndarray, cls: np.ndarray, rng, square: np.ndarray) -> None:
        """One pass of noise-contrastive estimation, class by class, with noise from the class's shares."""
        chosen = self.inside(place, cls)
        chosen = chosen[np.argsort(cls[chosen], kind="stable")]
        cuts = np.searchsorted(cls[chosen], self.shared())
        log_noise = np.float32(np.log(NOISE))
        for k, a, b in zip(self.shared().tolist(), cuts, [*cuts[1:], len(chosen)], strict=True):
            first, last = self.first[k], self.first[k + 1]
            cumulative = np.cumsum(self.share[first:last]) if b > a else None
            for at in range(a, b, WORD_BATCH):
                part = chosen[at:min(at + WORD_BATCH, b)]
                h, t = context[part] + self.words, place[part]
                z = first + np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), last - first - 1)
                p, ut, uz = self.weights[h], self.weights[t], self.weights[z]
                gt = 1 / (1 + np.exp(np.clip((p * ut).sum(1) - log_noise, -30, 30)))
                gz = -1 / (1 + np.exp(-np.clip(p @ uz.T - log_noise, -30, 30)))
                self._step(np.r_[t, z], np.concatenate([gt[:, None] * p, gz.T @ p]), square)
                self._step(h, gt[:, None] * ut + gz @ uz, square)

    def _step(self, rows: np.ndarray, values: np.ndarray, square: np.ndarray) -> None:
        """AdaGrad with one scale per row; the prior keeps rows with little evidence near their start."""
        rows, at = np.unique(rows, return_inverse=True)
        g = _scatter(at, values, len(rows))
        square[rows] += (g * g).mean(1)
        self.weights[rows] += np.float32(WORD_RATE) * g / np.sqrt(np.float32(WORD_PRIOR) + square[rows])[:, None]

    def normalisers(self, contexts: np.ndarray) -> np.ndarray:
        """log10 of the sum over each class's words, for each of ``contexts``; 0 for classes of one word."""
        out = np.zeros((len(contexts), len(self.first) - 1), np.float32)
        p = self.weights[self.words + contexts]
        for k in self.shared():
            first, last = self.first[k], self.first[k + 1]
            s = p @ self.weights[first:last].T
            top = s.max(1, keepdims=True)
            out[:, k] = (np.log(np.exp(s - top) @ self.share[first:last]) + top[:, 0]) / np.log(10)
        return out

    def scores(self, context: np.ndarray, place: np.ndarray, cls: np.ndarray, normalisers: np.ndarray) -> np.ndarray:
        """log10 of what the context makes of each token's share of its class; 0 for words alone in theirs."""
        out = np.zeros(len(place))
        chosen = self.inside(place, cls)
        for at in range(0, len(chosen), WORD_BATCH):
            part = chosen[at:at + WORD_BATCH]
            s = (self.weights[self.words + context[part]] * self.weights[place[part]]).sum(1, dtype=np.float64)
            out[part] = s / np.log(10) - normalisers[context[part], cls[part]]
        return out


def _averaged(parts: DataFrame) -> DataFrame:
    """(block, rows, vectors): averages, by weight, of the vectors that tasks give for some rows of a block.

    A block has a row from each task, so groups of about the root of the number of tasks are summed
    first, then the sums of the groups. Partitions are set by the number of blocks: merged ones would
    make large batches.
    """
    def summed(last: bool):
        def close(name, sums):
            rows = np.flatnonzero(sums[:, DIM])
            mean, weight = (sums[rows, :DIM] / sums[rows, DIM:]).astype(np.float32), sums[rows, DIM]
            return pa.RecordBatch.from_pydict({
                "block": pa.array([name[0]], pa.int32()), "part": pa.array([name[1]], pa.int32()),
                **{c: pa.array([x.tobytes()], t) for (c, t), x in zip(_BLOCK[2:], (rows.astype(np.int16), weight, mean), strict=True)}})

        def task(batches):
            name, sums = None, None  # rows come sorted: one block is held at a time
            for batch in batches:
                for i in range(batch.num_rows):  # buffers of the batch, not copies
                    block, part = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    rows, weights, vectors = (batch.column(j)[i].as_buffer() for j in (2, 3, 4))
                    here = block, 0 if last else part
                    if here != name:
                        if name:
                            yield close(name, sums)
                        name, sums = here, np.zeros((WORD_BLOCK, DIM + 1))
                    at, weight = np.frombuffer(rows, np.int16), np.frombuffer(weights, np.float64)[:, None]
                    given = np.frombuffer(vectors, np.float32 if last else np.float16).reshape(-1, DIM)
                    sums[at] += np.concatenate([given * weight, weight], axis=1)
            if name:
                yield close(name, sums)
        return task

    schema = "block int, part int, rows binary, weights binary, vectors binary"
    tasks, blocks = parts.agg(F.count_distinct("part"), F.count_distinct("block")).first()
    groups, blocks = max(1, int(tasks ** 0.5)), max(1, blocks)
    near = parts.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int"))
    near = near.repartition(blocks * max(1, groups // 8), "block", "part").sortWithinPartitions("block", "part").mapInArrow(summed(False), schema)
    return near.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(summed(True), schema)


def _classes(texts: list, places: dict, classes: np.ndarray, tail: int):
    """Flat places (-1: tail) and classes of all tokens and ends, number of tokens per text, words."""
    split = [[*words(t), END] for t in texts]
    flat = list(chain.from_iterable(split))
    place = np.fromiter(map(places.get, flat, repeat(-1)), np.int64, len(flat))
    if len(classes):
        cls = np.where(place < 0, tail, classes[place])
    else:
        cls = np.full(len(flat), tail)
    return place, cls, np.array([len(s) for s in split]), flat


def _context(cls: np.ndarray, lengths: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum(lengths) - lengths
    near = np.r_[before, cls[:-1]]
    far = np.r_[before, before, cls[:-2]][:len(cls)]
    near[starts] = before
    far[starts] = before
    far[starts[lengths > 1] + 1] = before
    return near, far


_HELD: dict = {}


def _held(shared, make):
    """One value per broadcast and process, kept while it is in use."""
    key = shared.value["run"]
    if _HELD.get("key") != key:
        _HELD.clear()
        _HELD.update(key=key, made=make(shared.value))
    return _HELD["made"]


_BLOCK = (("block", pa.int32()), ("part", pa.int32()), ("rows", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary()))


class LanguageModel:
    """A trained model: its vocabulary, both nets, the normalisers of the second and the stored table of counts."""

    def __init__(self, vocabulary: Vocabulary, net: Bilinear, members: Members, normalisers: np.ndarray, counts: DataFrame):
        self.vocabulary, self.net, self.members, self.normalisers, self.counts = vocabulary, net, members, normalisers, counts


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int | None = None) -> LanguageModel:
    """A model of all rows of ``docs``; a null text counts as empty. ``head``: ``head_size`` of the tokens."""
    rows = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    counts = stored(token_counts(rows), "token-counts")
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = (counts.where((F.col("c") >= 2) & (F.length("token") <= WORD_BYTES) | (F.col("token") == END))
           .orderBy(F.desc(F.col("token") == END), F.desc("c"), "token").limit(head or head_size(total)))
    top = top.toArrow()  # at most ``head`` words of at most WORD_BYTES bytes
    tokens, numbers = top.column("token").to_pylist(), top.column("c").to_pylist()
    ones, twos = counts.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    vocabulary = Vocabulary(tokens, numbers, total, types, ones, twos)
    net = Bilinear(vocabulary.n, vocabulary.mass)
    members = Members(vocabulary.classes, vocabulary.share, vocabulary.n, WORD_CONTEXTS)
    own_contexts = members.own
    run = hashlib.md5(repr((total, types, vocabulary.counts.sum())).encode())
    run.update(b"\0".join(vocabulary.tokens))
    places = spark.sparkContext.broadcast({"run": run.hexdigest(), "tokens": vocabulary.tokens, "classes": vocabulary.classes, "share": vocabulary.share})
    tail = vocabulary.tail
    for first, last in ROUNDS:
        start, mass = net.flat(), vocabulary.mass
        begun = spark.sparkContext.broadcast(members.weights)

        def task(batches, start=start, mass=mass, begun=begun):
            known = _held(places, lambda v: {t: i for i, t in enumerate(v["tokens"])})
            own, rng, square, seen = Bilinear(tail + 1, mass).load(start), np.random.default_rng(11), {}, 0
            inner = Members(places.value["classes"], places.value["share"], tail + 1, own_contexts)
            inner.weights[:] = begun.value
            squares, met = np.zeros(len(inner.weights), np.float32), np.zeros(len(inner.weights), np.int64)
            for _, texts in text_slices(batches, SCORE_BYTES):
                place, cls, lengths, _ = _classes(texts, known, places.value["classes"], tail)
                near, far = _context(cls, lengths, tail + 1)
                own.train(near, far, cls, rng, square)
                context = inner.context(place, cls, lengths, tail + 1)
                inner.train(context, place, cls, rng, squares)
                chosen = inner.inside(place, cls)
                met += np.bincount(np.r_[place[chosen], context[chosen] + inner.words], minlength=len(met))
                seen += len(cls)
            if seen:
                flat = own.flat()
                yield pa.RecordBatch.from_pydict({
                    "i": pa.array(np.arange(len(flat), dtype=np.int32)), "v": flat * seen, "w": np.full(len(flat), float(seen)),
                    **{c: pa.nulls(len(flat), t) for c, t in _BLOCK}})
            for block in range(0, len(met), WORD_BLOCK):
                here = np.flatnonzero(met[block:block + WORD_BLOCK])
                if len(here):
                    packed = [here.astype(np.int16), met[block + here].astype(np.float64), inner.weights[block + here].astype(np.float16)]
                    yield pa.RecordBatch.from_pydict({
                        "i": pa.nulls(1, pa.int32()), "v": pa.nulls(1, pa.float64()), "w": pa.nulls(1, pa.float64()),
                        "block": pa.array([block // WORD_BLOCK], pa.int32()), "part": pa.array([TaskContext.get().partitionId()], pa.int32()),
                        **{c: pa.array([x.tobytes()], t) for (c, t), x in zip(_BLOCK[2:], packed, strict=True)}})

        part = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).between(first, last - 1))
        trained = stored(part.mapInArrow(task, "i int, v double, w double, block int, part int, rows binary, weights binary, vectors binary"), "net-parts")
        mixed = trained.where("i IS NOT NULL").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v")).collect()
        if mixed:
            flat = np.empty(len(start))
            for r in mixed:
                flat[r["i"]] = r["v"]
            net.load(flat)
        for r in _averaged(trained.where("block IS NOT NULL").select(*[c for c, _ in _BLOCK])).collect():  # one matrix
            at = r["block"] * WORD_BLOCK + np.frombuffer(r["rows"], np.int16).astype(np.int64)
            members.weights[at] = np.frombuffer(r["vectors"], np.float32).reshape(-1, DIM)
        begun.unpersist()
    begun = spark.sparkContext.broadcast(members.weights)

    def sums(batches):
        inner = Members(places.value["classes"], places.value["share"], tail + 1, own_contexts)
        inner.weights[:] = begun.value
        for batch in batches:
            for i in batch.column(0).to_numpy():
                yield pa.RecordBatch.from_pydict({"id": [i], "sums": [inner.normalisers(np.array([i])).tobytes()]})

    normalisers = np.zeros((members.contexts, vocabulary.n), np.float32)
    for r in spark.range(0, members.contexts, 1, 16).mapInArrow(sums, "id long, sums binary").collect():  # contexts x classes
        normalisers[r["id"]] = np.frombuffer(r["sums"], np.float32)
    begun.unpersist()
    places.unpersist()
    return LanguageModel(vocabulary, net, members, normalisers, counts)


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Null counts as empty: one token, the end. Rows that agree in id and text get the same numbers.
    Tail words of a text are joined with the stored counts; a word that the training texts lack
    scores as the one unknown word.
    """
    v, net = model.vocabulary, model.net
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast({
        "run": hashlib.md5(net.flat().tobytes() + model.members.weights.tobytes()).hexdigest(), "tokens": v.tokens, "counts": v.counts, "share": v.share, "classes": v.classes,
        "n": v.n, "own": model.members.own, "net": (net.r, net.q, net.w, net.b), "members": model.members.weights, "normalisers": model.normalisers})
    denominator = v.total + 0.5 * (v.types + 1)

    def prepare(x):
        net = Bilinear.__new__(Bilinear)
        net.r, net.q, net.w, net.b = x["net"]
        inner = Members(x["classes"], x["share"], x["n"], x["own"])
        inner.weights = x["members"]
        return {t: i for i, t in enumerate(x["tokens"])}, net.table(), inner

    def task(batches):
        places, table, inner = _held(sent, prepare)
        x = sent.value
        before, tail = x["n"], x["n"] - 1
        base_of = np.r_[np.log10((x["counts"] + 0.5) / denominator), 0.0]
        share_of = np.r_[x["share"], 0.0]
        for ids, texts in text_slices(batches, SCORE_BYTES):
            place, cls, lengths, flat = _classes(texts, places, x["classes"], tail)
            near, far = _context(cls, lengths, before)
            starts = np.cumsum(lengths) - lengths
            neural = table[far * (before + 1) + near, cls].astype(np.float64) + share_of[place]
            neural += inner.scores(inner.context(place, cls, lengths, before), place, cls, x["normalisers"])
            sums = [np.add.reduceat(y, starts) for y in (base_of[place], neural, (place >= 0).astype(np.int64))]
            keys = [int.from_bytes(hashlib.md5(t or b"").digest()[:8], "little", signed=True) for t in texts]
            names = ids.to_pylist()
            outside = np.flatnonzero(place < 0)
            owner = np.repeat(np.arange(len(texts)), lengths)[outside]
            rest = Counter(zip(owner.tolist(), (flat[i] for i in outside.tolist()), strict=True))
            who = [d for d, _ in rest]
            m, k = len(texts), len(rest)
            zero = np.zeros(k)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([ids, ids.take(pa.array(who, pa.int64()))]),
                pa.array(keys + [keys[d] for d in who], pa.int64()),
                pa.array([b" %s %d" % (str(n).encode(), key) for n, key in zip(names, keys, strict=True)] + [t for _, t in rest], pa.binary()),
                pa.array([0] * m + list(rest.values()), pa.int64()),
                pa.array([1] * m + [0] * k, pa.int64()),
                pa.array(np.r_[lengths, zero.astype(np.int64)]), pa.array(np.r_[sums[2], zero.astype(np.int64)]),
                pa.array(np.r_[sums[0], zero]), pa.array(np.r_[sums[1], zero]),
            ], names=["doc_id", "key", "token", "n", "rows", "n_tokens", "n_known", "base", "score"])

    parts = id_and_text(docs, id_col, text_col).mapInArrow(
        task, schema_of(docs, "key long, token binary, n long, rows long, n_tokens long, n_known long, base double, score double", id_col))
    tail_mass = max(float(v.mass[v.tail]), 1.0)
    unknown = max(v.discount * max(v.tail_types, 1) / tail_mass, 1e-12) if v.mass[v.tail] > 0 else 1.0
    c = F.coalesce("c", F.lit(0))
    in_tail = F.when(c > 0, (c - v.discount) / tail_mass).otherwise(min(unknown, 1.0))
    joined = parts.join(model.counts, "token", "left").select(
        "doc_id", "key", "rows", "n_tokens", (F.col("n_known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.col("n") * F.log10((c + 0.5) / denominator)).alias("base"),
        (F.col("score") + F.col("n") * F.log10(in_tail)).alias("score"))
    sums = joined.groupBy("doc_id", "key").agg(
        F.sum("rows").alias("rows"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    return sums.select(
        "doc_id", *[(F.col(x) / F.col("rows")).cast("long").alias(x) for x in ("n_tokens", "n_known")],
        F.lit(v.total).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"),
        (F.col("score") / F.col("rows")).alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy")).drop("copy")


def held_out(id_col):
    """Whether a row is kept out of training: the crc32 of its id as text leaves 1 by 5."""
    return id_bucket(id_col, 5) == 1
