"""Masked pseudo-likelihood: a network sees the words on both sides of a masked word and predicts it.

A token is a word: one of the most frequent, or a bucket of the rarer ones. The network embeds the tokens of a window,
puts them through one hidden layer, and gives the probability of the token's class and of the token in its class (a
softmax in two steps, over all tokens). A rare word's probability is its bucket's times its share of the bucket, from
a table of all words' counts that is joined by the word and grows with the corpus. Training goes over every
document: each task walks through its own with a copy of the network, and the copies are averaged row by row, each
with the weight of what it has seen. A document's score is the sum over its tokens of the log-probability given both
sides.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.llm.common import stored

#: The most frequent words that are tokens of their own, buckets for all others (a power of two), classes of tokens.
VOCABULARY = 4096
BUCKETS = 512
CLASSES = 64
#: Tokens on each side, numbers that embed a token, hidden units.
SIDE = 2
WIDTH = 24
HIDDEN = 32
#: One token in so many is masked and predicted in training, in every document; scoring predicts each.
MASKED = 4
#: Targets of a step, its rate, tokens that a task holds before it trains on them, and tokens that are scored at once.
STEP = 2048
RATE = 0.5
CHUNK = 1 << 16
BATCH = 1 << 13
#: Distinct words that a task holds before it passes their counts on.
HELD = 300_000
#: Count of a word that the corpus of the model does not have.
UNSEEN = 0.5


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hash(word: bytes) -> int:
    """A word's key: Spark's xxhash64 with the sign set, so that it is no token's number."""
    from xxhash import xxh64_intdigest

    return (xxh64_intdigest(word, 42) | 1 << 63) - (1 << 64)


def word_key(word: str) -> Column:
    return F.xxhash64(word).bitwiseOR(F.lit(-(1 << 63)))


class Known(dict):
    """Words to tokens; of words without one the hash, remembered for as many as a task may hold."""

    def __missing__(self, word: bytes) -> int:
        key = word_hash(word)
        if len(self) < 2 * HELD:
            self[word] = key
        return key


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), n: over all texts."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for x in b.column(0):
                counts.update(words(x.as_py()))
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Tokens:
    """Words to tokens, which are numbered class by class; behind them the edge of a text."""

    known: Known
    of_bucket: np.ndarray  # the token of each bucket
    starts: np.ndarray  # the first token of each class, and their number
    counts: np.ndarray  # of each token
    bucket_mass: np.ndarray

    @property
    def edge(self) -> int:
        return int(self.starts[-1])

    def __call__(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens, and the hashes of the rare words among them in their order."""
        out = np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))
        rare = out < 0
        hashes = out[rare]
        out[rare] = self.of_bucket[hashes & len(self.of_bucket) - 1]
        return out, hashes


def tokens_from(frequent: list[tuple[bytes, int]], buckets: np.ndarray, classes: int) -> Tokens:
    """Classes hold tokens of like frequency, and about equal parts of the sum of the roots of their counts."""
    counts = np.concatenate([np.array([n for _, n in frequent], float), buckets])
    order = np.argsort(-counts, kind="stable")
    mass = np.sqrt(counts[order] + 1)
    of = np.minimum(((np.cumsum(mass) - mass) / mass.sum() * classes).astype(np.int64), classes - 1)
    starts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(order))
    token = np.empty(len(order), np.int64)
    token[order] = np.arange(len(order))
    n = len(frequent)
    return Tokens(Known({w: int(token[i]) for i, (w, _) in enumerate(frequent)}), token[n:], starts, counts[order] + 0.5, np.maximum(buckets, UNSEEN))


@dataclass
class Network:
    """Rows of numbers: an embedding a token and for the edge, what a token's logit in its class is made of, the rest."""

    embed: np.ndarray  # (tokens + 1, WIDTH)
    word: np.ndarray  # (tokens, HIDDEN + 1), the last a bias
    inner: np.ndarray  # (2 * SIDE * WIDTH + 1, HIDDEN), the last a bias
    kind: np.ndarray  # (classes, HIDDEN + 1), the last a bias

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.word, self.inner, self.kind]

    def copy(self) -> Network:
        return Network(*(a.copy() for a in self.arrays()))


def begun(tokens: Tokens, seed: int = 7) -> Network:
    """A network that predicts by frequency alone."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 0.1, s)
    k, classes = tokens.edge, len(tokens.starts) - 1
    mass = np.add.reduceat(tokens.counts, tokens.starts[:-1])
    share = np.log(tokens.counts / np.repeat(mass, np.diff(tokens.starts)))
    inner = np.concatenate([rng.normal(0, (2 * SIDE * WIDTH) ** -0.5, (2 * SIDE * WIDTH, HIDDEN)), np.zeros((1, HIDDEN))])
    own = [rng.normal(0, 1.0, (k + 1, WIDTH)), np.column_stack([draw(k, HIDDEN), share]), inner, np.column_stack([draw(classes, HIDDEN), np.log(mass / mass.sum())])]
    return Network(*(a.astype(np.float32) for a in own))


def windows(t: np.ndarray, edge: int) -> np.ndarray:
    """Tokens before and behind each place of t, which begins and ends with SIDE edges: a row a place between those."""
    n = len(t) - 2 * SIDE
    return np.stack([t[k : k + n] for k in range(2 * SIDE + 1) if k != SIDE], 1)


def _flat(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return at + np.arange(0, x.size, x.shape[1])


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of the places ``at`` of each row of logits; x becomes exponentials, whose sums come second."""
    x -= x.max(1, keepdims=True)
    own = x.ravel().take(_flat(x, at))
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    return own - np.log(total), total


def _miss(x: np.ndarray, total: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probabilities less 1 at the target, from what _softmax leaves."""
    x *= (1 / total)[:, None]
    x.ravel()[_flat(x, at)] -= 1
    return x


def predicted(net: Network, starts: np.ndarray, around: np.ndarray, target: np.ndarray, rates: list[np.ndarray] | None = None) -> np.ndarray:
    """Log-probabilities of targets given their windows; with ``rates`` (sums of squared gradients) also one step of
    training, whose rates fall with those sums."""
    n = len(target)
    of = np.searchsorted(starts, target, side="right") - 1
    order = np.argsort(of, kind="stable")  # class by class
    around, target, of = around[order], target[order], of[order]
    seen = net.embed[around].reshape(n, -1)
    hidden = seen @ net.inner[:-1]
    hidden += net.inner[-1]
    np.tanh(hidden, out=hidden)
    kinds = hidden @ net.kind[:, :-1].T
    kinds += net.kind[:, -1]
    logs, total = _softmax(kinds, of)
    if rates is not None:
        back = _miss(kinds, total, of) @ net.kind[:, :-1]
        _moved(net.kind, rates[3], kinds, hidden)
    edges = np.append(np.flatnonzero(np.diff(of, prepend=-1)), n).tolist()
    for a, b in zip(edges, edges[1:]):
        low, high = starts[of[a]], starts[of[a] + 1]
        if high - low == 1:
            continue
        h, part, at = hidden[a:b], net.word[low:high], target[a:b] - low
        x = h @ part[:, :-1].T
        x += part[:, -1]
        own, total = _softmax(x, at)
        logs[a:b] += own
        if rates is not None:
            back[a:b] += _miss(x, total, at) @ part[:, :-1]
            _moved(part, rates[1][low:high], x, h)
    if rates is not None:
        back *= 1 - hidden**2
        to_seen = (back @ net.inner[:-1].T).reshape(-1, WIDTH)
        _moved(net.inner.T, rates[2].T, back, seen)
        flat = around.ravel()
        by = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[by], prepend=-1))
        rows = flat[by[first]]
        step = np.add.reduceat(to_seen[by], first, axis=0)
        rate = rates[0][rows] + step**2
        rates[0][rows] = rate
        net.embed[rows] -= RATE * step / np.sqrt(rate)
    out = np.empty(n, logs.dtype)
    out[order] = logs
    return out


def _moved(part: np.ndarray, rate: np.ndarray, miss: np.ndarray, given: np.ndarray) -> None:
    """One step of rows of weights, the last of each a bias, by the misses of their outputs for what was given."""
    step = np.empty(part.shape, part.dtype)
    np.matmul(miss.T, given, out=step[:, :-1])
    np.matmul(np.ones(len(miss), miss.dtype), miss, out=step[:, -1])
    rate += step * step
    step /= np.sqrt(rate)
    step *= RATE
    part -= step


def walked(texts, tokens: Tokens, net: Network, seed: int = 11) -> tuple[Network, list[np.ndarray]]:
    """A copy of the network after a walk through texts, and how often each of its rows was of use."""
    net, rng = net.copy(), np.random.default_rng(seed)
    rates = [np.full_like(a, 1.0) for a in net.arrays()]
    used = [np.zeros(len(a), np.int64) for a in net.arrays()]
    gap = np.full(SIDE, tokens.edge)
    held: list[np.ndarray] = []
    places: list[np.ndarray] = []
    size = 0

    def train():
        t = np.concatenate([*held, gap])
        around, at = windows(t, tokens.edge), rng.permutation(np.concatenate(places))
        for i in range(0, len(at), STEP):
            now = at[i : i + STEP]
            predicted(net, tokens.starts, around[now], t[now + SIDE], rates)
        used[0] += np.bincount(around[at].ravel(), minlength=len(used[0]))
        kinds = np.bincount(np.searchsorted(tokens.starts, t[at + SIDE], side="right") - 1, minlength=len(used[3]))
        used[1] += np.repeat(kinds, np.diff(tokens.starts))
        used[2] += len(at)
        used[3] += len(at)

    for text in texts:
        t, _ = tokens(words(text))
        for i in range(0, len(t), CHUNK):  # a long text is trained on in stretches
            part = t[i : i + CHUNK]
            held += [gap, part]
            places.append(size + np.arange((len(t) + i) % MASKED, len(part), MASKED))
            size += SIDE + len(part)
            if size >= CHUNK:
                train()
                held, places, size = [], [], 0
    if held:
        train()
    return net, used


def stretches(column: pa.Array):
    """Texts by lists of about a chunk of bytes, so that few are worked on at once."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py())
        size += len(held[-1] or "")
        if size >= 4 * CHUNK:
            yield held
            held, size = [], 0
    yield held


def averaged(docs: DataFrame, tokens: Tokens, net: Network) -> Network:
    """The network after all tasks' walks: each row the mean of its copies, weighted by how often they used it.

    A task sends only rows that it has used; sums are taken by row and by column, so none holds more than one row of
    each copy, and the driver gets one network.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tokens, net))  # VOCABULARY + BUCKETS rows
    width = max(a.shape[1] for a in net.arrays())
    columns = [f"v{i}" for i in range(width)]

    def run(batches):
        tokens, net = shared.value
        new, used = walked((x.as_py() for b in batches for x in b.column(0)), tokens, net)
        for kind, (a, n) in enumerate(zip(new.arrays(), used)):
            rows = np.flatnonzero(n)
            for i in range(0, len(rows), 1024):
                some = rows[i : i + 1024]
                values = np.zeros((len(some), width), np.float32)
                values[:, : a.shape[1]] = a[some]
                weights = n[some].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(weights), *(pa.array(np.ascontiguousarray(c)) for c in values.T)], ["kind", "row", "n", *columns])

    rows = docs.select("text").mapInArrow(run, "kind int, row long, n double, " + ", ".join(f"{c} float" for c in columns))
    sums = rows.groupBy("kind", "row").agg(*[(F.sum(F.col(c).cast("double") * F.col("n")) / F.sum("n")).cast("float").alias(c) for c in columns])
    found = sums.toArrow()
    out, kinds, at = net.copy(), found.column("kind").to_numpy(), found.column("row").to_numpy()
    values = np.stack([found.column(c).to_numpy() for c in columns], 1) if found.num_rows else np.empty((0, width), np.float32)
    for kind, a in enumerate(out.arrays()):
        own = kinds == kind
        a[at[own]] = values[own][:, : a.shape[1]]
    return out


@dataclass
class Model:
    tokens: Tokens
    net: Network

    def scores(self, texts: list[str | None]) -> list[tuple[int, float, np.ndarray]]:
        """Of each text the number of tokens, the sum of their log-probabilities but for rare words' counts, and those
        words' hashes."""
        gap, last = np.full(SIDE, self.tokens.edge), len(self.tokens.bucket_mass) - 1
        log_mass = np.log(self.tokens.bucket_mass)
        read = [self.tokens(words(x)) for x in texts]
        row = np.concatenate([gap, *(x for t, _ in read for x in (t, gap))])
        own = np.flatnonzero(row[SIDE : len(row) - SIDE] != self.tokens.edge)
        around, logs = windows(row, self.tokens.edge), np.empty(len(own))
        for i in range(0, len(own), BATCH):
            now = own[i : i + BATCH]
            logs[i : i + BATCH] = predicted(self.net, self.tokens.starts, around[now], row[now + SIDE])
        sums = np.concatenate(([0.0], np.cumsum(logs)))
        ends = np.cumsum([0, *(len(t) for t, _ in read)])
        return [(len(t), float(sums[b] - sums[a] - log_mass[rare & last].sum()), rare) for (t, rare), a, b in zip(read, ends, ends[1:])]

    def score(self, text: str | None) -> tuple[int, float, np.ndarray]:
        return self.scores([text])[0]


def fit(docs: DataFrame, counts: DataFrame, vocabulary: int = VOCABULARY, buckets: int = BUCKETS, classes: int = CLASSES) -> Model:
    """The model of a corpus whose words' counts (word, n) are given. The driver gets ``vocabulary`` words, a sum a
    bucket, and one network."""
    frequent = [(bytes(w), n) for w, n in counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()]
    bucket = word_key("word").bitwiseAND(F.lit(buckets - 1))
    mass = np.zeros(buckets)
    for b, n in counts.groupBy(bucket).agg(F.sum("n")).collect():
        mass[b] = n
    for w, n in frequent:
        mass[word_hash(w) & buckets - 1] -= n
    tokens = tokens_from(frequent, mass, classes)
    return Model(tokens, averaged(docs, tokens, begun(tokens)))


def reports(docs: DataFrame, model: Model | None = None, counts: DataFrame | None = None) -> DataFrame:
    """n_tokens, log_prob (their sum) and mean_log_prob of every whole text, under the model of all docs if none is given.

    model and counts (word, n) belong together; words that counts lack count as UNSEEN. Null, empty and blank texts have
    no tokens, log_prob 0 and a null mean. Long texts are scored whole, in stretches that share their edges. Repeated
    rows count and return as often as they came; an empty table gives none; columns of docs other than doc_id and text
    are not read.
    """
    counts = counts if counts is not None else stored(word_counts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, counts))
    kind = docs.select("doc_id").schema.fields[0].dataType.simpleString()

    def run(batches):
        own = shared.value
        for b in batches:
            rows = []
            for texts in stretches(b.column(1)):
                rows += own.scores(texts)
            ends = pa.array(np.cumsum([0, *(len(r[2]) for r in rows)]), pa.int32())
            hashes = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[2] for r in rows] or [np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()), hashes], ["doc_id", "n_tokens", "part", "hashes"])

    scored = stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, part double, hashes array<long>"))
    numbered = scored.withColumn("_row", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")))
    rare = numbered.select(F.xxhash64("_row.f", "_row.i").alias("_key"), F.explode("hashes").alias("_word"))
    known = counts.select(word_key("word").alias("_word"), F.log(F.col("n").cast("double")).alias("_log")).hint("shuffle_hash")  # a row a word, dealt evenly
    more = rare.join(known, "_word", "left").groupBy("_key").agg(F.sum(F.coalesce("_log", F.log(F.lit(UNSEEN)))).alias("_more"))
    rows = numbered.select("doc_id", "n_tokens", "part", F.xxhash64("_row.f", "_row.i").alias("_key")).join(more, "_key", "left")
    total = F.col("part") + F.coalesce("_more", F.lit(0.0))
    return rows.select("doc_id", "n_tokens", total.alias("log_prob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_prob"))
