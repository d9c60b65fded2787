"""Packing by cutting-stock column generation.

Texts become ids, documents longer than a sequence are cut at its length, and what is left is counted by length. A
linear program over patterns (how many pieces of each length class fill a sequence) is solved by column generation:
a knapsack by dynamic programming prices new patterns against the duals until none improves the bound by more than a
tolerance. Patterns are rounded down, the remainder goes first-fit decreasing, and every piece finds its place by its
rank in its class. The driver sees a count for each class alone.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm.common import stored

LENGTH = 2048
#: Tokens by which lengths are rounded up to classes.
GRAIN = 16
#: Part of the number of sequences by which the program may miss its lower bound, and rounds at most.
GAP = 1e-3
ROUNDS = 4000
END = 1
#: Words whose ids a worker remembers, and characters of the longest of them; others are encoded each time.
REMEMBERED = 400_000
LONGEST = 48
# The tokenizer's pattern, and its white space (Unicode White_Space).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACES = "\t-\r \x85\xa0  -     　"


class Ids(dict):
    """Little-endian ids of texts under a byte-level BPE whose words end before white space.

    A word with the space before it is encoded for itself, so its ids are remembered: this dict, from words to bytes.
    Texts with the string of a special token go to the tokenizer whole. New words go through the same vocabulary in a
    faster library; that both agree is checked on a few words at the start.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = self.whole.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.words = re.compile(f" ?[^{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
        # Byte-level vocabularies spell bytes as characters: printable ones as themselves, others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelled = {chr(c): c for c in plain} | {chr(256 + n): c for n, c in enumerate(c for c in range(256) if c not in plain)}
        ranks = {bytes(spelled[x] for x in word): i for word, i in self.whole.get_vocab().items() if i not in added}
        self.encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for word in (" The", "it's", " \u00e9t\u00e9,", "\n\n", " 12.5%", "\u65e5\u672c", " supercalifragilistic"):
            if self[word] != self.encode(word):
                raise ValueError(f"{path} is not a byte-level BPE of this pattern")

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encoding.encode_ordinary(word), "<u4").tobytes()
        if len(word) <= LONGEST:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.encode(text)
        return b"".join(map(self.__getitem__, self.words.findall(text)))


def pieces(docs: DataFrame, path: str, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, its class, and its rank in task and class."""
    kind = docs.select("doc_id").schema.fields[0].dataType.simpleString()
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        task, ids, ranks = TaskContext.get().partitionId(), Ids(path), {}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                own, texts = b.column(0).slice(at, 256), [x or "" for x in b.column(1).slice(at, 256).to_pylist()]
                rows = []
                for k, text in enumerate(texts):
                    raw = ids(text) + end
                    n = len(raw) // 4
                    for start in range(0, n, length):
                        size = min(length, n - start)
                        kind_ = -(-size // grain)
                        rank = ranks.get(kind_, 0)
                        ranks[kind_] = rank + 1
                        rows.append((k, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n, kind_, rank))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([own.take(pa.array(columns[0])), *(pa.array(c, pa.int64()) for c in columns[1:]), pa.array([task] * len(rows), pa.int64())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_class", "_rank", "_task"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, _class long, _rank long, _task long")


def knapsack(values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: how often each class (weight 1, 2, ...) goes into ``room``, repeats allowed."""
    best, choice = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        k = min(c, len(values))
        got = best[c - 1 :: -1][:k] + values[:k] if k < c else best[:c][::-1][:k] + values[:k]
        w = int(np.argmax(got))
        if got[w] > best[c - 1]:
            best[c], choice[c] = got[w], w + 1
        else:
            best[c], choice[c] = best[c - 1], 0
    pattern, c = np.zeros(len(values), np.int64), room
    while c > 0:
        if choice[c]:
            pattern[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return best[room], pattern


def patterns(demand: np.ndarray, gap: float = GAP) -> list[tuple[int, np.ndarray]]:
    """How often to use which pattern so that demand (by class: weight 1 to the room) is met exactly.

    Revised simplex with the inverse of the basis; the start fills sequences with one class each. Prices over
    the knapsack's value are feasible duals and bound the optimum from below, which ends the rounds.
    """
    room = len(demand)
    need = np.flatnonzero(demand)
    if not len(need):
        return []
    m = len(need)
    columns = np.diag(room // (need + 1)).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    amount = demand[need] / np.diag(columns)
    bound = float(demand @ (np.arange(room) + 1)) / room
    for _ in range(ROUNDS):
        if amount.sum() <= bound * (1 + gap):
            break
        duals = np.clip(inverse.sum(0), 0, None)
        values = np.zeros(room)
        values[need] = duals
        worth, pattern = knapsack(values, room)
        bound = max(bound, float(demand[need] @ duals) / max(worth, 1e-12))
        if worth <= 1 + 1e-9:
            break
        enter = pattern[need].astype(float)
        direction = inverse @ enter
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, amount / np.where(up, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        step = max(0.0, ratio[out])
        amount -= step * direction
        amount[out] = step
        amount = np.clip(amount, 0, None)
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        columns[:, out] = enter
    left = demand.astype(np.int64).copy()
    used = []
    for k in np.argsort(-amount):
        whole = np.zeros(room, np.int64)
        whole[need] = columns[:, k].round().astype(np.int64)
        some = np.flatnonzero(whole)
        times = int(min(np.floor(amount[k] + 1e-6), (left[some] // whole[some]).min())) if len(some) else 0
        if times > 0:
            used.append((times, whole))
            left -= times * whole
    return used + remainder(left)


def remainder(left: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """First-fit decreasing over what is left by class; equal fillings are used as often as the counts allow."""
    room, used, left = len(left), [], left.copy()
    while left.any():
        pattern, free = np.zeros(room, np.int64), room
        for w in np.flatnonzero(left)[::-1] + 1:
            k = min(free // w, left[w - 1])
            pattern[w - 1], free = k, free - k * w
        some = np.flatnonzero(pattern)
        times = max(1, int((left[some] // pattern[some]).min()))
        used.append((times, pattern))
        left -= times * pattern
    return used


def places(used: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, rank behind the last, first sequence, pieces of the class in each) of every pattern."""
    rows, sequence = [], 0
    reached = np.zeros(len(used[0][1]) if used else 0, np.int64)
    for times, pattern in used:
        for k in np.flatnonzero(pattern):
            rows.append((int(k) + 1, int(reached[k]), int(reached[k] + times * pattern[k]), sequence, int(pattern[k])))
            reached[k] += times * pattern[k]
        sequence += times
    return rows


def packed(docs: DataFrame, path: str, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    Null text counts as empty, and every document has its closing id, so it has a piece. Repeated rows are documents of
    their own; an empty table gives none; columns of docs other than doc_id and text are not read. Equal input in
    equal partitions gives equal results.
    """
    spark = docs.sparkSession
    rows = stored(pieces(docs, path, length, grain))
    counts = stored(rows.groupBy("_class", "_task").agg(F.count("*").alias("_n")))
    demand = np.zeros(length // grain, np.int64)
    for k, n in counts.groupBy("_class").agg(F.sum("_n")).collect():  # a row for each class
        demand[k - 1] = n
    slots = spark.createDataFrame(places(patterns(demand)), "_class long, _from long, _to long, _sequence long, _each long")
    before = Window.partitionBy("_class").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_class", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = rows.join(base, ["_class", "_task"]).withColumn("_rank", F.col("_base") + F.col("_rank"))
    # The patterns are at most twice as many as classes, so their places are at most 2 * classes * pieces in one.
    placed = ranked.join(F.broadcast(slots), "_class").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    within = F.col("_rank") - F.col("_from")
    placed = placed.withColumn("sequence_id", F.col("_sequence") + F.floor(within / F.col("_each")).cast("long"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
