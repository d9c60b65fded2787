"""Suffix-array dedup: bytes in strings of a given length that also start elsewhere.

Where a string of ``length`` bytes starts, the least hash among its 32-byte pieces names it: equal strings have the
same least piece at the same place. Neighbouring starts with the same piece are one run, whose context (all bytes of
its strings) is hashed too. So counts of (piece, context) settle most runs without their bytes: a piece that occurs
once has no equal string; one with a single context that repeats is a copy throughout. Only pieces with several
contexts need bytes, one copy of each context. A suffix array over those orders all their strings; strings that agree
in ``length`` bytes are neighbours there, and the previous and next smaller positions among neighbours say where one
starts earlier (longest previous factor); a string has another equal one if it has an earlier one or is one.

Contexts count as equal if a polynomial over 2^64 and another modulo a prime agree, mixed into 64 bits, and their
pieces' hashes too: 128 bits of two kinds, of which the second has no weak texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.common import place_of, shielded, stored
from spanledger.llm.simhash import mix

LENGTH = 200
PIECE = 32
#: Starts that are worked on at once, and bytes of contexts in one suffix array.
CHUNK = 1 << 20
BLOCK = 1 << 20
#: Contexts of one piece that share a suffix array; pieces with more go string by string through a grouped count.
MOST_CONTEXTS = 1024
#: Starts that are one row of such a count, and of the counts within it; each divides the one before.
STRIDES = (32, 8, 2, 1)
_PLACE = np.uint64((1 << 21) - 1)
_TABLE = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
#: A Mersenne prime and a base for the second polynomial; products of two residues fit in 64 bits.
_PRIME = (1 << 31) - 1
_PRIME_BASE = 1_220_703_125


def _powers(base: int, n: int, modulus: int = 1 << 64) -> np.ndarray:
    out = np.ones(n, np.uint64)
    step, k = base % modulus, 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(step)
        if modulus < 1 << 64:
            out[k : 2 * k] %= np.uint64(modulus)
        step, k = step * step % modulus, 2 * k
    return out


_POWERS: list[np.ndarray] = []


class Prefix:
    """Sums of two polynomials over the bytes before each place; differences times inverse powers are hashes of stretches."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        if not _POWERS or len(_POWERS[0]) < n + 1:
            _POWERS[:] = [_powers(b, n + CHUNK, m) for b, m in ((_BASE, 1 << 64), (pow(_BASE, -1, 1 << 64), 1 << 64), (_PRIME_BASE, _PRIME), (pow(_PRIME_BASE, -1, _PRIME), _PRIME))]
        self.sums, self.second = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * _POWERS[0][:n], out=self.sums[1:])
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[2][:n], out=self.second[1:])  # under 2^39 a byte

    def pieces(self) -> np.ndarray:
        """The hash of the piece at each place."""
        n = len(self.sums) - PIECE
        return mix((self.sums[PIECE:] - self.sums[:-PIECE]) * _POWERS[1][: max(n, 0)], 0)

    def stretches(self, i: np.ndarray, j: np.ndarray, salt: int) -> np.ndarray:
        """Hashes of the bytes from places i up to j, and of how many those are."""
        one = (self.sums[j] - self.sums[i]) * _POWERS[1][i]
        two = (self.second[j] - self.second[i]) % np.uint64(_PRIME) * _POWERS[3][i] % np.uint64(_PRIME)
        return mix(mix(one + (j - i).astype(np.uint64), salt) ^ two, salt)


def runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For texts that end at ``ends`` in data: text, first and last start, piece and context of every run of starts."""
    empty = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.int64),) * 2
    n = len(data) - length + 1
    if n <= 0:
        return empty
    prefix = Prefix(data)
    pieces = prefix.pieces()
    span = length - PIECE + 1
    least = (pieces & ~_PLACE) | np.arange(len(pieces), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n], least[span - width : span - width + n])
    at = (least & _PLACE).astype(np.int64)
    begins = np.concatenate(([0], ends[:-1]))
    text = np.searchsorted(ends, np.arange(n), side="right")
    valid = np.arange(n) + length <= ends[np.minimum(text, len(ends) - 1)]
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    low = np.flatnonzero(new & valid)
    if not len(low):
        return empty
    cuts = np.flatnonzero(new | ~valid)
    after = np.searchsorted(cuts, low, side="right")
    high = np.where(after < len(cuts), cuts[np.minimum(after, len(cuts) - 1)], n) - 1
    context = prefix.stretches(low, high + length, 1)
    owner = text[low]
    return owner, low - begins[owner], high - begins[owner], pieces[at[low]].view(np.int64), context.view(np.int64)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    return np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.empty(0, np.uint8), offsets


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of a row: hashes of its text and of its id. Rows that agree in both count as repeats."""
    return docs.withColumn("_k1", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_k2", F.xxhash64("doc_id")).withColumn("_id", place_of(F.col("doc_id"), docs))


def all_runs(docs: DataFrame, length: int) -> DataFrame:
    """Runs of all texts: _k1, _k2, _id of the row, lo, hi, piece, context."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, offsets = _buffers(b.column(3))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
                found = []
                if offsets[j] - offsets[i] <= CHUNK + length:
                    found.append((0, runs(data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i], length)))
                else:  # one long text, by stretches of starts
                    for at in range(int(offsets[i]), int(offsets[j]) - length + 1, CHUNK):
                        part = data[at : min(at + CHUNK + length - 1, int(offsets[j]))]
                        found.append((at - int(offsets[i]), runs(part, np.array([len(part)]), length)))
                for shift, (owner, low, high, piece, context) in found:
                    if len(owner):
                        yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(i + owner)) for k in range(3)), pa.array(low + shift), pa.array(high + shift), pa.array(piece), pa.array(context)], ["_k1", "_k2", "_id", "lo", "hi", "piece", "context"])
                i = j

    rows = docs.where(F.octet_length("text") >= length).select("_k1", "_k2", "_id", "text")
    return rows.mapInArrow(run, f"_k1 long, _k2 long, _id {kind}, lo long, hi long, piece long, context long")


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """starts in the order of their strings of ``length`` bytes, and whether each agrees with the one before in all.

    Ranks of 8 bytes are doubled to those of 16, 32 and so on; two that overlap give the rank of ``length`` bytes.
    """
    rank = np.zeros(len(data) + 8, np.uint64)
    rank[: len(data)] = data
    for width in (1, 2, 4):
        rank[: len(data)] = (rank[: len(data)] << np.uint64(8 * width)) | rank[width : len(data) + width]
    _, rank = np.unique(rank[: len(data)], return_inverse=True)
    width = 8
    while 2 * width <= length:
        pair = rank[: len(rank) - width].astype(np.uint64) << np.uint64(32) | rank[width:].astype(np.uint64)
        _, rank = np.unique(pair, return_inverse=True)
        width *= 2
    pair = rank[starts].astype(np.uint64) << np.uint64(32) | rank[starts + length - width].astype(np.uint64)
    order = np.argsort(pair, kind="stable")
    same = np.zeros(len(starts), bool)
    same[1:] = pair[order][1:] == pair[order][:-1]
    return order, same


def previous_factors(order: np.ndarray, same: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string whether an equal one has a smaller place, and whether there is any other equal one.

    Within a stretch of equal strings in suffix order, the least place before and after one is a previous or next
    smaller position; the longest previous factor reaches the length exactly if either is smaller than its own. Each
    string that has none is found by those that come later: it is the smaller position that they agree with.
    """
    if not len(place):
        return np.empty(0, bool), np.empty(0, bool)
    group = np.cumsum(~same) - 1
    rank = np.empty(len(place), np.int64)
    rank[np.argsort(place, kind="stable")] = np.arange(len(place))
    own = rank[order]
    big = len(place) + 1
    before = np.minimum.accumulate(own - group * big) + group * big
    back = group[-1] - group[::-1]
    after = (np.minimum.accumulate(own[::-1] - back * big) + back * big)[::-1]
    found = np.minimum(before, after)
    smaller = found < own
    source = np.zeros(len(place), bool)
    source[found[smaller]] = True  # by rank
    earlier, other = np.empty(len(place), bool), np.empty(len(place), bool)
    earlier[order], other[order] = smaller, smaller | source[own]
    return earlier, other


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the stretches of true flags."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


RANGES = "array<struct<lo:long,hi:long>>"


def compared(contexts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """For contexts (piece, context, _id, lo, n, bytes) the ranges of starts that go, in the context's first copy.

    Contexts of a piece are dealt to one task and share a suffix array, which holds BLOCK bytes and at least a piece.
    """

    def block(rows):
        data = np.concatenate([np.frombuffer(r[5], np.uint8) for r in rows])
        sizes = np.array([len(r[5]) for r in rows])
        first = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        owner = np.repeat(np.arange(len(rows)), counts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        order, same = suffix_order(data, first[owner] + offset, length)
        # the order of places: id, then position, for context copies that come first
        low = np.array([r[3] for r in rows])
        ids = np.unique([r[2] for r in rows], return_inverse=True)[1]
        by = np.lexsort((offset + low[owner], ids[owner]))
        place = np.empty(len(owner), np.int64)
        place[by] = np.arange(len(owner))
        earlier, other = previous_factors(order, same, place)
        gone = earlier if keep_first else other | (np.array([r[4] for r in rows]) > 1)[owner]
        edges = np.cumsum(counts) - counts
        for k, r in enumerate(rows):
            a, b = spans(gone[edges[k] : edges[k] + counts[k]])
            if len(a):
                yield r[0], r[1], [{"lo": int(x) + r[3], "hi": int(y) + r[3]} for x, y in zip(a, b)]

    def packed(found):
        piece, context, ranges = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(context, pa.int64()), pa.array(ranges, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["piece", "context", "ranges"])

    def run(batches):
        held: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if size >= BLOCK and r[0] != held[-1][0]:
                    if found := list(block(held)):
                        yield packed(found)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held and (found := list(block(held))):
            yield packed(found)

    rows = contexts.select("piece", "context", "_id", "lo", "n", "bytes").repartition("piece").sortWithinPartitions("piece")
    return rows.mapInArrow(run, f"piece long, context long, ranges {RANGES}")


def _parts(depth: int) -> str:
    inner = f", parts:{_parts(depth - 1)}" if depth else ""
    return f"array<struct<lo:bigint, hi:bigint, name:bigint, same:bigint{inner}>>"


def _arrow(depth: int) -> pa.DataType:
    fields = [(n, pa.int64()) for n in ("lo", "hi", "name", "same")]
    return pa.list_(pa.struct(fields + ([("parts", _arrow(depth - 1))] if depth else [])))


def split_context(data: np.ndarray, piece: int, low: int, length: int) -> list[dict]:
    """Blocks of a context's starts, counted from the piece: the widest of STRIDES, each with its parts, and so on.

    All bytes that the strings of a whole block would share name it, so equal strings lie in blocks of equal names;
    two blocks of one name whose strings are the same in all bytes agree in ``same`` too.
    """
    prefix = Prefix(data)
    k = len(data) - length + 1
    at = int(np.argmax(prefix.pieces().view(np.int64) == piece))
    below: list[dict] = []
    starts: list[int] = []
    for width in reversed(STRIDES):
        blocks = (at - np.arange(k)) // width
        edges = np.flatnonzero(np.diff(blocks, prepend=blocks[0] + 1))
        last = np.append(edges[1:], k) - 1
        begin = at - width * blocks[edges]
        name = (prefix.stretches(begin, begin + length - width + 1, 2) + blocks[edges].astype(np.uint64)).view(np.int64).tolist()
        same = prefix.stretches(edges, last + length, 2).view(np.int64).tolist()
        rows = [{"lo": low + x, "hi": low + y, "name": n, "same": m} for x, y, n, m in zip(edges.tolist(), last.tolist(), name, same)]
        if below:
            cuts = np.searchsorted(starts, edges.tolist() + [k]).tolist()
            for row, x, y in zip(rows, cuts, cuts[1:]):
                row["parts"] = below[x:y]
        below, starts = rows, edges.tolist()
    return below


def counted(contexts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """What ``compared`` returns, by grouped counts: for pieces with too many contexts for one task.

    Blocks whose name occurs once are done, and so are names whose blocks agree in all bytes; the parts of the others
    are counted in turn, down to single strings. Counts are summed before the exchange, so no group is large.
    """
    fields = f"piece long, context long, _id {contexts.schema['_id'].dataType.simpleString()}, n long, parts {_parts(len(STRIDES) - 1)}"

    def run(batches):
        for b in batches:
            piece, low, raw = (b.column(c).to_pylist() for c in ("piece", "lo", "bytes"))
            parts = [split_context(np.frombuffer(r, np.uint8), p, at, length) for r, p, at in zip(raw, piece, low)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("piece", "context", "_id", "n")), pa.array(parts, _arrow(len(STRIDES) - 1))], ["piece", "context", "_id", "n", "parts"])

    rows = contexts.mapInArrow(run, fields)
    out = None
    for depth, _ in enumerate(STRIDES):
        rows = stored(rows.select("piece", "context", "_id", "n", F.explode("parts").alias("_p")).select("piece", "context", "_id", "n", "_p.*"))
        names = rows.groupBy("piece", "name").agg(F.sum("n").alias("_total"), F.min("same").alias("_a"), F.max("same").alias("_b"), F.min(F.struct("_id", "lo")).alias("_first")).where("_total > 1")
        rows = stored(rows.join(stored(names), ["piece", "name"]))
        first = (F.col("_first")["_id"] == F.col("_id")) & (F.col("_first")["lo"] == F.col("lo"))
        done = rows.where("_a = _b").where(~first if keep_first else F.lit(True)).select("piece", "context", "lo", "hi")
        out = done if out is None else out.union(done)
        if depth + 1 < len(STRIDES):
            rows = rows.where("_a <> _b").select("piece", "context", "_id", "n", "parts")
    return out.groupBy("piece", "context").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def with_bytes(contexts: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """contexts (piece, context, n, _k1, _k2, _id, lo, hi) with the bytes of each: all strings that start from lo to hi.

    Rows of docs that repeat bring their contexts again; one of each is left.
    """
    lists = contexts.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("piece", "context", "_id", "lo", "hi", "n")).alias("_runs"))
    texts = docs.select("_k1", "_k2", F.col("text").cast("binary").alias("_bytes"))
    each = texts.join(lists, ["_k1", "_k2"]).select("_bytes", F.explode("_runs").alias("r"))
    parts = each.select("r.piece", "r.context", "r._id", "r.lo", "r.n", F.substring(F.col("_bytes"), (F.col("r.lo") + 1).cast("int"), (F.col("r.hi") - F.col("r.lo") + length).cast("int")).alias("bytes"))
    return parts.groupBy("piece", "context").agg(*[F.first(c).alias(c) for c in ("_id", "lo", "n", "bytes")])


def marked(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """docs (keyed) with _ranges: stretches of starts of strings that go; null where there are none.

    keep_first: a string goes if an equal one starts earlier, in a row with a smaller doc_id or before it in its text.
    Else it goes if an equal one starts anywhere else. Null text counts as empty; null doc_id comes last; rows that
    repeat another wholly share one place, so with keep_first none of them loses bytes to the other. Long texts are
    worked on by stretches of starts and lose nothing by it; an empty table gives none.
    """
    found = stored(all_runs(docs, length))
    shared = found.groupBy("piece").agg(F.count("*").alias("_n"), F.min("context").alias("_a"), F.max("context").alias("_b")).where("_n > 1")
    shared = stored(shared.select("piece", (F.col("_a") == F.col("_b")).alias("solid")))  # stored, so that the join can split a frequent piece
    shared = stored(found.join(shared, "piece"))
    place = F.struct("_id", "lo", "_k1", "_k2", "hi")
    contexts = stored(shared.groupBy("piece", "context").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.first("solid").alias("solid")))
    mixed = contexts.where("not solid").select("piece", "context", "n", "first.*")
    many = mixed.groupBy("piece").agg(F.count("*").alias("_n")).where(F.col("_n") > MOST_CONTEXTS).select("piece", F.lit(True).alias("_many"))
    mixed = stored(with_bytes(mixed, docs, length).join(many, "piece", "left"))
    ranges = compared(mixed.where("_many is null"), length, keep_first).union(counted(mixed.where("_many"), length, keep_first))
    verdicts = stored(contexts.join(ranges, ["piece", "context"], "left").select("piece", "context", "n", "solid", "first", "ranges"))
    whole = F.array(F.struct("lo", "hi"))
    first = (F.col("first")["_id"] == F.col("_id")) & (F.col("first")["lo"] == F.col("lo")) & (F.col("first")["_k1"] == F.col("_k1")) & (F.col("first")["_k2"] == F.col("_k2"))
    own = F.when(~first, whole).when(F.col("solid"), F.lit(None) if keep_first else whole).otherwise(F.col("ranges"))
    gone = shared.drop("solid").join(verdicts, ["piece", "context"]).select("_k1", "_k2", own.alias("_own")).where("_own is not null")
    lists = gone.groupBy("_k1", "_k2").agg(F.flatten(F.collect_set("_own")).alias("_ranges"))  # a set: repeated rows bring equal ranges
    return docs.join(lists, ["_k1", "_k2"], "left")


def cut(text: bytes, ranges, length: int) -> tuple[bytes, int, int]:
    """What is left of a text, how many bytes went, and in how many maximal stretches."""
    if not ranges:
        return text, 0, 0
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, [r["lo"] for r in ranges], 1)
    np.add.at(edge, [r["hi"] + length for r in ranges], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), len(spans(gone)[0])


def reports(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """How many bytes of every text lie in strings that start elsewhere too, and the hash of the rest; see marked."""
    rows = marked(keyed(docs.select("doc_id", "text")), length).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "_ranges")
    kind = docs.select("doc_id").schema.fields[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = [(len(t), gone, n, hashlib.sha256(rest).hexdigest()) for t, r in zip(b.column(1), b.column(2)) for t in (t.as_py(),) for rest, gone, n in (cut(t, r.as_py(), length),)]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()]))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs without later copies of strings of ``length`` bytes: the first copy stays. n_chars, if there, follows the text.

    A character that a cut divides goes wholly, and so do texts of which nothing is left. Columns of docs may have any
    names; see marked.
    """
    docs, named = shielded(docs, "doc_id", "text", "n_chars")
    rows = marked(keyed(docs), length, keep_first=True)
    names = docs.columns
    rows = rows.select(*[F.col("text").cast("binary").alias("text") if c == "text" else F.col(c) for c in names], "_ranges")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for b in batches:
            texts = [None if t is None else cut(t, r, length)[0].decode("utf-8", "ignore") if r else t.decode("utf-8", "replace") for t, r in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist())]
            columns = b.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            if count is not None:
                changed = [r is not None for r in b.column(len(names)).to_pylist()]
                columns[count] = pa.array([len(t) if c else n for t, c, n in zip(texts, changed, columns[count].to_pylist())], columns[count].type)
            kept = pa.array([t != "" or r is None for t, r in zip(texts, b.column(len(names)).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names).filter(kept)

    return named(rows.mapInArrow(run, fields))
