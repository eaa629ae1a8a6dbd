"""Language-model scoring by a hierarchical Pitman-Yor model.

Every word is a context, a restaurant whose customers are the words that follow it (the start of a
text is a context too); dishes are words. All contexts share one parent, the restaurant of words
without context, whose base is uniform over the vocabulary and one unknown word. A table opened in
a context sends a customer to the parent.

Seating is sampled by Gibbs sweeps. In a sweep all customers of a dish in a restaurant leave and are
seated again, one after the other: with j customers at t tables of the dish, the next one joins
them with weight j - d * t, or opens a table with weight (theta + d * tables of the restaurant) *
parent's probability of the dish, from which the dish's own customers are taken out. The new
seating is accepted with the probability that a Metropolis-Hastings step on the posterior asks for
(`seated`; the first sweep always), otherwise the old one stays. Between two openings the weights don't change, so the next opening is drawn at once
from the product of the joining probabilities: a dish costs as many steps as it has tables,
however many customers it has. The totals of other restaurants are those that the sweep before
left. Random numbers are hashes of word, context, sweep and step, so a task that runs again draws
the same. Predictive probabilities are averaged over the sweeps after the burn-in.

Where the work lies. Pairs of word and context are dealt into a grid of buckets by ranges of both
hashes, so neither a popular word nor a popular context fills one bucket. In a sweep a bucket
tells the words' buckets how many tables it has of each word, as a dish and as a context, and is told the
totals; only three totals of a sweep pass through the driver. Pairs seen once always have one table and
take no part. For scoring, texts are cut into pieces of bounded size; a piece asks each bucket for its
distinct pairs and words, and is told counts and tables. Rows hold packed arrays. What is shuffled
follows the input; nothing that grows with it is broadcast or sent to the driver.

Defined results: null and empty texts are one end token; with nothing to learn from, base and
model are uniform over one unknown word; ids may be null or repeated, each row is judged
alone; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm.shared import discard, fold, pieces, read_table, small_batches, stored
from undertone.llm.words import BASE, U64, mix, words_of

DISCOUNT, STRENGTH = 0.75, 2.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.7, 100.0
BURN_IN, SAMPLES = 2, 2
END, START = (int(x) for x in mix(np.array([0xE0D, 0x57A], U64)))
#: Bytes of text for each bucket, about, and bytes of text whose requests to a bucket make one group.
BUCKET_BYTES, SALT_BYTES = 1 << 22, 1 << 36
#: Bytes of text in a piece, at most; the larger, the fewer rows go to each bucket, and the fewer pairs are asked for twice.
PIECE = 4_000_000


def pack(x: np.ndarray, kind) -> bytes:
    """Numbers by significance of their bytes, those that are zero in all left out; signed ones count up from 0 with alternating signs."""
    x = np.ascontiguousarray(x, kind)
    if x.dtype.kind == "i":
        x = (x << 1) ^ (x >> (8 * x.itemsize - 1))
    x = x.view(f"u{x.itemsize}")
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    return bytes([width]) + len(x).to_bytes(8, "little") + x.view(np.uint8).reshape(len(x), x.itemsize)[:, :width].T.tobytes()


def unpack(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    if not data:
        return np.zeros(0, kind)
    width, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((n, kind.itemsize), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(width, n).T
    out = out.view(f"u{kind.itemsize}").ravel()
    return ((out >> 1) ^ (0 - (out & 1))).view(kind) if kind.kind == "i" else out


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=U64(0)), U64)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, U64), dtype=U64)


def _each(batches):
    """Rows one by one, so that only one row's bytes are copied at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema.types, strict=True)], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in text.split(", "))])


# ---------------------------------------------------------------- seating


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series from 8 on."""
    shift = np.zeros(len(x))
    small = np.flatnonzero(x < 8)
    low = x[small]
    product = np.ones(len(small))
    for k in range(8):
        product *= low + k
    shift[small] = np.log(product)
    y = x.copy()
    y[small] += 8
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def _salted(key: np.ndarray, salt: int) -> np.ndarray:
    return mix(key * U64(BASE) + U64(salt))


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((key >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


@dataclass
class Seating:
    """Of each dish the number of tables, and the customers (from 0) who opened those after the first."""

    tables: np.ndarray
    opened: np.ndarray

    @classmethod
    def least(cls, n: int) -> Seating:
        return cls(np.ones(n, np.int64), np.zeros(0, np.int64))

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.tables)), self.tables - 1)

    def take(self, on: np.ndarray) -> Seating:
        """Some of the dishes, by a mask."""
        return Seating(self.tables[on], self.opened[on[self.owner]])

    def cut(self, customers: np.ndarray) -> Seating:
        """Without the customers from these numbers on."""
        owner = self.owner
        keep = self.opened < customers[owner]
        return Seating(1 + np.bincount(owner[keep], minlength=len(self.tables)), self.opened[keep])


def all_join(low: np.ndarray, m: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The probability that m customers (1 at least) in a row join, the first with weight `low`, against a new table's weight: a product, or
    what gamma functions make of it."""
    out = low / (low + new)
    at = np.flatnonzero(m > 1)
    for k in range(1, 4):
        out[at] *= (low[at] + k) / (low[at] + k + new[at])
        at = at[m[at] > k + 1]
    if len(at):
        low, m, new = low[at], m[at], new[at]
        out[at] = np.exp(log_gamma(low + m) - log_gamma(low + m + new) - log_gamma(low) + log_gamma(low + new))
    return out


def _one_joins(low: float, m: int, new: float) -> float:
    if m <= 4:
        out = 1.0
        for k in range(m):
            out *= (low + k) / (low + k + new)
        return out
    return math.exp(math.lgamma(low + m) - math.lgamma(low + m + new) - math.lgamma(low) + math.lgamma(low + new))


def _seat_one(j: int, n: int, t: int, weight: float, slope: float, discount: float, key: int, step: int) -> list[int]:
    """The openings of one dish from a step on: what `seat` does, without arrays, for the few dishes with many tables."""
    opened, draws = [], ()
    while j < n:
        if not len(draws):
            draws = _uniform(mix(U64(key * BASE & 2**64 - 1) + np.arange(step, step + 256, dtype=U64))).tolist()[::-1]
        u, a, low, step = draws.pop(), weight + slope * t, j - discount * t, step + 1
        least, most = 1, n - j
        if _one_joins(low, most, a) > u:
            break
        guess = int(min(most, low * math.expm1(min(40.0, -math.log(u) / a))))  # what it would be if gamma functions were powers
        width = 2
        while least < most:  # closes in on the guess from both sides, then halves what is left
            m = guess + width if guess + width < most else guess - width
            m = m if least <= m < most else (least + most) // 2
            if _one_joins(low, m, a) <= u:
                most = m
            else:
                least = m + 1
            width *= 2
        opened.append(j + least - 1)
        j, t = j + least, t + 1
    return opened


#: With fewer dishes than this at a step, each is seated by itself; the draws are the same.
FEW = 400


def seat(start: Seating, at: np.ndarray, customers: np.ndarray, weight: np.ndarray, slope: np.ndarray, discount: float, key: np.ndarray) -> Seating:
    """Seats further customers, from number `at` (1 at least) up to `customers`. A new table has weight + slope * tables of the dish."""
    left = np.flatnonzero(at < customers)
    j, n, t = at[left].astype(float), customers[left].astype(float), start.tables[left].astype(float)
    owners, opened = [start.owner], [start.opened]
    step = 0
    while len(left) and len(left) >= FEW:
        a = weight[left] + slope[left] * t
        low = j - discount * t
        draw = _uniform(_salted(key[left], step))
        on = np.flatnonzero(all_join(low, n - j, a) <= draw)
        left, j, n, t, low, a, draw = (x[on] for x in (left, j, n, t, low, a, draw))
        least, most = np.ones(len(left)), n - j  # the opening customer is the least m at which the product falls to the draw
        guess = np.minimum(most, np.floor(low * np.expm1(np.minimum(40.0, -np.log(draw) / a))))  # if gamma functions were powers
        width, search = 2.0, np.flatnonzero(least < most)
        while len(search):  # closes in on the guess from both sides, then halves what is left
            lo, hi, near = least[search], most[search], guess[search]
            m = np.where(near + width < hi, near + width, near - width)
            m = np.where((m >= lo) & (m < hi), m, np.floor((lo + hi) / 2))
            found = all_join(low[search], m, a[search]) <= draw[search]
            most[search[found]], least[search[~found]] = m[found], m[~found] + 1
            search, width = search[least[search] < most[search]], 2 * width
        owners.append(left)
        opened.append((j + least - 1).astype(np.int64))
        j, t = j + least, t + 1
        on = np.flatnonzero(j < n)
        left, j, n, t = (x[on] for x in (left, j, n, t))
        step += 1
    for i, *at_step in zip(left.tolist(), j.astype(np.int64).tolist(), n.astype(np.int64).tolist(), t.astype(np.int64).tolist(), strict=True):
        found = _seat_one(*at_step, float(weight[i]), float(slope[i]), discount, int(key[i]), step)
        owners.append(np.full(len(found), i))
        opened.append(np.array(found, np.int64))
    owner, opened = np.concatenate(owners), np.concatenate(opened)
    order = np.argsort(owner, kind="stable")
    return Seating(1 + np.bincount(owner, minlength=len(customers)), opened[order])


def log_importance(s: Seating, customers: np.ndarray, weight: np.ndarray, slope: np.ndarray, discount: float) -> np.ndarray:
    """Log of the posterior weight of a seating over the probability with which `seat` draws it: the sum over its
    customers of the log of all weights that were open to them."""
    n = len(customers)
    owner = np.concatenate([np.arange(n), s.owner])
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    begin = np.concatenate([np.ones(n, np.int64), s.opened + 1])[order]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    end = np.append(begin[1:], 0)
    end[np.append(first[1:], len(owner))[: len(first)] - 1] = customers
    t = np.arange(len(owner)) - np.repeat(first, s.tables) + 1
    on = np.flatnonzero(begin < end)
    shift = weight[owner[on]] + (slope[owner[on]] - discount) * t[on]
    return np.bincount(owner[on], log_gamma(end[on] + shift) - log_gamma(begin[on] + shift), n)


def seated(old: Seating, customers: np.ndarray, weight: np.ndarray, slope: np.ndarray, discount: float, key: np.ndarray, first: bool = False) -> Seating:
    """One sweep over dishes: all customers leave and sit down again; the new seating stays with the probability that keeps
    the posterior as it is, else the old one. first: there is no old one worth keeping."""
    n = len(customers)
    new = seat(Seating.least(n), np.ones(n, np.int64), customers, weight, slope, discount, key)
    if first:
        return new
    several = (new.tables > 1) | (old.tables > 1)  # where both have one table, both are the same
    gain = np.zeros(n)
    rest = customers[several], weight[several], slope[several], discount
    gain[several] = log_importance(new.take(several), *rest) - log_importance(old.take(several), *rest)
    take = np.log(_uniform(_salted(key, 1 << 40))) < gain
    keep_old, keep_new = ~take[old.owner], take[new.owner]
    owner, opened = np.concatenate([old.owner[keep_old], new.owner[keep_new]]), np.concatenate([old.opened[keep_old], new.opened[keep_new]])
    return Seating(np.where(take, new.tables, old.tables), opened[np.argsort(owner, kind="stable")])


# ---------------------------------------------------------------- texts


@dataclass
class Grid:
    """Buckets of pairs (by ranges of the word's and the context's hash, half of the bits each) and of words; salts split what is
    asked of a bucket. Words have the two-thirds power of the number of buckets, as vocabularies grow slower than texts, so that
    a bucket of pairs meets few buckets of words: rows told in a sweep grow as the input to the power 7/6."""

    bits: int
    salts: int = 1

    @property
    def word_bits(self) -> int:
        return -(-2 * self.bits // 3)

    def salt(self, piece: int) -> int:
        return (piece >> 32) % self.salts

    def pairs(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        by_context = self.bits // 2
        own = (word >> U64(64 - (self.bits - by_context))).astype(np.int64)
        return own << by_context | ((context >> U64(64 - by_context)).astype(np.int64) if by_context else 0)

    def words(self, word: np.ndarray) -> np.ndarray:
        return (word >> U64(64 - self.word_bits)).astype(np.int64)


def pair_key(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """64 bits that stand for a pair within its bucket, which holds some 500,000: another pair of the bucket answers for one that
    isn't known with a probability of 3e-14."""
    return mix(context * U64(BASE) + word)


def by_bucket(bucket: np.ndarray) -> np.ndarray:
    """A stable order by bucket; 16 bits are sorted by radix."""
    return np.argsort(bucket.astype(np.uint16 if bucket.max(initial=0) < 1 << 16 else np.int32), kind="stable")


@dataclass
class Piece:
    """Tokens of several texts. vocabulary: sorted hashes; word, context: their places for each distinct pair; token:
    the pair of each token; first: where each text's tokens begin."""

    first: np.ndarray
    vocabulary: np.ndarray
    word: np.ndarray
    context: np.ndarray
    token: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Piece:
        h, first = [np.zeros(0, U64)], [0]
        for part in pieces([pa.RecordBatch.from_arrays([column], ["t"])], "t"):  # hashing takes several times the bytes
            words = words_of(part.column("t"))
            texts = np.arange(len(words.first) - 1)
            own = np.empty(len(words.row) + len(texts), U64)
            own[np.arange(len(words.row)) + words.row] = words.hashes()
            own[words.first[1:] + texts] = END
            first += (first[-1] + words.first[1:] + texts + 1).tolist()
            h.append(own)
        h, first = np.concatenate(h), np.array(first)
        codes, vocabulary = pd.factorize(np.append(h, U64(START)))
        order = np.argsort(vocabulary)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        vocabulary, at = vocabulary[order], rank[codes]
        start, at = at[-1], at[:-1]
        context = np.empty(len(at), np.int64)
        context[1:] = at[:-1]
        context[first[:-1]] = start
        pair, token = np.unique(at * len(vocabulary) + context, return_inverse=True)
        return cls(first, vocabulary, pair // len(vocabulary), pair % len(vocabulary), token)

    def seen(self, train: np.ndarray) -> np.ndarray:
        """How often each pair occurs in the texts that are learnt from."""
        return np.bincount(self.token, np.repeat(train, np.diff(self.first)), len(self.word)).astype(np.int64)

    def asked(self, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of pairs by bucket and key, and both in that order."""
        word, context = self.vocabulary[self.word], self.vocabulary[self.context]
        key = pair_key(word, context)
        bucket, order = grid.pairs(word, context), np.argsort(key)
        order = order[by_bucket(bucket[order])]
        return order, bucket[order], key[order]


def _cut(docs: DataFrame, schema: str, emit, columns=("t",)) -> DataFrame:
    """Rows of emit(piece number, batch, Piece) for each piece of the texts."""

    def run(batches):
        k = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, "t", PIECE):
            yield from emit(k, batch, Piece.of(batch.column("t"))).to_batches()
            k += 1

    return docs.select(*columns).mapInArrow(run, schema)


def _ranges(bucket: np.ndarray):
    """(bucket, from, to) of each run."""
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    return zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True) if len(at) else ()


#: Pairs of a bucket, packed. Those that a piece tells have their contexts one by one; merged ones have sorted contexts and each pair's place among them.
PAIRS = "bucket int, salt int, word binary, per_word binary, context binary, place binary, n binary"


def _told_pairs(bucket: int, salt: int, word: np.ndarray, context: np.ndarray, n: np.ndarray) -> tuple:
    """A row of pairs sorted by word."""
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
    return bucket, salt, pack_sorted(word[first]), pack(np.diff(np.append(first, len(word))), np.int32), pack(context, U64), None, pack(n, np.int64)


def _read_told(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    context = unpack(r["context"], U64) if r["place"] is None else unpack_sorted(r["context"])[unpack(r["place"], np.int32)]
    return np.repeat(unpack_sorted(r["word"]), unpack(r["per_word"], np.int32)), context, unpack(r["n"], np.int64)


@dataclass
class Pairs:
    """Pairs sorted by word: sorted words and how many pairs each has; sorted contexts and each pair's place among them; how often."""

    words: np.ndarray
    per_word: np.ndarray
    contexts: np.ndarray
    place: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, word: np.ndarray, context: np.ndarray, n: np.ndarray) -> Pairs:
        first = np.flatnonzero(np.diff(word, prepend=~word[:1]))
        return cls(word[first], np.diff(np.append(first, len(word))), *np.unique(context, return_inverse=True), n)

    @classmethod
    def read(cls, r: dict) -> Pairs:
        return cls(unpack_sorted(r["word"]), unpack(r["per_word"], np.int32), unpack_sorted(r["context"]), unpack(r["place"], np.int32), unpack(r["n"], np.int64))

    def row(self, bucket: int) -> tuple:
        return bucket, 0, pack_sorted(self.words), pack(self.per_word, np.int32), pack_sorted(self.contexts), pack(self.place, np.int32), pack(self.n, np.int64)

    @property
    def word(self) -> np.ndarray:
        return np.repeat(self.words, self.per_word)

    @property
    def context(self) -> np.ndarray:
        return self.contexts[self.place]

    def by_word(self, x: np.ndarray) -> np.ndarray:
        """Sums over each word's pairs."""
        return np.add.reduceat(x, np.cumsum(self.per_word) - self.per_word) if len(x) else np.zeros(0, np.int64)

    def by_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, x, len(self.contexts)).astype(np.int64)

    def take(self, on: np.ndarray) -> Pairs:
        return Pairs.of(self.word[on], self.context[on], self.n[on])


def restaurants(docs: DataFrame, grid: Grid) -> DataFrame:
    """A row for each bucket: its pairs of word and context that training texts hold, and how often."""
    schema = _schema(PAIRS)

    def emit(k, batch, piece):
        n = piece.seen(np.asarray(batch.column("train").to_pylist(), bool))
        on = np.flatnonzero(n)
        word, context, n = piece.vocabulary[piece.word[on]], piece.vocabulary[piece.context[on]], n[on]
        bucket = grid.pairs(word, context)
        order = by_bucket(bucket)
        word, context, n = word[order], context[order], n[order]
        return _table([_told_pairs(b, grid.salt(k), word[p:q], context[p:q], n[p:q]) for b, p, q in _ranges(bucket[order])], schema)

    def merge(group: pa.Table) -> pa.Table:
        parts = [_read_told(r) for r in _each(group.to_batches())]
        word, context, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(mix(context * U64(BASE) + word))
        word, context, n = word[order], context[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1])]))
        word, context, n = word[first], context[first], np.add.reduceat(n, first)
        order = np.argsort(word, kind="stable")
        return _table([Pairs.of(word[order], context[order], n[order]).row(group.column("bucket")[0].as_py())], schema)

    rows = _cut(docs, PAIRS, emit, ("t", "train"))
    merged = rows.groupBy("bucket", "salt").applyInArrow(merge, PAIRS)
    return merged.groupBy("bucket").applyInArrow(merge, PAIRS) if grid.salts > 1 else merged


# ---------------------------------------------------------------- sweeps

#: Of a bucket: pairs seen more than once, their customers, tables, openings, and tables summed over the samples.
SEATS = PAIRS + ", tables binary, opened binary, sampled binary"
#: What a bucket tells of its words as dishes (role 0) and as contexts (role 1): tables, and in the first round customers.
TOLD = "words int, bucket int, role int, word binary, customers binary, tables binary"
#: Of a words' bucket: customers (of the start: texts), tables as a dish and as a context, of pairs seen once and of all, the parent's
#: tables and openings, what all samples had (tables as a dish, in the parent, as a context), and sums. Or, with a bucket, what that one asked for in a role.
WORDS = "words int, bucket int, role int, word binary, customers binary, single_dish binary, single_context binary, dish binary, context binary, parent binary, opened binary, samples binary, sums array<double>"


def _told(rows: list, bucket: int, grid: Grid, pairs: Pairs, tables: np.ndarray, first: bool = False) -> None:
    """Adds rows for the buckets of the words that occur in these pairs."""
    guests = pairs.by_word(pairs.n), np.where(pairs.contexts == U64(START), pairs.by_context(pairs.n), 0)
    for role, (names, own, eaten) in enumerate(((pairs.words, pairs.by_word(tables), guests[0]), (pairs.contexts, pairs.by_context(tables), guests[1]))):
        for b, p, q in _ranges(grid.words(names)):
            rows.append((b, bucket, role, pack_sorted(names[p:q]), pack(eaten[p:q], np.int64) if first else b"", pack(own[p:q], np.int64)))


def _first_words(model: DataFrame, grid: Grid) -> DataFrame:
    """Words' rows before any sweep: customers, and tables of the pairs seen once."""
    told, words = _schema(TOLD), _schema(WORDS)

    def emit(batches):
        for r in _each(batches):
            pairs, rows = Pairs.read(r), []
            _told(rows, r["bucket"], grid, pairs, (pairs.n == 1).astype(np.int64), True)
            yield from _table(rows, told).to_batches()

    def gather(group: pa.Table) -> pa.Table:
        parts = [(r["role"], unpack_sorted(r["word"]), unpack(r["customers"], np.int64), unpack(r["tables"], np.int64)) for r in _each(group.to_batches())]
        word, at = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        role = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        customers, tables = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        sums = [np.bincount(at, x, len(word)) for x in (customers, tables * (role == 0), tables * (role == 1))]
        empty = pack(np.zeros(0), np.int64)
        return _table([(group.column("words")[0].as_py(), -1, 0, pack_sorted(word), *(pack(x, np.int64) for x in sums), empty, empty, empty, empty, empty, [])], words)

    return model.mapInArrow(emit, TOLD).groupBy("words").applyInArrow(gather, WORDS)


@dataclass
class Totals:
    """Training tokens, distinct words, and after each sweep the parent's customers and tables."""

    tokens: int = 0
    words: int = 0
    customers: list[float] = field(default_factory=list)
    tables: list[float] = field(default_factory=list)

    def base(self) -> float:
        return 1.0 / (self.words + 1)

    def parent(self, s: int, customers: np.ndarray, tables: np.ndarray, without: np.ndarray | float = 0.0) -> np.ndarray:
        """The parent's probability of words after sweep s, `without` so many of the word's customers."""
        left = np.maximum(customers - without, 0)
        own = left - PARENT_DISCOUNT * np.minimum(tables, left)
        new = (PARENT_STRENGTH + PARENT_DISCOUNT * self.tables[s]) * self.base()
        return (own + new) / (PARENT_STRENGTH + self.customers[s] - without)


def _samples(r: dict, n: int) -> np.ndarray:
    """Tables as a dish, in the parent and as a context, in each sample."""
    steps = unpack(r["samples"], np.int64).reshape(-1, 3, n) if n else np.zeros((0, 3, 0), np.int64)
    return np.cumsum(steps, axis=0)


def _parents(seats: DataFrame, words: DataFrame, totals: Totals, s: int, grid: Grid) -> DataFrame:
    """Sweep s over the parent: the words' new rows, and what each bucket asked for."""
    shipped = seats.sparkSession.sparkContext.broadcast(totals)
    told, schema = _schema(TOLD), _schema(WORDS)
    keep = s > BURN_IN

    def emit(batches):
        for r in _each(batches):
            rows: list = []
            _told(rows, r["bucket"], grid, Pairs.read(r), unpack(r["tables"], np.int64))
            yield from _table(rows, told).to_batches()

    def sweep(asked: pa.Table, known: pa.Table) -> pa.Table:
        totals, rows = shipped.value, []
        for r in _each(known.to_batches()):
            word = unpack_sorted(r["word"])
            eaten, single_dish, single_context = (unpack(r[k], np.int64) for k in ("customers", "single_dish", "single_context"))
            dish, context, places = single_dish.copy(), single_context.copy(), []
            for a in _each(asked.to_batches()):
                at = np.searchsorted(word, unpack_sorted(a["word"]))
                (context if a["role"] else dish)[at] += unpack(a["tables"], np.int64)
                places.append((a["bucket"], a["role"], at))
            on = np.flatnonzero(dish)  # all but the start
            customers, key = dish[on], _salted(word[on], 1000 + s)
            n = len(on)
            if s:
                old = Seating(unpack(r["parent"], np.int64), unpack(r["opened"], np.int64))
                before = unpack(r["dish"], np.int64)[on]
                weight = (PARENT_STRENGTH + PARENT_DISCOUNT * (totals.tables[s - 1] - old.tables)) * totals.base()
                slope = np.full(n, PARENT_DISCOUNT * totals.base())
                old = seat(old.cut(customers), np.minimum(before, customers), customers, weight, slope, PARENT_DISCOUNT, _salted(key, 7))
                now = seated(old, customers, weight, slope, PARENT_DISCOUNT, key, s == 1)
            else:
                now = Seating.least(n)
            parent = np.zeros(len(word), np.int64)
            parent[on] = now.tables
            samples = _samples(r, len(word))
            if keep:
                samples = np.concatenate([samples, np.stack([dish, parent, context])[None]])
            steps = np.diff(samples, axis=0, prepend=0) if len(samples) else samples
            is_word = word != U64(START)
            sums = [float(eaten[is_word].sum()), float(is_word.sum()), float(customers.sum()), float(now.tables.sum())]
            rows.append((r["words"], -1, 0, r["word"], r["customers"], r["single_dish"], r["single_context"], pack(dish, np.int64), pack(context, np.int64), pack(now.tables, np.int64), pack(now.opened, np.int64), pack(steps.ravel(), np.int64), sums))
            for b, role, at in places:
                answer = (b"", pack(context[at], np.int64), b"") if role else (pack(dish[at], np.int64), b"", pack(parent[at], np.int64))
                rows.append((r["words"], b, role, pack_sorted(word[at]), b"", b"", b"", *answer, b"", b"", []))
        return _table(rows, schema)

    return seats.mapInArrow(emit, TOLD).groupBy("words").cogroup(words.groupBy("words")).applyInArrow(sweep, WORDS)


def _first_seats(model: DataFrame) -> DataFrame:
    """Pairs seen more than once, a table each."""
    schema = _schema(SEATS)

    def emit(batches):
        for r in _each(batches):
            pairs = Pairs.read(r)
            pairs = pairs.take(pairs.n > 1)
            k = len(pairs.n)
            yield from _table([(*pairs.row(r["bucket"]), pack(np.ones(k), np.int64), b"", pack(np.zeros(k), np.int64))], schema).to_batches()

    return model.mapInArrow(emit, SEATS)


def _contexts(seats: DataFrame, answers: DataFrame, totals: Totals, s: int) -> DataFrame:
    """Sweep s over the restaurants of all contexts."""
    shipped = seats.sparkSession.sparkContext.broadcast(totals)
    schema = _schema(SEATS)
    keep = s > BURN_IN

    def sweep(own: pa.Table, told: pa.Table) -> pa.Table:
        totals, rows = shipped.value, []
        answers = sorted(((r["role"], r["words"], unpack_sorted(r["word"]), r) for r in _each(told.to_batches())), key=lambda x: x[:2])
        names = [np.concatenate([np.zeros(0, U64), *(x[2] for x in answers if x[0] == role)]) for role in (0, 1)]
        dish, parent, tables_of = (np.concatenate([np.zeros(0, np.int64), *(unpack(x[3][k], np.int64) for x in answers if x[0] == role)]) for k, role in (("dish", 0), ("parent", 0), ("context", 1)))
        for r in _each(own.to_batches()):
            pairs = Pairs.read(r)
            old = Seating(unpack(r["tables"], np.int64), unpack(r["opened"], np.int64))
            w, u = np.searchsorted(names[0], pairs.words), np.searchsorted(names[1], pairs.contexts)
            p = totals.parent(s - 1, np.repeat(dish[w], pairs.per_word), np.repeat(parent[w], pairs.per_word), old.tables)
            weight = (STRENGTH + DISCOUNT * (tables_of[u][pairs.place] - old.tables)) * p
            now = seated(old, pairs.n, weight, DISCOUNT * p, DISCOUNT, _salted(pair_key(pairs.word, pairs.context), s), s == 1)
            sampled = unpack(r["sampled"], np.int64) + (now.tables if keep else 0)
            rows.append((*(r[f] for f in ("bucket", "salt", "word", "per_word", "context", "place", "n")), pack(now.tables, np.int64), pack(now.opened, np.int64), pack(sampled, np.int64)))
        return _table(rows, schema)

    return seats.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(sweep, SEATS)


def sample(model: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame, Totals]:
    """Seats and words after all sweeps, and the totals of every sweep."""
    totals = Totals()
    seats, words = stored(_first_seats(model), "seats", "zstd"), stored(_first_words(model, grid), "words", "zstd")
    for s in range(BURN_IN + SAMPLES + 1):
        if s:
            before, seats = seats, stored(_contexts(seats, words.where("bucket >= 0"), totals, s), "seats", "zstd")
            discard(seats, before)
        before, words = words, stored(_parents(seats, words.where("bucket < 0"), totals, s, grid), "words", "zstd")
        discard(words, before)
        sums = words.where("bucket < 0").agg(*(F.coalesce(F.sum(F.col("sums")[i]), F.lit(0.0)) for i in range(4))).first()
        totals.tokens, totals.words = int(sums[0]), int(sums[1])
        totals.customers.append(sums[2])
        totals.tables.append(sums[3])
    return seats, words, totals


# ---------------------------------------------------------------- scoring

#: kind 0: pairs by their keys, 1: words by their hashes.
ASKED = "kind int, bucket int, salt int, piece bigint, key binary"
KNOWN = "kind int, bucket int, key binary, n binary, more binary"
ANSWER = "piece bigint, kind int, bucket int, n binary, more binary"


def _asked(docs: DataFrame, grid: Grid) -> DataFrame:
    """The distinct pairs and words of each piece, by bucket."""
    schema = _schema(ASKED)

    def emit(k, batch, piece):
        _, bucket, key = piece.asked(grid)
        rows = []
        for kind, bucket, key in ((0, bucket, key), (1, grid.words(piece.vocabulary), piece.vocabulary)):
            steps = np.diff(key, prepend=U64(0))
            for b, p, q in _ranges(bucket):
                steps[p] = key[p]
                rows.append((kind, b, grid.salt(k), k, pack(steps[p:q], U64)))
        return _table(rows, schema)

    return _cut(docs, ASKED, emit)


def _known(model: DataFrame, seats: DataFrame, words: DataFrame) -> DataFrame:
    """By bucket: sorted keys, customers, and tables summed over the samples, one row for pairs seen once and one for the
    others; and sorted words, customers, and what their samples had, sample by sample as differences."""
    schema = _schema(KNOWN)

    def row(bucket, word, context, n, sampled):
        key = pair_key(word, context)
        order = np.argsort(key)
        return _table([(0, bucket, pack_sorted(key[order]), pack(n[order], np.int64), pack(sampled[order], np.int64))], schema)

    def once(batches):
        for r in _each(batches):
            word, context, n = _read_told(r)
            on = n == 1
            yield from row(r["bucket"], word[on], context[on], n[on], np.full(int(on.sum()), SAMPLES)).to_batches()

    def often(batches):
        for r in _each(batches):
            yield from row(r["bucket"], *_read_told(r), unpack(r["sampled"], np.int64)).to_batches()

    own = words.where("bucket < 0").select(F.lit(1).alias("kind"), F.col("words").alias("bucket"), F.col("word").alias("key"), F.col("customers").alias("n"), F.col("samples").alias("more"))
    return model.mapInArrow(once, KNOWN).unionByName(seats.mapInArrow(often, KNOWN)).unionByName(own)


def _salts(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _found(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which are known, and where."""
    if not len(known):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return known[at] == wanted, at


def _answers(asked: DataFrame, known: DataFrame, salts: int) -> DataFrame:
    """For each row that asks: customers, and tables (of pairs) or samples (of words); zero for what isn't known."""
    schema = _schema(ANSWER)

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        names = [(r["piece"], r["kind"], r["bucket"], unpack_sorted(r["key"])) for r in _each(asked.to_batches())]
        if not names:
            return _table([], schema)
        wanted = np.concatenate([key for *_, key in names])
        each = 3 * SAMPLES if names[0][1] else 1
        n, more = np.zeros(len(wanted), np.int64), np.zeros((each, len(wanted)), np.int64)
        for r in _each(known.to_batches()):
            key = unpack_sorted(r["key"])
            hit, at = _found(key, wanted)
            at = at[hit]
            n[hit], more[:, hit] = unpack(r["n"], np.int64)[at], unpack(r["more"], np.int64).reshape(each, len(key))[:, at]
        rows, p = [], 0
        for *name, key in names:
            q = p + len(key)
            rows.append((*name, pack(n[p:q], np.int64), pack(more[:, p:q].ravel(), np.int64)))
            p = q
        return _table(rows, schema)

    by = ("kind", "bucket", "salt")
    return asked.groupBy(*by).cogroup(_salts(known, salts).groupBy(*by)).applyInArrow(answer, ANSWER)


def probabilities(n: np.ndarray, sampled: np.ndarray, eaten: np.ndarray, samples: np.ndarray, word: np.ndarray, context: np.ndarray, totals: Totals) -> np.ndarray:
    """Of pairs: the mean over the samples of the predictive probability. word, context: places in eaten and in samples."""
    seats = STRENGTH + eaten[context]
    p = (SAMPLES * n - DISCOUNT * sampled) / (SAMPLES * seats)
    for i in range(SAMPLES):
        dish, parent, tables = samples[i]
        p += (STRENGTH + DISCOUNT * tables[context]) / seats * totals.parent(BURN_IN + 1 + i, dish, parent)[word] / SAMPLES
    return p


OWN = "piece bigint, word binary, context binary, token binary"


def score(docs: DataFrame, *, doc_id="doc_id", text="text", trains=None, scan=False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). trains: a condition on doc_id for
    the rows to learn from, all by default. scan: docs is a plain scan of files, which gives the same rows in the same
    order whenever it runs; anything else is written to the shared folder first."""
    with small_batches(docs.sparkSession, columnar=256):  # packed rows are large
        return _scored(docs, docs.schema[doc_id].dataType.simpleString(), doc_id, text, trains, scan)


def _scored(docs: DataFrame, kind: str, doc_id: str, text: str, trains, scan: bool) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    docs = docs if scan else stored(docs, "texts")
    docs = docs.withColumn("train", trains(F.col("d")) if trains else F.lit(True))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    grid = Grid(max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES, 2).bit_length(), size // SALT_BYTES + 1)
    model = stored(restaurants(docs, grid), "restaurants", "zstd")
    seats, words, totals = sample(model, grid)
    known = stored(_known(model, seats, words), "known", "zstd")
    discard(known, model, seats, words)
    answers = stored(_answers(_asked(docs, grid), known, grid.salts), "answers", "zstd")
    discard(answers, known)
    shipped = spark.sparkContext.broadcast(totals)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def emit(k, batch, piece):
        order = piece.asked(grid)[0]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        train = np.asarray(batch.column("train").to_pylist(), bool)
        columns = [pa.array([k]), pa.array([batch.column("d").to_pylist()], pa.list_(batch.column("d").type)), pa.array([(~train).tolist()], pa.list_(pa.bool_())), pa.array([piece.first.tolist()], pa.list_(pa.int64()))]
        columns += [pa.array([pack(x, np.int32)], pa.binary()) for x in (piece.word[order], piece.context[order], place[piece.token])]
        return pa.table(columns, ["piece", "docs", "held", "first", "word", "context", "token"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        totals, tables = shipped.value, []
        found = sorted(_each(right.to_batches()), key=lambda r: (r["kind"], r["bucket"]))
        n, sampled = (np.concatenate([unpack(r[k], np.int64) for r in found if r["kind"] == 0]) for k in ("n", "more"))
        eaten = np.concatenate([unpack(r["n"], np.int64) for r in found if r["kind"] == 1])
        samples = np.cumsum(np.concatenate([unpack(r["more"], np.int64).reshape(SAMPLES, 3, -1) for r in found if r["kind"] == 1], axis=2), axis=0)
        for r in _each(left.to_batches()):
            word, context, token = (unpack(r[k], np.int32) for k in ("word", "context", "token"))
            if len(word) != len(n):
                raise ValueError("the texts came back in another order than before; pass scan=False")
            log_p = np.log10(probabilities(n, sampled, eaten, samples, word, context, totals))
            base = np.log10((eaten + 0.1) / (totals.tokens + 0.1 * (totals.words + 1)))[word]
            first = np.array(r["first"])
            add = lambda x: np.add.reduceat(x[token], first[:-1])  # noqa: B023, E731
            size = np.diff(first)
            values = [size, add((eaten > 0)[word].astype(np.int64)), np.full(len(size), totals.tokens), add(base), add(log_p)]
            tables.append(pa.table([pa.array(r["docs"], left.schema.field("docs").type.value_type), pa.array(r["held"], pa.bool_()), *map(pa.array, values)], names))
        return pa.concat_tables(tables)

    own = _cut(docs, f"piece bigint, docs array<{kind}>, held array<boolean>, first array<bigint>, word binary, context binary, token binary", emit, ("d", "t", "train"))
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return discard(stored(own.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(finish, schema), "scores", "zstd"), answers)


def op9_language_model(spark, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), trains=lambda d: fold(d, 10) != 0, scan=True)
