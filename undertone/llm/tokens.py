"""Token counts by offset-mapped attribution.

Each document is encoded once, as a whole. The bytes of its tokens, laid end to end, are the
bytes of the text, so every token has a character span; sections are spans too. Tokens are
attributed by an interval join of the two ordered lists of spans within each document. A
token that crosses a boundary goes, by the rule chosen,
  start   to the section that holds its first byte,
  most    to the section that holds most of its bytes, the earlier one on ties,
  split   to each section it touches, in proportion to bytes (a fraction).
Sections follow each other without gaps: by default the paragraphs of the text, a section
ending after each run of line feeds that is followed by text. Counts over the sections of
a document add up to its tokens whatever the rule.

Defined results: null and empty texts have one section without tokens; a token inside a
character (bytes of one character in several tokens) is attributed by its bytes like any
other; ids may be null or repeated, each row is judged alone; other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm.bpe import WHITE
from undertone.llm.shared import pieces, read_table
from undertone.llm.words import flat

RULES = ("start", "most", "split")
#: White space from this length on is encoded apart: the library's splitter runs out of stack on very long runs.
LONG_RUN = regex.compile(f"[{WHITE}]{{256,}}")
#: Every 32nd character of such a run is white too, eight in a row: where this finds none there, the text holds no such run.
EVERY = 32
SAMPLED_RUN = regex.compile(f"[{WHITE}]{{8}}")
_ENCODERS: dict[int, Encoder] = {}


class Encoder:
    """The public library's encoder over texts of any length.

    A run of white space before a word is one word but for its last character, and at the end of
    a text it is one word as a whole, so it can be encoded by itself without a change to the ids.
    This holds for the default pattern only; with another one texts are encoded as they are."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, own: bool):
        self.whole = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.run = None if own else tiktoken.Encoding("run", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def ids(self, text: str | None) -> np.ndarray:
        text, parts, at = text or "", [], 0
        for m in LONG_RUN.finditer(text) if self.run and SAMPLED_RUN.search(text[::EVERY]) else ():
            end = m.end() - (m.end() < len(text))
            parts += [self.whole.encode_to_numpy(text[at : m.start()], disallowed_special=()), self.run.encode_to_numpy(text[m.start() : end], disallowed_special=())]
            at = end
        parts.append(self.whole.encode_to_numpy(text[at:], disallowed_special=()))
        return np.concatenate(parts).astype(np.int64)


class Tokenizer:
    """A public vocabulary of ranks, read on the driver and shipped to the tasks."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        import public_tokenizers

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern, self.own = pattern or public_tokenizers.PATTERN, pattern is not None

    def open(self) -> Encoder:
        """The encoder; once in a worker."""
        key = hash((self.pattern, len(self.ranks)))
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(self.ranks, self.pattern, self.own)
        return _ENCODERS[key]


def paragraphs(data: np.ndarray) -> np.ndarray:
    """Where each paragraph of a text's bytes begins, 0 included."""
    feed = data == 10
    return np.concatenate([[0], np.flatnonzero(feed[:-1] & ~feed[1:]) + 1])


def attribute(sizes: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. sizes: bytes of each token in order; cuts: where each section begins."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    first = np.searchsorted(cuts, starts, "right") - 1
    last = np.searchsorted(cuts, ends - 1, "right") - 1
    out = np.bincount(first, minlength=len(cuts)).astype(float)
    if rule == "start":
        return out
    for t in np.flatnonzero(first < last):
        sections = np.arange(first[t], last[t] + 1)
        edges = np.concatenate([[starts[t]], cuts[sections[1:]], [ends[t]]])
        share = np.diff(edges) / sizes[t]
        out[first[t]] -= 1
        if rule == "split":
            out[sections] += share
        else:
            out[sections[share.argmax()]] += 1
    return out


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, *, doc_id="doc_id", text="text", rule="start", sections=paragraphs) -> DataFrame:
    """A row for each section: doc_id, section (from 0), start and end (code points, end exclusive),
    n_tokens (double), crossing (tokens that cross the section's end), doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shipped = docs.sparkSession.sparkContext.broadcast(tokenizer)
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "section", "start", "end", "n_tokens", "crossing", "doc_tokens"]

    def run(batches):
        encoder = shipped.value.open()
        for piece in pieces(batches, "t"):
            data, at = flat(piece.column("t"))
            rows, parts = [], []
            for i, t in enumerate(piece.column("t").to_pylist()):
                own = data[at[i] : at[i + 1]]
                cuts = sections(own) if len(own) else np.zeros(1, np.int64)
                ids = encoder.ids(t)
                sizes = encoder.size[ids]
                ends = np.cumsum(sizes)
                points = np.add.reduceat(((own & 0xC0) != 0x80).view(np.uint8), cuts, dtype=np.int64) if len(own) else np.zeros(1, np.int64)
                points = np.concatenate([[0], np.cumsum(points)])
                tops = np.append(cuts[1:], len(own))
                inside = np.searchsorted(ends - sizes, tops, "left") - np.searchsorted(ends, tops, "right")
                rows += [i] * len(cuts)
                parts.append((np.arange(len(cuts)), points[:-1], points[1:], attribute(sizes, cuts, rule), inside, np.full(len(cuts), len(ids))))
            merged = [np.concatenate(x) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("d").take(pa.array(rows, pa.int64())), *(pa.array(m, pa.float64() if n == "n_tokens" else pa.int64()) for m, n in zip(merged, names[1:], strict=True))], names)

    schema = f"doc_id {kind}, section bigint, start bigint, end bigint, n_tokens double, crossing bigint, doc_tokens bigint"
    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, schema)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    out = count_tokens(read_table(spark, sf_dir, "documents"), Tokenizer())
    return out.withColumn("n_tokens", F.col("n_tokens").cast("bigint"))
