"""Quality rules, line first: rules judge each line, failing lines go, and a document that loses
more than half of its text is rejected.

Words are `[^\\x20\\x09-\\x0D]+`; lines are split at \\n; a line without a word is neither judged
nor counted. A line fails as
  navigation   at least 2 of its words, and a quarter of them, are separators (| > » · and such);
  punctuation  over three tenths of its words end in doubled symbols or marks (`***`, `!!`), or it
               has 3 words at most and no closing mark at its end;
  boilerplate  it has 30 words at most and holds a stock phrase or, where asked for, is a stock line
               of the table, or it equals an earlier line.
A stock line (`stock_lines`), lower-cased and with single spaces, stands in many documents that are not copies of
each other: copies share the least and the greatest digest of their five-word windows, so documents
are told apart by these, and a stock line has at least ten kinds of documents, a thousandth of all
documents and half of its own. Windows of the line itself can be the least or the greatest of short
documents, so the digest that tells more kinds apart decides. This
needs no word list and holds in any language, but lines of ordinary text can be as common, so it is left to the caller.
A document is kept if the fixed base rules hold and the failing lines hold at most half of the
code points in its words.

Defined results: null and empty texts have no words, so they fail the base rules and add nothing to stock lines but their count; ids may be
null or repeated, each row is judged alone; other columns are ignored by `judge` and passed
through by `clean`, which returns the surviving lines of kept documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm.shared import pieces, read_table

LEAST_WORDS = 10
#: Of 100 words, those in repeated 5-word windows that are still accepted.
MOST_REPEATED = 20
WINDOW = 5
#: Words of a line that can be boilerplate.
SHORT = 30
#: Kinds of documents that hold a stock line: this many, and one document in LEAST_SHARE. A table has at most LEAST_SHARE
#: times as many stock lines as a document has lines on average, so their set can be held by the driver and every task.
LEAST_KINDS = 10
LEAST_SHARE = 1_000
SEPARATORS = ("|", "||", ">", ">>", "<", "»", "«", "·", "•", "/", "::", "→")
PHRASES = ("cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "click here", "sign up", "log in", "subscribe to our", "read more", "skip to content", "back to top", "lorem ipsum", "licensed under", "powered by", "share on")
LOUD = r"(?:[#*$%&|<>]{2,}|[!?]{2,})[.,;:]*$"
CLOSING = ".!?:;…。！？»”’\"')]"
_LOUD = re.compile(LOUD.encode())
_MAYBE_LOUD = re.compile(rb"[#*$%&|<>]{2}|[!?]{2}")
_SEPARATORS = frozenset(s.encode() for s in SEPARATORS)
_PHRASES = re.compile("|".join(map(re.escape, PHRASES)).encode())
_CLOSING = tuple(c.encode() for c in CLOSING)
_SYMBOLS = b"#*$%&|<>"


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words that lie in an n-word window found twice or more."""
    windows = list(zip(*(words[i:] for i in range(n)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count: dict[tuple, int] = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    total = until = 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + n - max(i, until)
            until = i + n
    return total


def digest(words: Iterable[bytes]) -> int:
    """The first 8 bytes of the MD5 of words in a row, as a signed number."""
    return int.from_bytes(hashlib.md5(b" ".join(words), usedforsecurity=False).digest()[:8], signed=True)


def extremes(words: list[bytes], n: int = WINDOW, block: int = 100_000) -> tuple[int, int]:
    """The least and the greatest MD5 (as bytes) of n-word windows, each as its first 8 bytes; of all words if they are fewer."""
    ends = []
    for begin in range(0, max(1, len(words) - n + 1), block):
        part = words[begin : begin + block + n - 1]
        windows = map(b" ".join, zip(*(part[i:] for i in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
        found = [hashlib.md5(w, usedforsecurity=False).digest() for w in windows]
        ends += [min(found), max(found)]
    return tuple(int.from_bytes(e[:8], signed=True) for e in (min(ends), max(ends)))


def stock_lines(docs: DataFrame, *, text="text") -> frozenset[int]:
    """Digests of the table's stock lines. One aggregation by line; documents of a line are counted apart by kind first, so a
    line that stands in most documents is no hot key."""

    def run(batches):
        for piece in pieces(batches, "t"):
            rows = []
            for t in piece.column("t"):
                data = (t.as_py() or "").encode().lower()
                lines = {digest(w) for w in map(bytes.split, data.split(b"\n")) if 0 < len(w) <= SHORT}
                if lines:
                    low, high = extremes(data.split())
                    rows += [(line, low, high) for line in lines]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], ["line", "low", "high"])

    rows = docs.select(F.col(text).alias("t")).mapInArrow(run, "line bigint, low bigint, high bigint")
    kinds = rows.groupBy("line").agg(F.count("*").alias("docs"), F.greatest(F.count_distinct("low"), F.count_distinct("high")).alias("kinds"))
    least = max(LEAST_KINDS, -(-docs.count() // LEAST_SHARE))
    return frozenset(r.line for r in kinds.where((F.col("kinds") >= least) & (2 * F.col("kinds") >= F.col("docs"))).select("line").collect())


def line_fails(line: bytes, words: list[bytes], repeated: bool, stock: frozenset[int] = frozenset()) -> bool:
    n = len(words)
    if repeated or (n <= SHORT and (_PHRASES.search(line.lower()) or (stock and digest(w.lower() for w in words) in stock))):
        return True
    if n <= 3 and not words[-1].endswith(_CLOSING):
        return True
    separators = sum(w in _SEPARATORS for w in words)
    if separators >= 2 and 4 * separators >= n:
        return True
    return bool(_MAYBE_LOUD.search(line)) and 10 * sum(bool(_LOUD.search(w)) for w in words) > 3 * n


@dataclass
class Verdict:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    n_failed_lines: int
    lost_chars: int
    lines: list[bytes]


def judge_text(text: str | None, stock: frozenset[int] = frozenset()) -> Verdict:
    data = (text or "").encode()
    seen, good, all_words = set(), [], []
    duplicates = failed = lost = chars = 0
    for line in data.split(b"\n"):
        words = line.split()
        if not words:
            good.append(line)
            continue
        all_words += words
        size = len(b"".join(words).decode())
        chars += size
        repeated = line in seen
        duplicates += repeated
        seen.add(line)
        if line_fails(line, words, repeated, stock):
            failed += 1
            lost += size
        else:
            good.append(line)
    n, again = len(all_words), repeated_words(all_words)
    base = n < LEAST_WORDS or 100 * again > MOST_REPEATED * n
    return Verdict(n, chars, sum(data.count(c) for c in _SYMBOLS), duplicates, again, base, not base and 2 * lost <= chars, failed, lost, good)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars")


def judge(docs: DataFrame, *, doc_id="doc_id", text="text", stock: frozenset[int] = frozenset()) -> DataFrame:
    """doc_id and the figures and verdicts of each document. stock: the table's stock lines, if they are to fail (`stock_lines`)."""
    shipped = docs.sparkSession.sparkContext.broadcast(stock)
    kinds = ["boolean" if f in ("base_failed", "kept") else "bigint" for f in FIELDS]
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, " + ", ".join(f"{f} {k}" for f, k in zip(FIELDS, kinds, strict=True))
    arrow = {"boolean": pa.bool_(), "bigint": pa.int64()}

    def run(batches):
        for piece in pieces(batches, "t"):
            found = [judge_text(t.as_py(), shipped.value) for t in piece.column("t")]
            yield pa.RecordBatch.from_arrays([piece.column("d"), *(pa.array([getattr(v, f) for v in found], arrow[k]) for f, k in zip(FIELDS, kinds, strict=True))], ["doc_id", *FIELDS])

    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, schema)


def clean(docs: DataFrame, *, text="text", stock: frozenset[int] = frozenset()) -> DataFrame:
    """Kept documents with their failing lines removed, all other columns as they were."""
    shipped = docs.sparkSession.sparkContext.broadcast(stock)

    def run(batches):
        for piece in pieces(batches, text):
            found = [judge_text(t.as_py(), shipped.value) for t in piece.column(text)]
            at = piece.schema.get_field_index(text)
            out = piece.set_column(at, piece.schema.field(at), pa.array([b"\n".join(v.lines).decode() for v in found], piece.schema.field(at).type))
            yield out.filter(pa.array([v.kept for v in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))


def _sql_list(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


_SPLIT = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_SPLIT.format("t")} AS w FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS p, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: w[i : i + {WINDOW - 1}])) AS s FROM w WHERE len(w) >= {WINDOW}),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + {WINDOW})) AS q FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d),
l1 AS (SELECT doc_id, l, i, {_SPLIT.format("l")} AS v FROM l0),
l2 AS (SELECT doc_id, l, v, len(v) AS n, row_number() OVER (PARTITION BY doc_id, l ORDER BY i) > 1 AS dup, length(array_to_string(v, '')) AS size,
  len(list_filter(v, lambda x: list_contains({_sql_list(SEPARATORS)}, x))) AS sep,
  len(list_filter(v, lambda x: regexp_matches(x, '{LOUD}'))) AS loud FROM l1 WHERE len(v) > 0),
l3 AS (SELECT *, dup OR (n <= {SHORT} AND regexp_matches(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(PHRASES)}'))
  OR (n <= 3 AND NOT list_contains({_sql_list(CLOSING)}, right(v[n], 1))) OR (sep >= 2 AND 4 * sep >= n) OR 10 * loud > 3 * n AS bad FROM l2),
f AS (SELECT doc_id, sum(size)::BIGINT AS chars, count_if(dup)::BIGINT AS dups, count_if(bad)::BIGINT AS failed, coalesce(sum(size) FILTER (bad), 0)::BIGINT AS lost FROM l3 GROUP BY doc_id),
b AS (SELECT doc_id, len(w) AS n_words, coalesce(chars, 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(failed, 0) AS n_failed_lines, coalesce(lost, 0) AS lost_chars FROM w LEFT JOIN f USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 2 * lost_chars <= word_chars AS kept FROM b
"""
