"""Secret scans with DataFrame functions only: fixed patterns, and a likelihood ratio of two
character Markov models.

Fixed kinds, leftmost and without overlap per kind: `assign` (a name such as password or
api_key, then : or =, then a value of 8 or more characters), `access` (AKIA and capitals or
digits, 16 or more characters), `hex` (32 or more lower-case hexadecimal digits).

The kind `markov` adds runs of 16 or more token characters that no fixed span covers, if a
first-order Markov model of random strings explains them better than one of ordinary
identifiers, by LEAST_RATIO in thousandths of a natural logarithm. Both models are character
transition counts with add-one smoothing, trained from labelled samples: random strings are
the values of fixed spans and digests in base 64, base 16 and capitals; ordinary ones are the other
words, numbers, and word compounds of at most about SAMPLE_DOCS documents, chosen by a hash of
the id. The model is a table of 67 x 67 integers, whatever the size of the input.

Positions come from splitting a text at its matches and adding up lengths, in code points. A run of
any length costs time in proportion to it, and n matches of a text n to the power 1.5 additions.

Defined results: null and empty texts have no spans; ids may be null or repeated, each row is
judged alone; other columns are passed through, but `scan` replaces those named base_spans or
spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertone.llm.shared import read_table

#: The kinds and their patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 8, "access": 16, "hex": 32}

TOKEN = "[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SYMBOLS = len(ALPHABET)
SAMPLE_DOCS = 2_000
RANDOM_SAMPLES = 4_000
LEAST_RATIO = 12_000
MARK = "[SECRET]"
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _with(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(values: Column) -> Column:
    """An array cut into about as many blocks as a block has members; none for none."""
    n = F.size(values)
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    return F.when(n == 0, F.slice(F.array(values), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda k: F.slice(values, k * size + 1, size)))


def _running(values: Column, add) -> Column:
    """add() over the members up to each one, itself included; ints from 0 on. Appending to an array copies it, so
    this goes block by block: n members cost about n to the power 1.5 copied numbers."""

    def scan(array):
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def step(acc, x):
            at = add(acc["at"], x)
            return F.struct(at.alias("at"), F.array_append(acc["out"], at).alias("out"))

        return F.aggregate(array, state, step)["out"]

    def joined(blocks):
        before = F.concat(F.array(F.lit(0)), scan(F.transform(blocks, lambda b: F.element_at(b, -1))))
        return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, x: F.transform(b, lambda y: add(x, y))))

    return _with(values, lambda v: _with(F.transform(_blocks(v), scan), joined))


def _spans(text: Column, found: Column, pattern: str, kind: str, keep) -> Column:
    """Spans of the matches `found` of a pattern in a text, those that `keep(match)` accepts."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    ends = _running(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), lambda a, b: a + b)
    code = F.lit(KINDS.index(kind)).alias("kind")
    spans = F.zip_with(ends, found, lambda e, m: F.when(keep(m), F.struct((e - F.length(m)).alias("start"), code, e.alias("end"))))
    return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(F.filter(spans, lambda s: s.isNotNull()))


def _kept(kind: str):
    if kind == "assign":
        return lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST[kind]
    return lambda m: F.length(m) >= LEAST[kind]


def with_fixed_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces all columns by __text (null as empty) and __base, the spans of the fixed kinds by start and kind,
    behind __row, a struct of the columns as they were."""
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": "[0-9a-f]{32,}"}
    out = out.withColumns({f"__{k}": F.regexp_extract_all("__text", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    spans = [_spans(F.col("__text"), F.col(f"__{k}"), p, k, _kept(k)) for k, p in patterns.items()]
    return out.withColumn("__base", F.array_sort(F.concat(*spans))).drop(*(f"__{k}" for k in patterns))


def _pairs(words: DataFrame) -> DataFrame:
    """Weighted counts of neighbouring characters, as positions in the alphabet."""
    place = lambda at: F.instr(F.lit(ALPHABET), F.substr("word", at, F.lit(1))) - 1
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")
    rows = words.where(F.length("word").between(2, 128)).select("word", "random", "n", at)
    return rows.select("random", "n", place(F.col("at")).alias("a"), place(F.col("at") + 1).alias("b")).where("a >= 0 AND b >= 0").groupBy("random", "a", "b").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[int]:
    """The log-likelihood ratio of random against ordinary for each pair of characters, in
    thousandths, rows of SYMBOLS each. The sample is bounded, and so is what is returned."""
    spark = docs.sparkSession
    size = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) < int(min(1.0, SAMPLE_DOCS / max(1, size)) * (1 << 30)))
    base = with_fixed_spans(chosen.select(F.col(text).alias("t")), "t")
    secret = base.select(F.explode(F.transform("__base", lambda s: F.substr(F.col("__text"), s["start"] + 1, s["end"] - s["start"]))).alias("m")).select(F.regexp_extract("m", r"[A-Za-z0-9+/_=-]+$", 0).alias("word"), F.lit(True).alias("random"), F.lit(8).alias("n"))
    words = chosen.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[A-Za-z0-9+/_=-]{2,24}"), F.lit(0)))).alias("word")).groupBy("word").count()
    words = words.where(~F.col("word").rlike("^[0-9a-f]{20,}$|^AKIA"))
    upper = F.concat(F.upper(F.substr("word", F.lit(1), F.lit(1))), F.substr("word", F.lit(2)))
    seen = F.least(F.col("count"), F.lit(20)).alias("n")
    plain = words.select("word", F.lit(False).alias("random"), seen)
    made = words.select(F.explode(F.array(F.concat(F.col("word"), F.lit("_")), F.concat(F.col("word"), F.lit("-")), F.concat(F.lit("/"), F.col("word")), F.concat(F.lit("_"), F.col("word")), F.concat(F.lit("-"), F.col("word")), upper, F.upper("word"), F.concat(F.col("word"), F.upper(F.substr("word", F.lit(1), F.lit(1)))))).alias("word"), F.lit(False).alias("random"), F.lit(1).alias("n"))
    number = spark.range(RANDOM_SAMPLES).select(F.concat(F.lit("2"), F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("string"), 12, "0"), F.lit("-"), F.col("id").cast("string")).alias("word"), F.lit(False).alias("random"), F.lit(1).alias("n"))
    digest = F.sha2(F.col("id").cast("string"), 512)
    made_up = spark.range(RANDOM_SAMPLES).select(F.explode(F.array(F.base64(F.unhex(digest)), F.substr(digest, F.lit(1), F.lit(64)), F.substr(F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", "")), F.lit(1), F.lit(40)))).alias("word"), F.lit(True).alias("random"), F.lit(1).alias("n"))
    counts = {}
    for r in _pairs(plain.unionByName(made).unionByName(number).unionByName(secret).unionByName(made_up)).collect():
        counts[r.random, r.a, r.b] = counts.get((r.random, r.a, r.b), 0) + r.n
    out = []
    for a in range(SYMBOLS):
        total = {k: sum(counts.get((k, a, b), 0) for b in range(SYMBOLS)) + SYMBOLS for k in (True, False)}
        for b in range(SYMBOLS):
            p, q = ((counts.get((k, a, b), 0) + 1) / total[k] for k in (True, False))
            out.append(round(1000 * math.log(p / q)))
    return out


#: Characters of a run that are looked at together; a run of any length costs time in proportion.
CHUNK = 1024


def ratio(word: Column, model: list[int]) -> Column:
    """Log-likelihood ratio of a word of ALPHABET's characters, in thousandths: the sum over neighbours."""
    by_code = [0] * (128 * 128)
    for i, a in enumerate(ALPHABET):
        for j, b in enumerate(ALPHABET):
            by_code[ord(a) * 128 + ord(b)] = model[i * SYMBOLS + j]
    table = F.split(F.lit(",".join(map(str, by_code))), ",").cast("array<int>")
    # each chunk ends with the first character of the next, so no pair of neighbours is lost
    chunks = F.regexp_extract_all(word, F.lit(f"(?=(.{{1,{CHUNK + 1}}})).{{1,{CHUNK}}}"), F.lit(1))

    def of_chunk(chunk):
        def added(codes):
            pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda a, b: a * 128 + b)
            return F.aggregate(pairs, F.lit(0), lambda acc, p: acc + F.element_at(table, p + 1))

        return _with(F.transform(F.split(chunk, ""), lambda c: F.ascii(c)), added)

    return F.aggregate(chunks, F.lit(0).cast("long"), lambda acc, c: acc + of_chunk(c))


def _scanned(docs: DataFrame, model: list[int], text: str) -> DataFrame:
    """__row, __text, __base, and __spans with those that the model adds."""
    out = with_fixed_spans(docs, text)
    out = out.withColumn("__tokens", F.regexp_extract_all("__text", F.lit(TOKEN), F.lit(0)))
    tokens = _spans(F.col("__text"), F.col("__tokens"), TOKEN, "markov", lambda m: ratio(m, model) >= LEAST_RATIO)
    out = out.withColumn("__more", tokens).withColumn("__all", F.array_sort(F.concat("__base", "__more")))
    # a fixed span that covers a run starts before it or sorts before it, so the furthest end so far tells
    reach = _running(F.transform("__all", lambda s: F.when(s["kind"] < KINDS.index("markov"), s["end"]).otherwise(0)), F.greatest)
    free = F.filter(F.zip_with("__all", reach, lambda s, r: F.when((s["kind"] < KINDS.index("markov")) | (s["end"] > r), s)), lambda s: s.isNotNull())
    return out.withColumn("__spans", F.when(F.size("__more") == 0, F.col("__base")).otherwise(free)).drop("__more", "__tokens", "__all")


def scan(docs: DataFrame, model: list[int], text: str = "text") -> DataFrame:
    """The documents with base_spans and spans (arrays of start, kind, end; end exclusive), sorted by start and kind.
    Columns that had these names are replaced."""
    found = _scanned(docs, model, text)
    return found.select(*(F.col("__row")[c].alias(c) for c in docs.columns if c not in ("base_spans", "spans")), F.col("__base").alias("base_spans"), F.col("__spans").alias("spans"))


def _written(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: list[int], text: str = "text", mark: str = MARK) -> DataFrame:
    """The documents with each secret replaced by a mark, spans that overlap by one; texts without one stay as they are."""
    found = _scanned(docs, model, text).withColumn("__reach", _running(F.transform("__spans", lambda s: s["end"]), F.greatest))
    # what lies between the secrets: from the furthest end before a span to its start
    before = F.concat(F.array(F.lit(0)), F.slice("__reach", 1, F.size("__reach") - 1))
    gaps = F.filter(F.zip_with("__spans", before, lambda s, b: F.struct(b.alias("start"), s["start"].alias("end"))), lambda g: g["end"] >= g["start"])
    found = found.withColumn("__gaps", F.when(F.size("__spans") > 0, gaps).otherwise(F.array().cast("array<struct<start:int,end:int>>")))
    whole = F.col("__text")

    def of_block(gaps):
        first = gaps[0]["start"]
        return _with(F.substr(whole, first + 1, F.element_at(gaps, -1)["end"] - first), lambda part: F.transform(gaps, lambda g: F.substr(part, g["start"] - first + 1, g["end"] - g["start"])))

    kept = F.flatten(F.transform(_blocks(F.col("__gaps")), of_block))
    clean = F.concat(F.array_join(kept, mark), F.lit(mark), F.substr(whole, F.element_at("__reach", -1) + 1))
    clean = F.when(F.size("__spans") == 0, F.col("__row")[text]).otherwise(clean)
    return found.select([(clean if c == text else F.col("__row")[c]).alias(c) for c in docs.columns])


def _count(kind: str) -> Column:
    # a second parameter of the lambda, even one with a default, would be the span's place in the array
    code = KINDS.index(kind)
    return F.size(F.filter("base_spans", lambda s: s["kind"] == code)).cast("long").alias(f"n_{kind}")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs))
    return found.select("doc_id", *map(_count, KINDS[:3]), F.sha2(_written("base_spans"), 256).alias("base_sha256"), _written("spans").alias("spans"))
