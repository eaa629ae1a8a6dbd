import hashlib
import random
import statistics

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from undertone.llm import fingerprints as P

TABLES = "/root/testdata/sf0.01"


def slow_fingerprint(text):
    """The digest by plain loops."""
    data = (text or "").encode()
    counts = [0] * P.BUCKETS
    for i in range(len(data)):
        for k, triplet in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3))):
            if i + triplet[2] < len(data):
                h = 0
                for place, offset in enumerate(triplet):
                    h ^= int(P._TABLES[k, place, data[i + offset]])
                counts[h] += 1
    ordered = sorted(counts)
    quarter = P.BUCKETS // 4
    q = [ordered[quarter * k - 1] for k in (1, 2, 3)]
    bits = "".join(f"{sum(c > x for x in q):02b}" for c in counts)
    return counts, q, f"{int(bits, 2):0{P.BUCKETS // 2}x}"


def test_digest_against_loops(monkeypatch):
    rng = random.Random(1)
    for text in ["", "a", "abc", "abcd", "é日本", "".join(rng.choices("abcdé \n", k=700)), None]:
        counts, q, classes = slow_fingerprint(text)
        digest = P.fingerprint(text)
        assert P.bucket_counts((text or "").encode()).tolist() == counts and digest[8:] == classes and len(digest) == P._WIDTH
    text = "".join(rng.choices("abcdefé \n", k=5000)).encode()
    whole = P.bucket_counts(text)
    for size in (1, 3, 64, 999):
        monkeypatch.setattr(P, "BLOCK", size)
        assert (P.bucket_counts(text) == whole).all()


def test_difference():
    rng = random.Random(4)
    made = ["".join(rng.choices("abcdefgh ", k=k)) for k in (0, 1, 5, 50, 800, 3000)]
    found = [P.fingerprint(t) for t in made]
    for a in found:
        assert P.difference(a, a) == 0 and P.likeness(a, a) == 1.0
        for b in found:
            assert P.difference(a, b) == P.difference(b, a) and 0.0 <= P.likeness(a, b) <= 1.0
    low, high = "0000" + "00" + "00" + "00" * (P.BUCKETS // 4), "0000" + "05" + "f1" + "ff" * (P.BUCKETS // 4)
    assert P.difference(low, high) == 6 * P.BUCKETS + 5 + 1 + 1 and P.likeness(low, high) == 0.0
    a, b = P.fingerprint(made[5]), P.fingerprint(made[5].replace(made[5][100:110], "new words!"))
    assert 0.8 < P.likeness(a, b) < 1.0


def slow(rows):
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for unique ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for at, (i, t) in enumerate(rows):
        u = rows[(at + 1) % len(rows)][1]
        n = len(t) // 4
        changed = t[: len(t) - n] + u[:n]
        a, b, c = map(P.fingerprint, (t, changed, u))
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, P.likeness(a, b), P.likeness(a, c)))
    return out


def run(spark, tmp_path, rows, kind="bigint", parts=7):
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumns({"t": F.lit(1), "part": F.lit("clash"), "h": F.lit(None).cast("int"), "fingerprint": F.lit("x")})
    docs.repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in P.op13_fingerprints(spark, str(tmp_path)).collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 400])
def test_against_a_loop_over_neighbours(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, "", "a", "ab é", "日本語 text", "".join(rng.choices("abc é\n", k=rng.randint(0, 3000)))])) for i in rng.sample(range(-10, 9 * n), n)]
    rows += [(None, "the row without an id")] * (n > 2)
    assert order(run(spark, tmp_path, rows)) == order(slow(rows))


def test_equal_ids_and_rows(spark, tmp_path):
    rows = [(1, "the same row " * 20)] * 40 + [(1, f"other text {i} " * 9) for i in range(10)] + [(2, "end " * 30)]
    a, b = order(run(spark, tmp_path / "a", rows)), order(run(spark, tmp_path / "b", rows[::-1], parts=2))
    assert a == b and len(a) == len(rows)
    assert sum(r[6] == 1.0 for r in a) == 39  # a copy's next is a copy


def test_a_very_long_text(spark, tmp_path):
    rows = [(1, "long é" * 500_000), (2, "b" * 9), (3, "c")]
    assert order(run(spark, tmp_path, rows)) == order(slow(rows))


def test_edited_texts_are_nearer_than_other_texts():
    texts = [t for t in pq.read_table(f"{TABLES}/documents.parquet").column("text").to_pylist() if t and len(t) > 400][:300]
    pairs = list(zip(texts, texts[1:], strict=False))
    near = [P.likeness(P.fingerprint(a), P.fingerprint(P.edited(a, b))) for a, b in pairs]
    far = [P.likeness(P.fingerprint(a), P.fingerprint(b)) for a, b in pairs]
    assert sum(a > b for a, b in zip(near, far, strict=True)) >= 0.97 * len(pairs)
    assert statistics.median(near) > 0.6 and statistics.median(far) < 0.45


def test_digests(spark):
    rows = spark.createDataFrame([(1, "abc"), (None, None)], "k int, v string").withColumn("t", F.lit(0))
    assert {(r.doc_id, r.fingerprint) for r in P.digests(rows, doc_id="k", text="v").collect()} == {(1, P.fingerprint("abc")), (None, P.fingerprint(""))}
