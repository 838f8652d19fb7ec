import hashlib
import random

from conftest import plan_of
from corpora import WORD, documents, empty, frame, odd, prose
from pyspark.sql import functions as F

import oddsmith.llm.fingerprint as fingerprint
from oddsmith.llm.fingerprint import add_sketch, contained, fingerprints_beside_edits, merge_sketches, with_next


def in_order(rows):
    return sorted(rows, key=lambda r: -r[0])


def test_edits_and_neighbours(spark, monkeypatch):
    rows = documents()
    texts = [(d, t or "") for d, t, *_ in in_order(rows)]
    want = {}
    for i, (doc, text) in enumerate(texts):
        other = texts[(i + 1) % len(texts)][1]
        n = len(text) // 3
        want[doc] = (len(text), text[: len(text) - n] + other[:n])
    for per_bucket in (2_048, 3):
        monkeypatch.setattr(fingerprint, "ROWS_PER_BUCKET", per_bucket)
        found = fingerprints_beside_edits(frame(spark, rows))
        plan = plan_of(found)
        assert "Python" not in plan and "Arrow" not in plan
        got = found.collect()
        assert {r["doc_id"]: (r["n_chars"], r["edited"]) for r in got} == want
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_sketches(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, n, 10**6)) for i, n in enumerate([0, 1, 3, 4, 5, 6, 50, 5000, 5000])]
    df = add_sketch(spark.createDataFrame(rows, "id long, text string"), "text", "sk")
    got = {r["id"]: r["sk"] for r in df.collect()}
    assert not got[0] and all(got[i] for i in range(1, 9))
    assert all(s == sorted(set(s)) for s in got.values())
    assert 0.22 < len(got[7]) / 4996 < 0.28
    below = -(1 << 63) + (1 << 62)
    assert all(h < below for h in got[7])


def test_containment_of_unequal_texts(spark):
    rng = random.Random(2)
    small = prose(rng, 400, 10**6)
    large = f"{prose(rng, 5000, 10**6)} {small} {prose(rng, 5000, 10**6)}"
    df = spark.createDataFrame([(small, large)], "a string, b string")
    df = add_sketch(add_sketch(df, "a", "sa"), "b", "sb")
    ab, ba = df.select(contained("sa", "sb"), contained("sb", "sa")).first()
    assert ab == 1.0 and 0.02 < ba < 0.06
    union = df.select(F.concat_ws(" ", "a", "b").alias("t")).transform(lambda x: add_sketch(x, "t", "st")).first()["st"]
    both = df.select(F.explode(F.array("sa", "sb")).alias("s"), F.lit(1).alias("g"))
    merged = merge_sketches(both, ["g"], "s").first()["s"]
    assert set(merged) <= set(union) and len(set(union) - set(merged)) <= 4  # runs across the seam


def test_odd_rows(spark):
    rows = documents()
    found = fingerprints_beside_edits(odd(spark, [*rows, rows[1], rows[1]]))
    got = found.collect()
    assert len(got) == len(rows) + 4
    assert fingerprints_beside_edits(empty(spark)).count() == 0
    (one,) = fingerprints_beside_edits(frame(spark, [(5, "abc def ghi", "", "", 0)])).collect()
    assert one["edited"] == "abc def abc" and one["near_next"] == 1.0
    (nothing,) = fingerprints_beside_edits(frame(spark, [(None, None, None, None, None)])).collect()
    assert (nothing["edited"], nothing["near_edited"], nothing["near_next"]) == ("", 1.0, 1.0)
    beside = with_next(frame(spark, rows)).collect()
    assert len(beside) == len(rows) and all(r["next_text"] is not None for r in beside)


def test_query(spark):
    from conftest import TESTDATA

    from oddsmith.llm.queries import QUERIES

    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text").collect()
    texts = [(r["doc_id"], r["text"] or "") for r in sorted(docs, key=lambda r: -r["doc_id"])]
    got = {r["doc_id"]: r for r in QUERIES["op7_scaled_sketch_fingerprint"](spark, TESTDATA).collect()}
    assert len(got) == len(texts)
    prints = {}
    for i, (doc, text) in enumerate(texts):
        n = len(text) // 3
        edited = text[: len(text) - n] + texts[(i + 1) % len(texts)][1][:n]
        assert got[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints.setdefault(text, set()).add(got[doc]["fingerprint"])
        if WORD.findall(text):
            assert got[doc]["fingerprint"]
    assert all(len(x) == 1 for x in prints.values())
    long = [r for r in got.values() if r["n_chars"] > 400]
    assert sum(r["near_edited"] > r["near_next"] for r in long) >= 0.9 * len(long)
