import hashlib
import random
from collections import defaultdict

from fieldglass.llm import content_sort

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")].append(d)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda d: (d is None, -(d or 0)))
        out += [(d, ids[0], len(ids), i == 0, hashlib.sha256(text.encode()).hexdigest()) for i, d in enumerate(ids)]
    return sorted(out, key=str)


def got(docs, **options):
    return sorted((tuple(r[c] for c in COLUMNS) for r in content_sort.dedup_content(docs, **options).collect()), key=str)


def test_odd(odd_docs):
    want = brute([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()])
    assert got(odd_docs) == want
    assert got(odd_docs, batch_rows=1) == want
    assert sum(not x[3] for x in want) >= 5


def test_empty(no_docs):
    assert got(no_docs) == []


def test_copies_over_many_ranges(spark):
    """A text of a third of all rows lies in many ranges, as do texts with one long head; batches end within runs."""
    rng = random.Random(4)
    rows = [(i, "The Same Text" if i % 2 else "the same text") for i in range(300)] + [(1000 + i, "x" * 100 + str(rng.randrange(40))) for i in range(200)] + [(2000 + i, chr(97 + i % 26) * (1 + i % 3)) for i in range(400)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(docs, batch_rows=7) == brute(rows)
        assert got(spark.createDataFrame([(i, "a") for i in range(500)], "doc_id long, text string"), batch_rows=7) == brute([(i, "a") for i in range(500)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_settings_are_set_back(spark, odd_docs):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got(odd_docs)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_text_of_several_mb(spark):
    long = "wörter " * 600_000
    rows = [(1, long), (2, long.replace("w", "W")), (3, long + "x"), (4, None)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
