import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from doeffect.llm import resampling as R

from . import cases


def runs_of(text):
    w = cases.ALNUM.findall(cases.low(text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute(docs, items, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, runs_of(text)[1]))
    for _, text in items:
        t.update(map(bucket, runs_of(text)[1]))
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (S + 10000)) / ((s[b] + 1) * (T + 10000))))
    out, long_enough = [], []
    for i, text in docs:
        words, feats = runs_of(text)
        weight = sum(gain(bucket(f)) for f in feats)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(feats), weight, score, None])
        if words >= least:
            long_enough.append(out[-1])
    long_enough.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(long_enough[: percent * len(long_enough) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_checksums():
    texts = ["", "a", "one two", cases.prose(1, 50), "x" * 700 + " y " + "z" * 300, "café 中文 b", "A-b C"]
    got = [[] for _ in texts]
    for i, _, _, runs in R.features(pa.array(texts), 1 << 30, 3):
        for buckets, docs in runs:
            for b, d in zip(buckets.tolist(), docs.tolist()):
                got[i + d].append(b)
    assert got == [[zlib.crc32(f.encode()) % (1 << 30) for f in runs_of(t)[1]] for t in texts]


def test_matches_brute_force(spark):
    docs = cases.documents() + cases.many(spark, 300)
    items = [(1, cases.prose(11, 40)), (2, None), (3, ""), (4, "w1 w2 w3 w4"), (4, "w1 w2 w3 w4")]
    target = spark.createDataFrame(items, "item_id long, text string")
    got = rows(R.resample(cases.frame(spark, docs).repartition(5), target))
    assert got == brute([(r[0], r[1]) for r in docs], items)


def test_empty_tables(spark):
    docs, target = cases.frame(spark), spark.createDataFrame([(1, cases.prose(2, 30))], "item_id long, text string")
    assert R.resample(docs.limit(0), target).collect() == []
    assert rows(R.resample(docs, target.limit(0))) == brute([(r[0], r[1]) for r in cases.documents()], [])


def test_very_long_text(spark):
    docs = [(1, cases.prose(1, 300_000)), (2, "q" * 3_000_000), (3, cases.prose(5, 40))]
    items = [(1, cases.prose(3, 30))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(R.resample(df, spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items)


def test_ranks_with_ties_and_hot_scores(spark):
    r = random.Random(3)
    # A third of all rows have one score, and some are equal in the id as well.
    data = [(i if i % 7 else 5, 1000 if r.random() < 0.35 else r.randrange(-900, 900)) for i in range(3000)]
    data += [(None, 1000), (None, 5), (None, 1000)]
    df = spark.createDataFrame(data, "doc_id long, score long").repartition(9)
    got = R.ranked(df, samples=200).collect()
    assert sorted(x["rank"] for x in got) == list(range(1, len(data) + 1))
    want = sorted(data, key=lambda x: (-x[1], x[0] is None, x[0] or 0))
    assert [(x.doc_id, x.score) for x in sorted(got, key=lambda x: x["rank"])] == want


def test_ranges_are_even(spark):
    """One score for all rows still gives even ranges."""
    df = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("score")).repartition(8)
    plan = R.ranked(df)
    assert "SinglePartition" in plan._jdf.queryExecution().toString()  # the offsets: a row a range
    assert sorted(r["rank"] for r in plan.collect()) == list(range(1, 4001))


def test_draws_the_target_like(spark):
    docs = [(i, cases.prose(i, 60, "maths proof lemma field" if i % 10 == 0 else "cat dog bird tree house")) for i in range(400)]
    items = [(i, cases.prose(9000 + i, 60, "maths proof lemma field")) for i in range(20)]
    got = R.resample(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    drawn = [r.doc_id for r in got.where("rank is not null").collect()]
    assert len(drawn) == 20 and all(i % 10 == 0 for i in drawn)


def test_noise_is_gumbel():
    x = np.array([R.noise(i, 42) for i in range(5000)]) / 1000
    assert abs(x.mean() - 0.5772) < 0.06 and abs(x.std() - math.pi / math.sqrt(6)) < 0.06
