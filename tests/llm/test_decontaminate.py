"""Hits and longest matches over many blocks and shards against brute force."""

import random

from pyspark.sql import functions as F

from tessera.llm.decontaminate import contamination, longest_matches

RNG = random.Random(5)
WORDS = [f"w{k}" for k in range(6)]  # few words, so that matches of all lengths and ties are many
ITEMS = [(k, " ".join(RNG.choices(WORDS, k=(0, 2, 9, 40)[k % 4]))) for k in range(12)] + [(3, " ".join(RNG.choices(WORDS, k=30)))]
DOCS = [(k, " ".join([*RNG.choices(WORDS, k=RNG.randrange(60)), *ITEMS[k % len(ITEMS)][1].split(), *RNG.choices(WORDS, k=5)])) for k in range(40)]
DOCS += [(100 + k, DOCS[k][1]) for k in range(10)] + [(None, DOCS[3][1]), (7, None), (8, "")]
WINDOW = 5


def test_hits_by_brute_force(spark):
    d, b = spark.createDataFrame(DOCS, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = contamination(d.repartition(3), b, window=WINDOW, shard_words=150, block_words=50)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    wanted = []
    for doc, text in DOCS:
        words, hit, items = (text or "").split(), set(), set()
        for item, own in ITEMS:
            own = own.split()
            n = min(WINDOW, len(own))
            for s in range(len(own) - n + 1 if own else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == own[s : s + n]:
                        hit.update(range(p, p + n))
                        items.add(str(item))
        wanted.append((str(doc), len(words), tuple(sorted(hit)), tuple(sorted(items))))
    ours = [(str(r.doc_id), r.hits.n_words, tuple(k for s in r.hits.spans for k in range(s.begin, s.end)), tuple(r.hits["items"])) for r in got.collect()]
    assert sorted(ours) == sorted(wanted)


def test_longest_matches_by_brute_force(spark):
    items = [x for x in dict(reversed(ITEMS)).items()]  # each id once
    d, b = spark.createDataFrame(DOCS, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    wanted = {}
    for item, own in items:
        own = own.split()
        for s in range(len(own)):
            best = None
            for doc, text in DOCS:
                words = (text or "").split()
                for p in range(len(words)):
                    n = 0
                    while s + n < len(own) and p + n < len(words) and own[s + n] == words[p + n]:
                        n += 1
                    key = (-n, doc is not None, str(doc), p)
                    if n >= WINDOW and (best is None or key < best[0]):
                        best = key, (n, None if doc is None else str(doc), p)
            if best:
                wanted[str(item), s] = best[1]
    assert max(n for n, _, _ in wanted.values()) > 16
    for shard, block in ((100, 60), (10_000, 10_000)):
        got = longest_matches(d.repartition(4), b, least=WINDOW, shard_words=shard, block_words=block).collect()
        assert {(r.item_id, r.item_word): (r.n_words, r.doc_id, r.doc_word) for r in got} == wanted


def test_item_of_many_words(spark):
    item = " ".join(f"x{k}" for k in range(70_000))
    d = spark.createDataFrame([(1, "a " + " ".join(f"x{k}" for k in range(69_000, 69_020))), (2, "x1 x3")], "doc_id bigint, text string")
    got = contamination(d, spark.createDataFrame([(1, item)], "item_id bigint, text string")).select("doc_id", F.size("hits.spans").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {1: 1, 2: 0}
