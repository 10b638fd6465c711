"""The SimHash join against brute force, and the guarantees its search rests on."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuslab.llm import simhash_join as sj


def by_hand(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: 32 for i in range(9, 14)}).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius):
    """The least index reachable from each of the fingerprints, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(spark):
    texts = ["One two  THREE four\tfive", "one two three", "Ünï ÄB one\x0btwo", "", None, "   ", "a " * 5000, "z" * 10_000, "x y x y x y x y"]
    texts += [" ".join(f"w{random.Random(i).randrange(9)}{j % 7}" for j in range(40)) for i in range(20)]
    assert [sj.fingerprint(t, 4) & (2**64 - 1) for t in texts] == [by_hand(t) for t in texts]


def test_linked_pairs_share_a_block(spark):
    """Whatever up to four bits differ; and no pair within the radius differs by more in any distance."""
    rnd = random.Random(3)
    pairs = []
    for _ in range(2000):
        x = rnd.getrandbits(64) if rnd.random() < 0.9 else rnd.choice((0, 2**64 - 1))
        y = x
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            y ^= 1 << b
        pairs.append((signed(x), signed(y)))
    frame = spark.createDataFrame(pairs, "x long, y long")
    keys = frame.select(F.arrays_overlap(sj.block_keys(F.col("x")), sj.block_keys(F.col("y"))).alias("meet"), sj.block_keys(F.col("x")).alias("k"))
    assert all(r["meet"] and len(set(r["k"])) == 66 for r in keys.collect())
    x, y = (sj.distance_table(np.array(side, np.int64)) for side in zip(*pairs))
    assert np.abs(x.astype(int) - y.astype(int)).max() == 4
    apart = [(bin(a & (2**64 - 1)).count("1")) for a, _ in pairs]
    assert (x[:, 0] == apart).all()
    # Of unrelated pairs the tables leave few.
    far = sj.distance_table(np.array([signed(rnd.getrandbits(64)) for _ in pairs], np.int64))
    assert (np.abs(x.astype(int) - far).max(axis=1) <= 4).mean() < 0.01


def test_references_around():
    found = sj.references_around(-1, 0b1011, 2).view(np.uint64).tolist()
    assert sorted(2**64 - 1 - x for x in found) == [0, 1, 2, 3, 8, 9, 10]
    assert len(sj.references_around(5, -1, 2)) == 2081


@pytest.mark.parametrize("block", [2, 16, 256])
@pytest.mark.parametrize("radius", [2, 4])
def test_links_brute_force(spark, monkeypatch, block, radius):
    """Chains, dense families (larger than a block that is compared) and strangers; every link is one."""
    monkeypatch.setattr(sj, "BLOCK", block)
    rnd = random.Random(radius)
    prints = {rnd.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1, 2**63}
    for _ in range(6):
        x, active = rnd.getrandbits(64), rnd.sample(range(64), 14)
        prints |= {x ^ sum(1 << b for b in active if rnd.random() < 0.3) for _ in range(60)}
        for _ in range(12):
            for b in rnd.sample(range(64), rnd.choice((3, 4, 5))):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    found = sj.links(spark.createDataFrame([(signed(p),) for p in prints], "print long"), radius).collect()
    assert all(r["x"] != r["y"] and ((r["x"] ^ r["y"]) & (2**64 - 1)).bit_count() <= radius for r in found)
    place = {signed(p): i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in found:
        a, b = sorted((find(place[r["x"]]), find(place[r["y"]])))
        root[b] = a
    assert [find(i) for i in range(len(prints))] == components(prints, radius)


def test_rows_of_a_family_grow_in_proportion(spark):
    """Twice the near copies give about twice the rows that meet, not four times."""

    def met(n):
        rnd = random.Random(5)
        active = rnd.sample(range(64), 20)
        prints = {sum(1 << b for b in active if rnd.random() < 0.3) for _ in range(n)}
        around = [len(sj.references_around(signed(p), sum(1 << b for b in active), 2)) for p in prints]
        return sum(around) / len(prints)

    assert met(4000) == met(8000) == 1 + 20 + 190


def test_components_of_documents(spark):
    rnd = random.Random(9)
    base = [[f"w{rnd.randrange(3000)}" for _ in range(rnd.choice((1, 3, 30, 300)))] for _ in range(40)]
    texts = ["", None, "  ", "\n"]
    for words in base:
        texts.append(" ".join(words))
        for _ in range(4):
            other = list(words)
            other[rnd.randrange(len(other))] = f"w{rnd.randrange(3000)}"
            texts.append(" ".join(other).upper())
    texts += texts[:30]
    rows = [(i * 7 % 1000, t, 0) for i, t in enumerate(texts)] + [(None, texts[6], 0), (None, "alone without an id", 0), (3, "twice", 0), (3, "twice", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    found = sj.simhash_components(docs).collect()
    prints = [by_hand(t) for _, t, _ in rows]
    roots = components(prints, 4)
    expected = []
    for i, (doc_id, _, _) in enumerate(rows):
        ids = [d for (d, _, _), r in zip(rows, roots) if r == roots[i] and d is not None]
        expected.append((doc_id, f"{prints[i]:016x}", min(ids, default=None)))
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in found)
    assert len({r["component_id"] for r in found}) < len(set(prints)) - 10


def test_empty_table(spark):
    assert sj.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hash_is_the_one_of_spark(spark):
    row = spark.sql("SELECT 'a b c d' AS s").select(F.xxhash64("s").alias("h")).first()
    assert row["h"] == signed(xxhash.xxh64(b"a b c d", seed=42).intdigest())
