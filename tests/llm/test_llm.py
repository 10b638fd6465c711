"""The ten operators on small tables: brute force, hand-made cases and the edge cases they define."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslab.llm import ann, decontaminate, html_main, jaccard_join, language_id, license_scan, line_dedup, mixing, queries, sharding, toxicity
from corpuslab.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [
    (1, None, None, None, None), (2, "", "en", "s1", 0), (3, "   \n\n ", None, "s1", 5), (4, "one", "en", None, 3), (5, "same text here now", "en", "s2", 4),
    (6, "same text here now", "en", "s2", 4), (6, "same text here now", "en", "s2", 4), (None, "no id at all", "fr", "s3", 3), (None, "no id at all", "fr", "s3", 3), (7, "12 34 !!", None, "s1", 8),
]


def edge_docs(spark):
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    return spark.createDataFrame([*EDGES, (8, long, "en", "s1", len(long))], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def clashing(docs):
    """Extra columns with names that the operators use themselves."""
    return docs.withColumns({c: F.lit("x") for c in ("uid", "n", "keys", "score", "size", "class", "words", "weight", "c", "key", "hits", "lang_pred", "virtual_slot")})


def families(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = [None, "", " ", "a b", "a b", "A  B", "a b c d"]
    for length, copies in ((12, 6), (40, 30), (150, 25)):
        base = [rnd.choice(vocabulary) for _ in range(length)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, length // 25))):
                at = rnd.randrange(len(words))
                words[at : at + rnd.randint(0, 1)] = [rnd.choice(vocabulary)] * rnd.randint(0, 2)
            texts.append(" ".join(words))
    return texts + [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 12))) for _ in range(30)]


def roots_of(sets, linked):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and linked(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("k, num, den, seed", [(3, 9, 10, 16), (3, 9, 10, 2), (5, 4, 5, 16), (5, 4, 5, 2)])
def test_jaccard_join_brute_force(spark, k, num, den, seed):
    texts = families(k + seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k, num, den).collect()}
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    roots = roots_of(sets, lambda a, b: den * len(a & b) >= num * len(a | b))
    assert got == {i: (len(sets[i]), roots[i]) for i in range(len(texts))}


def test_jaccard_join_null_and_repeated_ids(spark, monkeypatch):
    """Ids that are null or repeated make no pairs of their own, and do not keep duplicates."""
    long = [" ".join(f"t{n}w{i}" for i in range(40)) for n in range(30)]
    near = [" ".join([*t.split()[:-1], "other"]) for t in long]
    made = []
    maker = jaccard_join._sets_of

    def counted(wanted, texts, k):
        made.append((wanted.join(texts, "row").count(), wanted.count()))
        return maker(wanted, texts, k)

    monkeypatch.setattr(jaccard_join, "_sets_of", counted)
    rows = [(None, t) for t in long + near] + [(None, long[0])] * 5
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows) and all(a == b for a, b in made) and made[0][1] > 0
    docs = spark.createDataFrame([(1, long[0]), (2, near[0]), (2, long[1]), (3, near[1]), (3, long[2]), (4, near[2]), (4, long[2]), (1, near[0])], "doc_id long, text string")
    kept = jaccard_join.keep_one(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2, 3] and {r["text"] for r in kept if r["doc_id"] > 1} == {long[1], long[2]}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(links.limit(0)).count() == 0


def test_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op2_mix_sources(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    taken, target, biggest = collections.Counter(), {}, collections.Counter()
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        biggest[s] = max(biggest[s], r["size"])
    assert abs(sum(target.values()) - total) < 1e-3 and sum(taken.values()) <= total
    assert all(abs(taken[s] - target[s]) <= 2 * biggest[s] for s in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op2_mix_sources(spark, sf_dir).collect()))


def test_water_level(spark):
    sources = spark.createDataFrame([("sa", 10, 1.0), ("sb", 100, 2.0), ("sc", 300, 3.0), ("n", 0, 1.0)], "source_key string, source_size long, weight double")
    got = {r["source_key"]: round(r["target"], 6) for r in mixing.fill(sources, 3).collect()}
    assert got == {"sa": 30.0, "sb": 152.0, "sc": 228.0, "n": 0.0}


def test_nearest_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16))
    x[50] = x[51] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (450, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.search(clashing(df), F.col("vec_id") % 50 == 0, leaf_size=16).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    hits = 0
    for q in range(0, 400, 50):
        s = unit @ unit[q]
        s[q] = -9
        best = sorted(range(400), key=lambda i: (-round(s[i], 12), i))[:5]
        hits += len({v for v, _ in got[q]} & set(best))
    assert set(got) == set(range(0, 400, 50)) and hits >= 0.9 * 40
    assert [v for v, _ in got[0][:2]] == [50, 51] and [v for v, _ in got[50][:2]] == [0, 51]
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op4_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_code_switching_and_forward_backward():
    field = language_id.fit(["the house and the garden"] * 5 + ["das haus und der garten"] * 5, ["en"] * 5 + ["de"] * 5)
    labels = [x[1] for x in language_id.word_labels("the house and the garden das haus und der garten", field)]
    assert labels[:4] == ["en"] * 4 and labels[-4:] == ["de"] * 4
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    psi, trans = rng.random((5, 2)) + 0.1, rng.random((2, 2))
    probs, pairs = language_id.forward_backward(psi, np.array([2, 3]), trans, True)
    for start, n in ((0, 2), (2, 3)):
        weights = {p: np.prod([psi[start + i, l] for i, l in enumerate(p)]) * np.exp(sum(trans[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product((0, 1), repeat=n)}
        for i in range(n):
            assert abs(probs[start + i, 1] - sum(w for p, w in weights.items() if p[i]) / sum(weights.values())) < 1e-9
    assert abs(pairs.sum() - 3) < 1e-9


def test_line_dedup(spark):
    passage = "\n".join(" ".join(f"p{i}x{j}" for j in range(20)) for i in range(4))
    docs = [(1, "head one\n" + passage + "\ntail"), (2, "other start\nmore\n" + passage), (3, "clean text of its own"), (4, passage + "\nmiddle\n" + passage), (5, None), (6, "")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1]["text"] == docs[0][1] and got[3]["text"] == "clean text of its own"
    assert got[2]["text"] == "other start\nmore" and got[4]["text"] == "middle"
    assert got[5]["text"] is None and got[6]["text"] == "" and got[2]["deleted_lines"] == [2, 3, 4, 5]


def test_line_dedup_truncated_first_copy(spark):
    """A run is deleted whole although its first fingerprint may stand in a document that holds a part of it."""
    rnd = random.Random(5)
    def own(name):
        return [" ".join(f"{name}l{i}w{rnd.randrange(999)}" for _ in range(10)) for i in range(5)]

    docs = []
    for case in range(40):
        run = [" ".join(f"r{case}l{i}w{rnd.randrange(999)}" for _ in range(10)) for i in range(6)]
        run.insert(4, "")
        docs += [(own(f"{case}a"), run[2:6], own(f"{case}A")), *((own(f"{case}{x}"), run, own(f"{case}{x.upper()}")) for x in "bcd")]
    rows = [(i, "\n".join(x + y + z)) for i, (x, y, z) in enumerate(docs)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (head, _, tail) in enumerate(docs):
        if i % 4 == 0:
            assert got[i] == rows[i][1]
        if i % 4 > 1:
            assert got[i] == "\n".join(head + tail)


def test_decontamination_brute_force(spark, sf_dir):
    rows = queries.op6_decontaminate(spark, sf_dir).collect()
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in rows}

    def grams(t):
        w = t.lower().split()
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    items = {r["item_id"]: collections.Counter(grams(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    expected = {}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        g = grams(d["text"])
        for i, item in items.items():
            n = sum(item.values())
            if not item.keys() & set(g):
                continue
            best = max(sum(min(c, w[x]) for x, c in item.items()) / n for w in (collections.Counter(g[s : s + n]) for s in range(max(1, len(g) - n + 1))))
            if best >= 0.8:
                expected[d["doc_id"], i] = round(best, 9)
    assert got == expected


def test_decontamination_reordered(spark):
    """Halves that stand swapped, and a copy with words put in, lie on no diagonal of the item."""
    w, junk = [f"w{i}" for i in range(30)], [f"j{i}" for i in range(12)]
    docs = [(1, junk + w[15:] + w[:15] + junk), (2, w[15:] + w[:15]), (3, junk + w[:15] + junk + w[15:]), (4, w[10:20] + w[:10] + w[20:])]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in docs], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(w)), (2, "a b c d e f a b c d e f")], "item_id long, text string")
    docs = docs.union(spark.createDataFrame([(5, "f a b c d e f a b c d e")], docs.schema))
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], round(r["similarity"], 3)) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1): (12, 0.846), (2, 1): (0, 0.846), (5, 2): (0, 0.875)}


def test_license_scan(spark):
    docs = [(1, "Licensed under CC BY-NC 4.0. All rights reserved"), (2, "GNU General Public License and general PUBLIC license"), (3, None), (4, "cc-by all rights, reserved. Unrelated"),
            (5, "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software")]
    got = {r["doc_id"]: r for r in license_scan.label_documents(clashing(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["labels"]) == (2, 2, 7, "cc-by,reserved", "cc-by,cc-by-nc,reserved")
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (2, 1, 5)
    assert (got[3]["n_words"], got[3]["n_base"], got[3]["labels"], got[3]["score"]) == (0, 0, "", 0.0)
    assert got[4]["n_base"] == 2 and "mit" in got[5]["labels"]


def test_toxicity(spark):
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, " ".join(rnd.choices(words, k=30) + (["scumbag"] if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(400)]
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, lambda i: i % 4 != 2)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    assert all((scored[i] >= 0.3) == bool(y) for i, _, y in rows)
    none = toxicity.fit([], [])
    assert toxicity.Scorer(none)([None, "", "x"]) == [0.5] * 3


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, ""), ("", ""), ("<p>x", "x"), ("</b></p>tail &amp; more", "tail & more"),
        ("<nav>menu</nav><article><h1>T</h1><p>Long enough text of an article &copy; here.<br>next</p><p>Hi.</p><div class='comments'>no</div></article><footer>f</footer>", "T\n\nLong enough text of an article © here. next\n\nHi."),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><main><p>yes</p></main>", "yes"),
    ],
)
def test_main_text(page, expected):
    assert html_main.main_text(page) == expected


@pytest.mark.parametrize(
    "page, expected",
    [
        ('<div class="site has-sidebar"><p>Whole text of a page.</p></div>', "Whole text of a page."),
        ('<div id="page" class="with-menu no-comments"><article><p>An article.</p></article></div>', "An article."),
        ('<div class="menu-theme"><div class="nav"><a href="/">Home</a></div><div><p>The long text of the page itself.</p></div><div class="comments"><p>A reader wrote much more than the page itself holds, on and on.</p></div></div>', "The long text of the page itself."),
        ('<div class="ads-on"><main><p>Main text.</p></main></div><p>x</p>', "Main text."),
        ('<article><p>Short.</p></article><div id="comments"><article><p>A reader wrote much more than the page itself holds.</p></article></div>', "Short."),
        ('<div><p>Text of the page here.</p></div><div class="sidebar has-text"><p>Something else that is at the side.</p></div>', "Text of the page here."),
    ],
)
def test_main_text_wrappers(page, expected):
    assert html_main.main_text(page) == expected


def test_sharding(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_slot_sharding(spark, sf_dir).collect()
    held, places = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        held[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
        assert r["size"] == len(docs[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode())
    assert len(rows) == len(docs) and all(sorted(x) == list(range(len(x))) for x in places.values())
    assert max(held.values()) - min(held.values()) <= max(r["size"] for r in rows)


def test_slot_map(spark, tmp_path):
    sizes = {s: (s * 37) % 101 + 1 for s in range(256)}
    first = sharding.plan(sizes, 4, 256)
    more = sharding.rebalance(first, sizes, 5)
    moved = [s for s in range(256) if first.shards[s] != more.shards[s]]
    assert all(more.shards[s] == 4 for s in moved) and more.version == 2
    fewer = sharding.rebalance(more, sizes, 3)
    held = collections.Counter()
    for s, shard in enumerate(fewer.shards):
        held[shard] += sizes[s]
    assert set(held) == {0, 1, 2} and max(held.values()) - min(held.values()) <= 110
    first.save(spark, str(tmp_path / "map"))
    more.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == more and sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == first


def test_edges(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns, empty tables."""
    items = spark.createDataFrame([(1, "word1 word2 word3 word4 word5 word6"), (2, None), (3, ""), (4, "same text here now")], "item_id long, text string")
    for docs, n in ((clashing(edge_docs(spark)), 11), (empty_docs(spark), 0)):
        assert jaccard_join.jaccard_components(docs).count() == n
        assert line_dedup.dedup_lines(docs).count() == n
        assert license_scan.label_documents(docs).count() == n
        assert sharding.shard_documents(docs, 4).count() == n
        assert mixing.mix(docs).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] == n
        field = language_id.train(docs, lambda i: F.lit(True))
        labelled = language_id.label_documents(docs, field, lang_out="found", score_out="found_score")
        assert labelled.count() == n
        leaks = decontaminate.leaks(docs, items).collect()
        assert {(r["doc_id"], r["item_id"]) for r in leaks} == ({(5, 4), (6, 4), (8, 1)} if n else set())
        assert decontaminate.clean_documents(docs, items).count() == (7 if n else 0)
        model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"), lambda i: F.lit(True))
        assert toxicity.score_documents(docs, model).count() == n
    kept = jaccard_join.keep_one(edge_docs(spark)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept if r["text"] == "same text here now") == [(5, "same text here now")]
    assert sum(r["doc_id"] is None for r in kept) == 2


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), f"test-{name}")
        if name != "shard":
            assert docs.columns == columns
        if name == "near_duplicates":
            texts = [(r["doc_id"], set(zip(*[r["text"].lower().split()[i:] for i in range(5)]))) for r in before.collect()]
            roots = roots_of([s for _, s in texts], lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
            ids = [i for i, _ in texts]
            groups = collections.defaultdict(list)
            for i, root in zip(ids, roots):
                groups[root].append(i)
            short = {i for i, s in texts if not s}
            kept = {r["doc_id"] for r in docs.collect()}
            assert {min(g) for g in groups.values() if g[0] not in short} <= kept and len(kept - short) == sum(1 for g in groups.values() if g[0] not in short)
    assert docs.count() > 0
