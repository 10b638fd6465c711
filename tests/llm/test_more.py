"""Line dedup and decontamination against brute force on random tables; bounds, letters, maps."""

import collections
import random

from pyspark.sql import functions as F

from corpuslab.llm import decontaminate, jaccard_join, language_id, license_scan, line_dedup, mixing, queries, sharding, toxicity


def runs_before(docs, least):
    """(document, line) of all lines with words in a run of at least ``least`` words that stands earlier too."""
    found = set()
    for d, lines in enumerate(docs):
        for e in range(d + 1):
            earlier = docs[e]
            for offset in range(-len(earlier) + 1, len(lines)):
                if e == d and offset <= 0:
                    continue
                i = max(0, offset)
                while i < min(len(lines), len(earlier) + offset):
                    j = i
                    while j < min(len(lines), len(earlier) + offset) and lines[j] == earlier[j - offset]:
                        j += 1
                    if sum(len(x.split()) for x in lines[i:j]) >= least:
                        found.update((d, n) for n in range(i, j) if lines[n].split())
                    i = j + 1
    return found


def test_line_dedup_brute_force(spark):
    """All of every run of 50 words is deleted but once, and nothing that does not repeat 25 words."""
    rnd = random.Random(8)
    pool = [" ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.choice((0, 3, 8, 12)))) for _ in range(60)]
    passages = [[rnd.choice(pool) for _ in range(rnd.randint(4, 12))] for _ in range(12)]
    docs = []
    for n in range(120):
        lines = []
        for _ in range(rnd.randint(1, 4)):
            lines += [f"own {n} {rnd.random()}"] * rnd.randint(0, 1)
            part = rnd.choice(passages)
            lines += part[rnd.choice((0, 0, 1, 3)) :][: rnd.choice((99, 99, 5))]
        docs.append(lines)
    # A G B behind documents that hold G, A G and G B alone.
    a, g, b = ([" ".join(f"{x}{i}x{j}" for j in range(12)) for i in range(3)] for x in "agb")
    docs += [g, a + g, g + b, a + g + b, ["head"] + a + g + b]
    rows = [(i, "\n".join(x)) for i, x in enumerate(docs)]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    deleted = {(r["doc_id"], n) for r in found for n in r["deleted_lines"] if docs[r["doc_id"]][n].split()}
    assert len(deleted) > 100
    assert runs_before(docs, 50) <= deleted <= runs_before(docs, 25)


def test_decontamination_random(spark):
    rnd = random.Random(4)
    items = [[f"i{n}w{rnd.randrange(40)}" for _ in range(rnd.randint(3, 40))] for n in range(12)]
    docs = []
    for _ in range(150):
        words = [f"d{rnd.randrange(200)}" for _ in range(rnd.randint(0, 60))]
        part = list(rnd.choice(items))
        for _ in range(rnd.randint(0, 3)):
            at, to = rnd.randrange(len(part)), rnd.randrange(len(part))
            kind = rnd.randrange(4)
            if kind == 0:
                part[at] = "other"
            elif kind == 1:
                part.insert(at, "more")
            elif kind == 2 and len(part) > 2:
                del part[at]
            else:
                part = part[at:] + part[:at] if rnd.random() < 0.5 else part[: max(1, to)]
        at = rnd.randint(0, len(words))
        docs.append(words[:at] + part + words[at:])

    def grams(words, k):
        return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]

    expected = {}
    for d, words in enumerate(docs):
        for i, item in enumerate(items):
            k = min(5, len(item))
            mine, theirs = collections.Counter(grams(item, k)), grams(words, k)
            n = sum(mine.values())
            shares = [sum((mine & collections.Counter(theirs[s : s + n])).values()) / n for s in range(len(theirs))]
            if shares and max(shares) >= 0.8 - 1e-12:
                expected[d, i] = round(max(shares), 9)
    tables = [spark.createDataFrame([(n, " ".join(x)) for n, x in enumerate(rows)], f"{name} long, text string") for name, rows in (("doc_id", docs), ("item_id", items))]
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontaminate.leaks(*tables).collect()}
    assert got == expected and len(expected) > 20


def test_words_need_letters():
    assert language_id.chains("½ ² Ⅷ 12 x² ab") == [["x²", "ab"]]
    field = language_id.fit(["der hund"] * 3 + ["the dog"] * 3, ["de"] * 3 + ["en"] * 3)
    assert language_id.Labeller(field)(["½ ²", None, "the"])[0] == ["und", "und", "en"]


def test_samples_are_bounded_in_rows(spark, monkeypatch):
    """An id with many rows sends no more of them to the driver than were chosen."""
    docs = spark.createDataFrame([(1, f"text {i}", "en") for i in range(300)] + [(i, f"texte {i}", "fr") for i in range(2, 9)], "doc_id long, text string, lang string")
    seen = {}
    monkeypatch.setattr(language_id, "fit", lambda texts, langs: seen.update(langs=collections.Counter(langs)))
    language_id.train(docs, lambda i: F.lit(True), n_per_lang=5)
    assert seen["langs"] == {"en": 5, "fr": 5}
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.update(texts=texts))
    toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, toxic int"), lambda i: F.lit(True))
    assert len(seen["texts"]) == 3


def test_ratio_of_two_classes():
    texts, labels = ["bad word here"] * 4 + ["good word here"] * 12, [1] * 4 + [0] * 12
    model = toxicity.fit(texts, labels, prior=1.0)
    ids = {w: toxicity.features(w) for w in ("bad", "good", "word")}
    whole = {w: set(x.tolist()) for w, x in ids.items()}
    only_bad, only_good = list(whole["bad"] - whole["good"] - whole["word"]), list(whole["good"] - whole["bad"] - whole["word"])
    assert (model.values[only_bad] > 0).all() and (model.values[only_good] < 0).all()
    assert not model.values[list(whole["word"] - whole["bad"] - whole["good"])].any()


def test_license_words_decide(spark):
    docs = spark.createDataFrame([(1, "ALL RIGHTS RESERVED"), (2, "all rights İreserved"), (3, "General Public Licenſe")], "doc_id long, text string")
    got = {r["doc_id"]: r["base_labels"] for r in license_scan.label_documents(docs).collect()}
    assert got == {1: "reserved", 2: "", 3: ""}


def test_mix_of_repeated_rows(spark, tmp_path):
    """Every row is returned, repeated ones and those without an id or a source too."""
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "a b c", "t"), (None, "x y", None), (None, "x y", None), (2, None, "s"), (3, "", "t"), (3, "d e f g", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op2_mix_sources(spark, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], r["size"]) for r in found) == collections.Counter((i, len((t or "").split())) for i, t, _ in rows)
    plan = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sum(r["copies"] for r in plan) == len(rows)


def test_stored_map(spark, tmp_path):
    """Shards are read from the stored map; another number of shards adds an edited version."""
    docs = spark.createDataFrame([(i, "word " * (i % 17)) for i in range(600)], "doc_id long, text string")
    path = str(tmp_path / "map")
    first = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 4, 64, path).collect()}
    assert {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 4, 64, path).collect()} == first
    more = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 5, 64, path).collect()}
    assert all(more[i] in (first[i], 4) for i in first) and 4 in more.values()
    assert sharding.SlotMap.load(spark, path).version == 2 and sharding.SlotMap.load(spark, path, 1).n_shards == 4


def test_keep_one_of_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, row string, root long")
    assert jaccard_join.keep_one(docs).columns == docs.columns and jaccard_join.keep_one(docs).count() == 0


def test_jaccard_join_in_parts(spark, monkeypatch):
    """The number of parts changes nothing."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(x if rnd.random() > 0.03 else f"e{rnd.randrange(9)}" for x in base) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(map(tuple, jaccard_join.jaccard_components(docs).collect()))
    monkeypatch.setattr(jaccard_join, "KEY_PARTS", 1)
    monkeypatch.setattr(jaccard_join, "PAIR_PARTS", 1)
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect())) == found
    assert 1 < len({c for *_, c in found}) < 60


def test_pipeline_stages_on_odd_tables(spark, sf_dir):
    """Empty tables pass all stages; where no row has a language, documents with a letter stay."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], kind)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.count() == 0 and (name == "shard" or docs.columns == before.columns)
    rows = [(1, "some words", None, "a", 1), (2, "12 ½", None, None, 1), (3, None, None, "a", 1), (None, "other", None, None, 1)]
    kept = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, kind), sf_dir).collect()
    assert {r["text"] for r in kept} == {"some words", "other"}
