"""The alignment of tokenizers against a plain version, over one document after the other."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpuslab.llm import token_alignment as ta

PATHS = ta.Tokenizers()


def tokens_by_hand(text):
    """(ids, end offsets) of both tokenizers, or None."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not text:
        return None
    if not hasattr(tokens_by_hand, "a"):
        tokens_by_hand.a, tokens_by_hand.b = Tokenizer.from_file(PATHS.a), SentencePieceProcessor(model_file=PATHS.b)
        tokens_by_hand.a.encode_special_tokens = True
    a, b = tokens_by_hand.a, tokens_by_hand.b
    letters = {}
    extra = 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            letters[chr(byte)] = byte
        else:
            letters[chr(256 + extra)] = byte
            extra += 1
    one, two = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spell_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in one]
    spell_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in two]
    if b"".join(spell_a) != (" " + text).encode() or b"".join(spell_b) != (" " + text).encode():
        return None
    sides = []
    for ids, spelled in ((one, spell_a), (two, spell_b)):
        end, ends = 0, []
        for s in spelled:
            end += len(s)
            ends.append(end)
        sides.append((ids, ends))
    return sides


def groups_by_hand(text):
    found = tokens_by_hand(text)
    if found is None:
        return None
    (a, ends_a), (b, ends_b) = found
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        x, y = [], []
        while i < len(a) and ends_a[i] <= cut:
            x.append(a[i])
            i += 1
        while j < len(b) and ends_b[j] <= cut:
            y.append(b[j])
            j += 1
        groups.append((x, y))
    return groups


def by_hand(rows):
    per_doc = [groups_by_hand(t) for _, t in rows]
    links = [collections.Counter((x, y) for a, b in groups or [] for x in a for y in b) for groups in per_doc]
    counts = collections.Counter(p for c in links for p in c)
    most = collections.defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    found = []
    for (doc_id, _), groups, held in zip(rows, per_doc, links):
        if groups is None:
            found.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(n for (a, b), n in held.items() if counts[a, b] == most[a])
        total = sum(n * counts[p] for p, n in held.items())
        found.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(held.values()), best, total, hashlib.sha256(spelled.encode()).hexdigest()))
    return found


WORDS = ["the", "The", "anti", "disestablishment", "état", "großartig", "naïve", "42", "3.14", "...", "!!", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "中文", "\U0001f600", "ﬁ", "é", "\n", "\n\n", "\t", "  ", "    ", "▁", " ", "\x00", "aaaaaaaaaaaa", "xyzzyx"]


def texts(n, seed):
    rnd = random.Random(seed)
    return [rnd.choice((" ", " ", "")).join(rnd.choice(WORDS) for _ in range(rnd.choice((1, 2, 6, 40)))) for _ in range(n)]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("small", [False, True])
def test_brute_force(spark, monkeypatch, small):
    """All at once, and with every limit so low that groups, texts and frequent pairs are split."""
    if small:
        monkeypatch.setattr(ta, "FREQUENT_PAIRS", 20)
    rows = list(enumerate([*texts(150, 1), "", None, " ", "a", "ab" * 4000, "word " * 3000]))
    rows += [(None, "the end"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_a string")
    found = ta.align_documents(docs).select(COLUMNS).collect()
    assert sorted(str(tuple(r)) for r in found) == sorted(map(str, by_hand(rows)))


def test_ids_are_those_of_the_file(sf_dir):
    """Whichever library merges: the ids are those that tokenizers gives for the JSON file."""
    import duckdb
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATHS.a)
    whole.encode_special_tokens = True
    held = [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet'").fetchall()] + texts(400, 5)
    held += ["'s'LL ", "\x1c\x1d a", "a" * 100_000, " " * 5000 + "x", "\U0001f600" * 300, "\U0001d7d8\u0661", "\u3000x", "\r\n \r\n"]
    assert [list(x) for x in ta.side_a(PATHS.a).encode(held)] == [whole.encode(" " + t, add_special_tokens=False).ids for t in held]


def test_pairs_in_slices(monkeypatch):
    """The products of groups, some ids at a time, are those of whole groups."""
    held = [t for t in texts(40, 2) if t]
    _, _, x = ta.encoded(held, PATHS)
    whole = ta.linked_pairs(x)
    monkeypatch.setattr(ta, "PAIRS_AT_A_TIME", 1)
    assert all((p == q).all() for p, q in zip(whole, ta.linked_pairs(x)))


def test_groups_and_overlaps(spark):
    rows = list(enumerate(texts(60, 3)))
    found = ta.aligned_groups(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "nth").collect()
    mine = collections.defaultdict(list)
    for r in found:
        assert r["nth"] == len(mine[r["doc_id"]])
        assert r["byte_start"] == (mine[r["doc_id"]][-1][2] if mine[r["doc_id"]] else 0)
        mine[r["doc_id"]].append((r["a_ids"], r["b_ids"], r["byte_end"]))
    for i, text in rows:
        assert [(a, b) for a, b, _ in mine[i]] == (groups_by_hand(text) or [])
        if mine[i]:
            assert mine[i][-1][2] == len((" " + text).encode())
    _, _, x = ta.encoded(["antidisestablishmentarianism"], PATHS)
    (a, ends_a), (b, ends_b) = tokens_by_hand("antidisestablishmentarianism")
    spans = lambda ends: list(zip([0, *ends[:-1]], ends))
    meeting = [(i, j) for i, (s, e) in enumerate(spans(ends_a)) for j, (u, v) in enumerate(spans(ends_b)) if s < v and u < e]
    assert sorted(map(tuple, x.overlaps.tolist())) == meeting


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ta.align_documents(docs).count() == 0
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert ta.align_documents(docs).agg(F.sum("n_a"), F.max("groups_sha256")).first() == (0, "")
