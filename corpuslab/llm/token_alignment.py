"""Alignment of two tokenizers by byte-owner arrays.

Both tokenize the same bytes. ``np.repeat`` of token numbers over token lengths gives, for A and
for B, the owner of every byte. Where an owner changes, the pair of owners is a new overlap; where
both change at once, both have a token's end there, which is a cut. Cuts part the bytes into groups,
and every A token of a group is linked with every B token of it. Texts are laid end to end and
worked through some megabytes at a time (a text's end is a cut anyhow), so all of this is a few
array operations for many texts.

Over the corpus, an id pair counts in how many documents it is linked. The tables of a run:

* ``alignments`` writes one row for each document and one for each distinct id pair of it;
* ``pair_counts`` counts documents by pair, with partial counts before the shuffle, and marks the
  pairs that no other of their A id exceeds;
* ``scored`` brings the counts back. Pairs with many documents are many rows under one key, but few
  pairs can have many: at most ``FREQUENT_PAIRS`` have more than the number of rows divided by it.
  Those are broadcast (the bound is proven, whatever the corpus), the rest is joined by shuffle,
  where no key is hot.

Defined cases: null and empty texts, and texts whose bytes a tokenizer does not give back, have no
tokens (zeros and an empty digest); repeated rows and rows without an id are documents of their own;
an empty table gives no rows. Only the id and text columns are read. A text is held whole by one
task, with some 50 bytes for each of its own.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS_PER_BATCH, removed, small_batches, written

#: Bytes of text worked through at a time; a longer text is worked through alone.
BYTES_AT_A_TIME = 1 << 21
#: Id pairs of one group that are laid out at a time.
PAIRS_AT_A_TIME = 1 << 21
#: Pairs that are broadcast, at most: some 32 bytes each.
FREQUENT_PAIRS = 500_000
# Fixed value: the pattern by which byte-level vocabularies part a text before they merge.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bits of a B id in a pair.
B_BITS = 20


@dataclass(frozen=True)
class Tokenizers:
    """Paths of the two vocabularies, which every executor has: A byte-level BPE (JSON), B a sentence-piece model."""

    a: str = "/opt/tokenizers/byte_bpe_50k.json"
    b: str = "/opt/tokenizers/piece_bpe_32k.model"


def byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: printable ones stand for themselves, the others follow 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


@dataclass
class Side:
    """A loaded tokenizer: how it encodes, and its tokens' bytes by id."""

    encode: object
    token_bytes: list[bytes]
    lengths: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.lengths = np.array([len(b) for b in self.token_bytes], np.int64)


@lru_cache(maxsize=2)
def side_a(path: str) -> Side:
    """The byte-level vocabulary of a JSON file.

    Where its ids follow its merges they are ranks, by which tiktoken merges the same pairs in the
    same order, in a third of the time; other vocabularies are left to tokenizers.
    """
    with open(path, encoding="utf-8") as f:
        model, letters = json.load(f), byte_letters()
    spelled = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items()}
    special = {t["content"].encode() for t in model["added_tokens"]}
    found = [b""] * (1 + max(*spelled.values(), *(t["id"] for t in model["added_tokens"])))
    for token, i in spelled.items():
        found[i] = token
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    merged = [spelled[bytes(letters[c] for c in "".join(pair))] for pair in pairs]
    plain = model["pre_tokenizer"].get("type") == "ByteLevel" and not model["pre_tokenizer"]["add_prefix_space"] and model["normalizer"] is None
    if plain and merged == list(range(256, 256 + len(merged))):
        from tiktoken import Encoding

        ranks = {token: i for token, i in spelled.items() if token not in special}
        loaded = Encoding("a", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})
        return Side(lambda texts: [loaded.encode_ordinary(" " + t) for t in texts], found)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return Side(lambda texts: [e.ids for e in whole.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], found)


@lru_cache(maxsize=2)
def side_b(path: str) -> Side:
    from sentencepiece import SentencePieceProcessor

    loaded = SentencePieceProcessor(model_file=path)
    pieces = [loaded.id_to_piece(i) for i in range(loaded.get_piece_size())]
    found = [bytes([int(p[3:5], 16)]) if loaded.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Side(lambda texts: loaded.encode(texts, num_threads=1), found)


@dataclass
class Aligned:
    """The alignment of texts laid end to end; documents, tokens and groups are numbered through."""

    a: np.ndarray  # ids
    b: np.ndarray
    doc_of_group: np.ndarray
    group_of_a: np.ndarray
    group_of_b: np.ndarray
    group_ends: np.ndarray  # byte offsets
    overlaps: np.ndarray  # pairs of token numbers whose bytes meet


def align(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray, doc_bytes: np.ndarray) -> Aligned:
    """Aligns token ids of documents that have so many bytes each, of both tokenizers alike."""
    owner_a = np.repeat(np.arange(len(a), dtype=np.int32), len_a)
    owner_b = np.repeat(np.arange(len(b), dtype=np.int32), len_b)
    change_a, change_b = owner_a[1:] != owner_a[:-1], owner_b[1:] != owner_b[:-1]
    first = np.concatenate([[0], np.flatnonzero(change_a | change_b) + 1])
    cuts = np.concatenate([[0], np.flatnonzero(change_a & change_b) + 1])
    group_ends = np.concatenate([cuts[1:], [len(owner_a)]])
    starts_a, starts_b = (np.concatenate([[0], np.cumsum(x)[:-1]]) for x in (len_a, len_b))
    return Aligned(
        a, b,
        np.searchsorted(np.cumsum(doc_bytes), cuts, side="right"),
        np.searchsorted(cuts, starts_a, side="right") - 1,
        np.searchsorted(cuts, starts_b, side="right") - 1,
        group_ends,
        np.stack([owner_a[first], owner_b[first]], axis=1),
    )


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of times of each."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(times, at)


def linked_pairs(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id pair, links) of every distinct pair of a document: the product of each group's ids, repeats counted."""
    n_groups = len(x.doc_of_group)
    n_a, n_b = np.bincount(x.group_of_a, minlength=n_groups), np.bincount(x.group_of_b, minlength=n_groups)
    single = (n_a == 1) & (n_b == 1)
    in_a, in_b = single[x.group_of_a], single[x.group_of_b]
    doc = x.doc_of_group[x.group_of_a[in_a]].astype(np.int64)
    keys = [(doc << 40) | (x.a[in_a] << B_BITS) | x.b[in_b]]
    times = [np.ones(len(doc), np.int64)]

    ga, ca = _summed((x.group_of_a[~in_a] << B_BITS) | x.a[~in_a], np.ones((~in_a).sum(), np.int64))
    gb, cb = _summed((x.group_of_b[~in_b] << B_BITS) | x.b[~in_b], np.ones((~in_b).sum(), np.int64))
    low = (1 << B_BITS) - 1
    of_a, of_b = ga >> B_BITS, gb >> B_BITS
    start, stop = np.searchsorted(of_b, of_a, side="left"), np.searchsorted(of_b, of_a, side="right")
    upto = np.cumsum(stop - start)
    at = 0
    while at < len(ga):  # some ids at a time, so that a group of very many is never laid out whole
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_A_TIME)))
        n = (stop - start)[at:to]
        i = np.repeat(np.arange(at, min(to, len(ga))), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + start[i]
        key, time = _summed((x.doc_of_group[of_a[i]].astype(np.int64) << 40) | ((ga[i] & low) << B_BITS) | (gb[j] & low), ca[i] * cb[j])
        keys.append(key)
        times.append(time)
        at = to
    key, time = _summed(np.concatenate(keys), np.concatenate(times))
    return key >> 40, key & ((1 << 40) - 1), time


@lru_cache(maxsize=2)
def _digit_table(size_a: int, size_b: int) -> list[str]:
    """Each id with what may follow it: a further token of the group, the other side, or the next group."""
    a, b = [str(i) for i in range(size_a)], [str(i) for i in range(size_b)]
    return [x + end for ids, ends in ((a, ",|"), (b, ",;")) for end in ends for x in ids]


def group_digests(x: Aligned, n_docs: int, size_a: int, size_b: int) -> list[str]:
    """SHA-256 of each document's groups, written as ``a1,a2|b1;a3|b2,b3``."""
    n_groups = len(x.doc_of_group)
    a_upto = np.cumsum(np.bincount(x.group_of_a, minlength=n_groups))
    b_before = np.concatenate([[0], np.cumsum(np.bincount(x.group_of_b, minlength=n_groups))[:-1]])
    last_a = np.concatenate([x.group_of_a[1:] != x.group_of_a[:-1], [True]])
    last_b = np.concatenate([x.group_of_b[1:] != x.group_of_b[:-1], [True]])
    code = np.empty(len(x.a) + len(x.b), np.int64)
    code[np.arange(len(x.a)) + b_before[x.group_of_a]] = x.a + size_a * last_a
    code[np.arange(len(x.b)) + a_upto[x.group_of_b]] = x.b + 2 * size_a + size_b * last_b
    doc_of_a, doc_of_b = x.doc_of_group[x.group_of_a], x.doc_of_group[x.group_of_b]
    ends = np.cumsum(np.bincount(doc_of_a, minlength=n_docs) + np.bincount(doc_of_b, minlength=n_docs))
    table, at, found = _digit_table(size_a, size_b), 0, []
    for end in ends.tolist():
        found.append(hashlib.sha256("".join([table[c] for c in code[at:end].tolist()])[:-1].encode()).hexdigest())
        at = end
    return found


def encoded(texts: list[str], tokenizers: Tokenizers) -> tuple[list[int], list[int], Aligned | None]:
    """Places of the texts that both tokenizers give back, their sizes in bytes, and their alignment."""
    one, two = side_a(tokenizers.a), side_b(tokenizers.b)
    kept, sizes, a, b = [], [], [], []
    for i, (text, x, y) in enumerate(zip(texts, one.encode(texts), two.encode(texts))):
        target = (" " + text).encode("utf-8", "surrogatepass")
        if b"".join([one.token_bytes[t] for t in x]) == target == b"".join([two.token_bytes[t] for t in y]):
            kept.append(i)
            sizes.append(len(target))
            a.append(np.array(x, np.int64))
            b.append(np.array(y, np.int64))
    if not kept:
        return kept, sizes, None
    a, b = np.concatenate(a), np.concatenate(b)
    return kept, sizes, align(a, b, one.lengths[a], two.lengths[b], np.array(sizes))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int | None], list[str]]]:
    """uid, doc_id and text (null: empty) of rows, some megabytes at a time."""
    for batch in batches:
        uids, ids, texts, size = [], [], [], 0
        for uid, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "text"))):
            uids.append(uid)
            ids.append(doc_id)
            texts.append(text or "")
            size += 4 * len(texts[-1])
            if size >= BYTES_AT_A_TIME:
                yield uids, ids, texts
                uids, ids, texts, size = [], [], [], 0
        if uids:
            yield uids, ids, texts


ALIGNMENT = "pairs boolean, uid long, doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_links long, groups_sha256 string, pair long, times long"
GROUPS = "doc_id long, nth long, byte_start long, byte_end long, a_ids array<int>, b_ids array<int>"


def _aligner(tokenizers: Tokenizers):
    names = [c.split()[0] for c in ALIGNMENT.split(", ")]

    def table(n: int, **columns) -> pa.RecordBatch:
        kinds = {"pairs": pa.bool_(), "groups_sha256": pa.string()}
        return pa.record_batch([pa.array(columns[c], kinds.get(c, pa.int64())) if c in columns else pa.nulls(n, kinds.get(c, pa.int64())) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uids, ids, texts in _chunks(batches):
            facts = {c: np.zeros(len(uids), np.int64) for c in ("n_a", "n_b", "n_groups", "n_overlaps", "n_links")}
            digests = np.full(len(uids), "", object)
            some = [i for i, t in enumerate(texts) if t]
            kept, _, x = encoded([texts[i] for i in some], tokenizers) if some else ([], [], None)
            if x is not None:
                place = np.array([some[i] for i in kept])
                n_groups, n_docs = len(x.doc_of_group), len(kept)
                per_group = np.bincount(x.group_of_a, minlength=n_groups) * np.bincount(x.group_of_b, minlength=n_groups)
                facts["n_a"][place] = np.bincount(x.doc_of_group[x.group_of_a], minlength=n_docs)
                facts["n_b"][place] = np.bincount(x.doc_of_group[x.group_of_b], minlength=n_docs)
                facts["n_groups"][place] = np.bincount(x.doc_of_group, minlength=n_docs)
                facts["n_overlaps"][place] = np.bincount(x.doc_of_group[x.group_of_a[x.overlaps[:, 0]]], minlength=n_docs)
                facts["n_links"][place] = np.add.reduceat(per_group, np.flatnonzero(np.diff(x.doc_of_group, prepend=-1)))
                digests[place] = group_digests(x, n_docs, len(side_a(tokenizers.a).token_bytes), len(side_b(tokenizers.b).token_bytes))
                doc, pair, times = linked_pairs(x)
                owner = np.array(uids, np.int64)[place[doc]]
                for at in range(0, len(pair), 1 << 17):
                    n = slice(at, at + (1 << 17))
                    yield table(len(pair[n]), pairs=np.ones(len(pair[n]), bool), uid=owner[n], pair=pair[n], times=times[n])
            yield table(len(uids), pairs=np.zeros(len(uids), bool), uid=uids, doc_id=ids, groups_sha256=digests, **facts)

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def alignments(docs: DataFrame, tokenizers: Tokenizers = Tokenizers(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of each document's counts and digest (``NOT pairs``), and of its distinct id pairs (``pairs``).

    ``uid`` names a row of ``docs``; ``pair`` is the A id shifted by ``B_BITS``, and the B id; ``times`` its links in the document.
    """
    with small_batches(docs.sparkSession, TEXTS_PER_BATCH):
        return written(_texts(docs, id_col, text_col).mapInArrow(_aligner(tokenizers), ALIGNMENT), "alignments")


def aligned_groups(docs: DataFrame, tokenizers: Tokenizers = Tokenizers(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups themselves: doc_id, nth, their bytes in space and text, and the ids of both tokenizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts in _chunks(batches):
            some = [i for i, t in enumerate(texts) if t]
            kept, sizes, x = encoded([texts[i] for i in some], tokenizers) if some else ([], [], None)
            if x is None:
                continue
            doc_start = np.cumsum(sizes) - sizes
            start = np.concatenate([[0], x.group_ends[:-1]])
            first = np.flatnonzero(np.diff(x.doc_of_group, prepend=-1))
            lists = [np.split(t, np.flatnonzero(np.diff(g)) + 1) for t, g in ((x.a, x.group_of_a), (x.b, x.group_of_b))]
            base = doc_start[x.doc_of_group]
            yield pa.record_batch([
                pa.array([ids[some[kept[d]]] for d in x.doc_of_group], pa.int64()), pa.array(np.arange(len(start)) - first[x.doc_of_group], pa.int64()),
                pa.array(start - base, pa.int64()), pa.array(x.group_ends - base, pa.int64()), *(pa.array(t, pa.list_(pa.int32())) for t in lists),
            ], names=[c.split()[0] for c in GROUPS.split(", ")])

    return _texts(docs, id_col, text_col).mapInArrow(run, GROUPS)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, n_docs (documents that hold it linked) and best (no pair of its A id has more)."""
    counted = pairs.groupBy("pair").agg(F.count("*").alias("n_docs"))
    counted = counted.withColumn("a", F.shiftright("pair", B_BITS))
    most = counted.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counted.join(most, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).cast("int").alias("best"))


def scored(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """uid, n_best and count_sum over the links of each document; ``counts`` is a written table."""
    n_pairs, n_rows = counts.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    least = 0 if n_pairs <= FREQUENT_PAIRS else n_rows // FREQUENT_PAIRS
    frequent = F.broadcast(counts.where(F.col("n_docs") > least))
    parts = [pairs.join(frequent, "pair")]
    if least:
        rare = pairs.join(frequent.select("pair"), "pair", "left_anti")
        parts.append(rare.join(counts.where(F.col("n_docs") <= least), "pair"))
    sums = (F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    found = [p.groupBy("uid").agg(*sums) for p in parts]
    whole = reduce(DataFrame.union, found)
    return whole if len(found) == 1 else whole.groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(docs: DataFrame, tokenizers: Tokenizers = Tokenizers(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_overlaps, n_links, n_best, count_sum and groups_sha256 of each row."""
    found = alignments(docs, tokenizers, id_col, text_col)
    pairs = found.where("pairs").select("uid", "pair", "times")
    counts = written(pair_counts(pairs), "alignment-counts")
    sums = written(scored(pairs, counts), "alignment-scores")
    removed(counts)
    rows = found.where("NOT pairs").drop("pairs", "pair", "times").join(sums, "uid", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")}
    return rows.withColumns(zero).select("doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_links", "n_best", "count_sum", "groups_sha256")
