"""Chunking: fixed by lines, recursive by separators, semantic by sentence distances."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import texts_to_rows
from .retrieval import Embedder, HashedWords

# Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", " ", "")


@dataclass(frozen=True)
class ChunkConfig:
    method: str = "recursive"
    size: int = 1000
    overlap: int = 200

    def __post_init__(self) -> None:
        if self.method not in ("recursive", "fixed", "semantic"):
            raise ValueError(f"unknown chunking method {self.method}")
        if not 100 <= self.size <= 10_000 or not 0 <= self.overlap <= 2000 or self.overlap >= self.size:
            raise ValueError("chunk size must be 100 to 10000, overlap 0 to 2000 and below the size")


def pack(pieces: list[str], joiner: str, size: int, overlap: int) -> list[str]:
    """Greedy packing: a full window is emitted, and its tail within ``overlap`` starts the next."""
    chunks: list[str] = []
    window: list[str] = []
    width = 0
    for piece in pieces:
        extra = len(joiner) if window else 0
        if window and width + extra + len(piece) > size:
            chunks.append(joiner.join(window))
            while window and (width > overlap or width + len(joiner) + len(piece) > size):
                width -= len(window[0]) + (len(joiner) if len(window) > 1 else 0)
                window.pop(0)
            extra = len(joiner) if window else 0
        window.append(piece)
        width += extra + len(piece)
    if window:
        chunks.append(joiner.join(window))
    return [c for c in (c.strip() for c in chunks) if c]


def fixed_chunks(text: str | None, size: int, overlap: int) -> list[str]:
    """Lines packed up to ``size``; a longer line stays whole."""
    return pack([x for x in (text or "").split("\n") if x], "\n", size, overlap)


def recursive_chunks(text: str | None, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Cut at the first separator the text has, pieces too long cut again at the finer ones."""
    text = text or ""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        head, *tail = text.split(separator)
        pieces = [x for x in [head, *(separator + t for t in tail)] if x]
    else:
        pieces = list(text)
    chunks: list[str] = []
    small: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            small.append(piece)
            continue
        chunks.extend(pack(small, "", size, overlap))
        small = []
        chunks.extend(recursive_chunks(piece, size, overlap, finer) if finer else [piece])
    chunks.extend(pack(small, "", size, overlap))
    return chunks


def chunk(docs: DataFrame, config: ChunkConfig, id_col: str = "doc_id", text_col: str = "text", embedder: Embedder | None = None) -> DataFrame:
    """(id, chunk_ix, content, method, size, overlap) of each document."""
    if config.method == "semantic":
        rows = semantic(docs, config.size, id_col, text_col, embedder)
    else:
        cut = {"fixed": fixed_chunks, "recursive": recursive_chunks}[config.method]

        rows = texts_to_rows(docs, id_col, F.col(text_col), lambda texts: _numbered([cut(t, config.size, config.overlap) for t in texts]), _CHUNK)
    return rows.select("*", F.lit(config.method).alias("method"), F.lit(config.size).alias("size"), F.lit(config.overlap).alias("overlap"))


_CHUNK = "chunk_ix int, content string"


def _numbered(lists: list[list[str]]) -> tuple[list[int], list]:
    """Which list each chunk is of, its place there, and itself."""
    return [at for at, x in enumerate(lists) for _ in x], [[n for x in lists for n in range(len(x))], [c for x in lists for c in x]]


#: Sentences that are embedded at a time.
SENTENCES = 4096


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, added up in the order of the components."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def _gaps(sentences: list[str], model: Embedder) -> np.ndarray:
    """The cosine distance of each sentence to the one before; 1 where a norm is 0. The first one's means nothing."""
    gaps, before = [], None
    for at in range(0, len(sentences), SENTENCES):
        v = np.asarray(model(sentences[at : at + SENTENCES]), np.float64)
        b = np.concatenate([v[:1] if before is None else before, v[:-1]])
        norms = np.sqrt(_dots(v, v)) * np.sqrt(_dots(b, b))
        gaps.append(1.0 - np.divide(_dots(v, b), norms, out=np.zeros(len(v)), where=norms != 0))
        before = v[-1:]
    return np.concatenate(gaps) if gaps else np.zeros(0)


def _percentile(values: np.ndarray, share: float) -> float:
    """As Spark's ``percentile``."""
    ordered, position = np.sort(values), (len(values) - 1) * share
    low, high = math.floor(position), math.ceil(position)
    if ordered[low] == ordered[high]:
        return float(ordered[low])
    return float((high - position) * ordered[low] + (position - low) * ordered[high])


def semantic(docs: DataFrame, max_size: int, id_col: str, text_col: str, embedder: Embedder | None = None, percentile: float = 0.95) -> DataFrame:
    """Sentences part where the distance to the next is above the document's percentile; long parts are cut again.

    A document is cut where it is read: nothing is shuffled, and rows of one id are cut each by itself.
    """
    model = embedder or HashedWords()

    def cut(sentences: list[str], gaps: np.ndarray) -> list[str]:
        far = gaps[1:] > _percentile(gaps[1:], percentile) if len(gaps) > 1 else np.zeros(0, bool)
        at = [0, *(np.flatnonzero(far) + 1).tolist(), len(sentences)]
        parts = [" ".join(sentences[a:b]) for a, b in zip(at, at[1:])]
        return [c for p in parts for c in ([p] if len(p) <= max_size else recursive_chunks(p, max_size, 0))]

    def rows_of(lists: list) -> tuple[list[int], list]:
        gaps = _gaps([s for x in lists for s in x], model)
        at = np.cumsum([0, *map(len, lists)])
        return _numbered([cut(x, gaps[a:b]) for x, a, b in zip(lists, at, at[1:])])

    split = F.split(text_col, r"(?<=[.?!])\s+")
    return texts_to_rows(docs.where(F.col(text_col).isNotNull()), id_col, split, rows_of, _CHUNK)
