"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point.  An
n-gram binds the vectors of its letters, each rotated by its place, into their
elementwise product; bundling (adding) the n-grams of all texts of a language
gives its prototype.  A document is the bundle of its own n-grams, and its
language is that of the prototype with the largest cosine.

Bundling is linear, so a language's n-gram counts suffice to make its
prototype; training moves one vector for each partition and language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.llm.wordhash import lean

DIMENSIONS = 1024
NGRAM = 3
UNKNOWN = "und"
#: Languages a model may have; each costs one vector on the driver.
MAX_LANGUAGES = 5000
#: Code points that one numpy pass takes, and n-grams that one matrix product takes.
CHUNK_CHARS = 1 << 20
BLOCK = 4096


def _classes() -> np.ndarray:
    """Lower-case letter for each code point; others become a space."""
    table = np.full(0x110000, 32, dtype=np.int32)
    for c in range(0x110000):
        if (s := chr(c)).isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: np.ndarray | None = None
_LETTERS: dict[int, np.ndarray] = {}


def _letters(text: str) -> np.ndarray:
    """Code points of the text, lower case, with one space for each run of other characters."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _classes()
    codes = _TABLE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    space = codes == 32
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    codes = codes[keep]
    lead = [32] if len(codes) and codes[0] != 32 else []
    tail = [32] if len(codes) and codes[-1] != 32 else []
    return np.concatenate([np.array(lead, dtype=np.int32), codes, np.array(tail, dtype=np.int32)])


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the distinct n-grams, counts); empty if the text has no letter."""
    empty = np.zeros(0, dtype=np.int64)
    if not text:
        return empty, empty
    c = _letters(text).astype(np.int64)
    if len(c) < NGRAM or not (c != 32).any():
        return empty, empty
    code = c[: len(c) - NGRAM + 1].copy()
    for i in range(1, NGRAM):
        code = (code << 21) | c[i : len(c) - NGRAM + 1 + i]
    return np.unique(code, return_counts=True)


def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The random vector of a letter."""
    if (code, dimensions) not in _LETTERS:
        if len(_LETTERS) > 20_000:
            _LETTERS.clear()
        bits = np.random.default_rng([20240229, code]).integers(0, 2, dimensions, dtype=np.int8)
        _LETTERS[code, dimensions] = 2 * bits - 1
    return _LETTERS[code, dimensions]


def gram_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bound vectors of n-grams: place i is rotated by i."""
    out = np.ones((len(codes), dimensions), dtype=np.int8)
    for i in range(NGRAM):
        letters, at = np.unique((codes >> (21 * (NGRAM - 1 - i))) & 0x1FFFFF, return_inverse=True)
        table = np.stack([np.roll(letter_vector(int(c), dimensions), i) for c in letters]) if len(letters) else np.ones((0, dimensions), np.int8)
        out *= table[at]
    return out


def _bundle(codes: list[np.ndarray], counts: list[np.ndarray], dimensions: int) -> np.ndarray:
    """The bundles of several documents, by blocks of distinct n-grams."""
    sizes = [len(c) for c in codes]
    if not sum(sizes):
        return np.zeros((len(codes), dimensions), dtype=np.float32)
    distinct, at = np.unique(np.concatenate(codes), return_inverse=True)
    row = np.repeat(np.arange(len(codes)), sizes)
    value = np.concatenate(counts).astype(np.float32)
    out = np.zeros((len(codes), dimensions), dtype=np.float32)
    for low in range(0, len(distinct), BLOCK):
        inside = (at >= low) & (at < low + BLOCK)
        part = distinct[low : low + BLOCK]
        dense = np.zeros((len(codes), len(part)), dtype=np.float32)
        dense[row[inside], at[inside] - low] = value[inside]
        out += dense @ gram_vectors(part, dimensions).astype(np.float32)
    return out


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of rows of about CHUNK_CHARS characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of each non-null language, from all rows of docs.

    Each document counts by its n-gram counts divided by their root of squares,
    so that no very long text or hot source outweighs the others.  Only
    prototypes come to the driver: partial bundles, one for each partition and
    language, are added up in two rounds.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new: dict[str, list] = {}
            for name, t in zip(langs, texts, strict=True):
                codes, counts = grams(t)
                if len(codes):
                    new.setdefault(name, []).append((codes, counts / np.sqrt((counts * counts).sum())))
            for name, found in new.items():
                found += [sums[name]] if name in sums else []
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                sums[name] = codes, np.bincount(at, np.concatenate([w for _, w in found]), len(codes))
        names = list(sums)
        vectors = [_bundle([sums[n][0]], [sums[n][1]], dimensions)[0].astype(np.float64).tobytes() for n in names]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(vectors, pa.binary())], ["lang", "vector"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[name] = sums.get(name, 0) + np.frombuffer(raw, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "vector"])

    rows = docs.select(docs[lang].alias("lang"), docs[text].alias("text")).where(F.col("lang").isNotNull())
    parts = rows.mapInArrow(lean(partial), "lang string, vector binary")
    parts = parts.repartition(32, F.rand(7)).mapInArrow(lean(add), "lang string, vector binary")
    parts = parts.repartition(8, "lang").mapInArrow(lean(add), "lang string, vector binary")
    found = parts.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    return {r["lang"]: np.frombuffer(r["vector"], dtype=np.float64) for r in sorted(found, key=lambda r: r["lang"])}


def predict(docs: DataFrame, model: dict[str, np.ndarray], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns in keep (default doc_id), lang_pred and score, the largest cosine (0 at least).

    Null text and text without a letter give ``und`` with score 0, as does any
    text if the model has no language.  Ties go to the language that sorts first.
    """
    keep = ["doc_id"] if keep is None else keep
    names = sorted(model)
    matrix = np.stack([model[n] for n in names]) if names else np.zeros((0, DIMENSIONS))
    matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))
    fields = [docs[c].alias(f"_keep{i}") for i, c in enumerate(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            best, score = [], np.zeros(len(texts))
            for low, high in _groups(texts):
                found = [grams(t) for t in texts[low:high]]
                vectors = _bundle([c for c, _ in found], [n for _, n in found], matrix.shape[1])
                norms = np.linalg.norm(vectors, axis=1)
                known = np.array([len(c) > 0 for c, _ in found]) & (len(names) > 0)
                cosines = vectors @ matrix.T / np.maximum(norms, 1e-12)[:, None] if names else np.zeros((high - low, 1))
                top = cosines.argmax(axis=1)
                score[low:high] = np.where(known, np.clip(cosines[np.arange(high - low), top], 0, 1), 0)
                best += [names[i] if k else UNKNOWN for i, k in zip(top, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(best, pa.string()), pa.array(score)], [*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(*fields, docs[text].alias("_text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(lean(run), f"{kinds}, lang_pred string, score double")
    return out.toDF(*keep, "lang_pred", "score")
