"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages become TF-IDF rows over the benchmark's own words, with
document frequencies from the whole corpus; a distributed randomised SVD gives
their latent space.  Every passage of every document is projected into it and
compared with all benchmark passages by cosine.  What the latent space misses is
found by rare words: a leak may lack only so many of an item's words, so some of
its rarest ones must stand close together.  Candidates are verified word by
word: the longest common subsequence with the item must cover most of it, or
less if the item's answer stands there too, as in a paraphrase.

The benchmark is the query set; it is taken in blocks of a fixed number of items,
a few blocks to a pass over the documents, so that what is broadcast stays
bounded whatever its size.  The words of all blocks are counted in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.llm.wordhash import SortedKeys, Words, chunks, lean

#: Words of a passage's half; passages overlap by one half.
HALF = 32
RANK, OVERSAMPLE, POWER_STEPS = 128, 16, 2
#: Items of one block of the benchmark.
BLOCK_ITEMS = 1024
#: Blocks that are searched in one pass over the documents, and words that are counted in one.
PASS_BLOCKS, PASS_TERMS = 4, 1 << 22
COSINE = 0.45
#: Share of an item's words in the common subsequence, without and with its answer beside it.
SURE, WITH_ANSWER = 0.8, 0.6
#: Items of fewer words than this match only as a run of words without gaps.
SHORT_ITEM = 8
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 32


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words without ASCII punctuation, in lower case."""
    return Words(_FOLD[data], offsets)


class Item:
    """An item's word hashes, and which of them are its answer's."""

    def __init__(self, item_id: int, text: str) -> None:
        self.item_id = item_id
        self.words = _hashes(text)
        # The answer follows an answer mark, or is the last line or sentence.
        low = text.rstrip().lower()
        at = max(low.rfind("answer:"), low.rfind("\n"))
        if at < 0:
            at = low.rstrip(".!? ").rfind(". ")
        self.answer = set(_hashes(text[at + 1 :]).tolist()) if at >= 0 else set()
        self.numbers = set(_hashes(" ".join(w for w in text.split() if any(c.isdigit() for c in w))).tolist())
        #: For the bit-parallel subsequence: the places of each word.
        self.places: dict[int, int] = {}
        for i, w in enumerate(self.words.tolist()):
            self.places[w] = self.places.get(w, 0) | 1 << i

    def common(self, region: list[int]) -> int:
        """Length of the longest common subsequence with the region's words."""
        full = (1 << len(self.words)) - 1
        row = full
        for w in region:
            if hit := self.places.get(w):
                hit &= row
                row = ((row + hit) | (row - hit)) & full
        return len(self.words) - row.bit_count()

    def least(self) -> int:
        """The fewest words that a leak has in common with the item."""
        n = len(self.words)
        if n < SHORT_ITEM:
            return n
        share = WITH_ANSWER if self.answer else SURE
        return next(c for c in range(int(share * n), n + 1) if c / n >= share)

    def stands(self, region: np.ndarray) -> bool:
        """Whether the item's words follow each other somewhere in the region."""
        places = len(region) - len(self.words) + 1
        hit = np.ones(max(0, places), dtype=bool)
        for k, w in enumerate(self.words):
            hit &= region[k : k + len(hit)] == w
        return bool(hit.any())

    def matches(self, region: np.ndarray, own: np.ndarray) -> tuple[bool, float, bool]:
        """(whether the region leaks the item, share of its words in common, whether its answer is there).

        own marks the region's words that the item has; the others are in no common subsequence.
        """
        n, words = len(self.words), region[own].tolist()
        share, there = self.common(words) / n, set(words)
        answer = bool(self.answer) and self.answer <= there and self.numbers <= there
        if n < SHORT_ITEM:
            return self.stands(region), share, answer
        return share >= SURE or (share >= WITH_ANSWER and answer), share, answer


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return _words(raw, np.array([0, len(raw)])).hash


class Space:
    """What a block of the benchmark needs to be searched: words, their latent vectors, passages and items."""

    def __init__(self, items: list[Item], keys: SortedKeys, vectors: np.ndarray, passages: np.ndarray, owner: np.ndarray, df: np.ndarray) -> None:
        self.items, self.keys, self.vectors, self.passages, self.owner = items, keys, vectors, passages, owner
        #: Which words each item has.
        self.has = np.zeros((len(items), len(vectors) + 1), dtype=bool)
        for k, item in enumerate(items):
            self.has[k, keys.find(item.words)[0]] = True
        #: Words of each item, how many of them a leak has at least, how many of its rare words, and the items of each rare word.
        self.sizes = np.array([len(i.words) for i in items])
        self.least = [i.least() for i in items]
        self.need = np.zeros(len(items), dtype=np.int64)
        posts = []
        for k, item in enumerate(items):
            at, count = np.unique(keys.find(item.words)[0], return_counts=True)
            order = np.argsort(df[at], kind="stable")
            total, spare = np.cumsum(count[order]), len(item.words) - self.least[k]
            # Enough words that a leak can't lack them all, and some more to tell it from chance.
            to = min(int(np.searchsorted(total, spare + max(1, len(item.words) // 8))), len(total) - 1)
            self.need[k] = total[to] - spare
            posts += [(t, k) for t in at[order[: to + 1]].tolist()]
        term, self.post_item = np.array(sorted(posts), dtype=np.int64).T
        # The last place is for words of no item.
        self.post_count = np.bincount(term, minlength=len(vectors) + 1)
        self.post_first = np.cumsum(self.post_count) - self.post_count


def item_passages(words: np.ndarray) -> list[np.ndarray]:
    """An item's words in parts that fit a passage even if it straddles passages."""
    n = max(1, -(-len(words) // (HALF + HALF // 2)))
    return np.array_split(words, n)


def document_frequencies(docs: DataFrame, terms: np.ndarray, text: str = "text") -> tuple[int, np.ndarray]:
    """(number of documents, documents of each term) over all rows of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(SortedKeys(terms, np.arange(len(terms))))
    size = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, data, offsets in chunks(batch.column(0)):
                words = _words(data, offsets)
                column, there = shared.value.find(words.hash)
                pairs = np.unique(words.word_doc()[there] * np.int64(size) + column[there])
                counts += np.bincount(pairs % size, minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], n))], ["term", "n"])

    found = docs.select(docs[text].cast("binary")).mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size + 1, dtype=np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return int(out[-1]), out[:-1]


def randomised_svd(rows: DataFrame, columns: int, rank: int = RANK, steps: int = POWER_STEPS) -> np.ndarray:
    """Right singular vectors (columns x rank) of the distributed sparse matrix rows (at array<int>, weight array<double>).

    Each step multiplies A'A with a block of vectors: partitions return their
    sums, the driver only makes the block orthonormal.  The last step reads the
    singular vectors off the small matrix Q'A'AQ.
    """
    context = rows.sparkSession.sparkContext
    width = min(columns, rank + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(20240305).normal(size=(columns, width)))[0]
    for _ in range(steps + 1):
        shared = context.broadcast(q.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            total = np.zeros(shared.value.shape, dtype=np.float32)
            for batch in batches:
                for at, weight in zip(batch.column(0), batch.column(1), strict=True):
                    at, weight = at.values.to_numpy(), weight.values.to_numpy().astype(np.float32)
                    total[at] += np.outer(weight, weight @ shared.value[at])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        z = sum(np.frombuffer(r[0], dtype=np.float32).reshape(columns, width).astype(np.float64) for r in rows.mapInArrow(lean(run), "total binary").collect())
        before, q = q, np.linalg.qr(z)[0]
    values, vectors = np.linalg.eigh(before.T @ z)
    best = np.argsort(-values)[: min(rank, width)]
    return (before @ vectors[:, best])[:, values[best] > 1e-9]


def _terms(benchmark: DataFrame) -> np.ndarray:
    """The distinct words of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_words(data, offsets).hash).view(np.int64))], ["term"])

    found = benchmark.select(F.col("text").cast("binary")).mapInArrow(lean(run), "term long").distinct().toArrow()
    return np.sort(found["term"].to_numpy().view(np.uint64))


def spaces(docs: DataFrame, benchmark: DataFrame, text: str = "text", rank: int = RANK, block: int = BLOCK_ITEMS) -> Iterator[list[Space]]:
    """A latent space for each block of the benchmark, a few at a time; null texts and texts without words are no items."""
    benchmark = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    blocks = max(1, -(-benchmark.count() // block))
    terms = _terms(benchmark)
    df, total = np.zeros(len(terms), dtype=np.int64), 0
    for low in range(0, len(terms), PASS_TERMS):
        total, df[low : low + PASS_TERMS] = document_frequencies(docs, terms[low : low + PASS_TERMS], text)
    numbered = benchmark.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    group: list[Space] = []
    for b in range(blocks):
        found = [Item(r["item_id"], r["text"]) for r in numbered.where(F.col("block") == b).collect()]
        items = sorted((i for i in found if len(i.words)), key=lambda i: (i.item_id is None, i.item_id or 0))
        # Blocks are dealt by a hash, so one may have some more items; it is cut then.
        for low in range(0, len(items), block):
            group.append(_space(docs, items[low : low + block], terms, df, total, rank))
            if len(group) == PASS_BLOCKS:
                yield group
                group = []
    if group:
        yield group


def _space(docs: DataFrame, items: list[Item], every: np.ndarray, frequency: np.ndarray, total: int, rank: int) -> Space:
    terms = np.unique(np.concatenate([i.words for i in items]))
    df = frequency[np.searchsorted(every, terms)]
    idf = np.log((1 + total) / (1 + df)) + 1e-3
    rows, owner = [], []
    for k, item in enumerate(items):
        for part in item_passages(item.words):
            at, count = np.unique(np.searchsorted(terms, part), return_counts=True)
            weight = count * idf[at]
            rows.append((at.tolist(), (weight / np.linalg.norm(weight)).tolist()))
            owner.append(k)
    # From Arrow, as rows from a list would start further Python workers, which stay for a minute.
    table = pa.table({"at": pa.array([at for at, _ in rows], pa.list_(pa.int32())), "weight": pa.array([w for _, w in rows], pa.list_(pa.float64()))})
    table = docs.sparkSession.createDataFrame(table).repartition(8)
    space = randomised_svd(table, len(terms), rank)
    passages = np.stack([np.array(w) @ space[at] for at, w in rows])
    passages /= np.maximum(np.linalg.norm(passages, axis=1, keepdims=True), 1e-12)
    return Space(items, SortedKeys(terms, np.arange(len(terms))), (idf[:, None] * space).astype(np.float32), passages.astype(np.float32), np.array(owner), df)


def _rare(space: Space, words: Words, column: np.ndarray, doc: np.ndarray, first_half: np.ndarray) -> np.ndarray:
    """half * number of items + item, for all halves whose region has as many of an item's rare words as a leak of it."""
    k = len(space.items)
    at = np.flatnonzero(space.post_count[column])
    times = space.post_count[column[at]]
    begin = np.repeat(space.post_first[column[at]] - np.cumsum(times) + times, times)
    item, place = space.post_item[begin + np.arange(len(begin))], np.repeat(at, times)
    group = doc[place] * k + item
    order = np.argsort(group, kind="stable")
    item, place, group = item[order], place[order], group[order]
    last = np.arange(len(order)) + space.need[item] - 1
    here = np.flatnonzero(last < len(order))
    here = here[(group[last[here]] == group[here]) & (place[last[here]] - place[here] < 2 * HALF + 2 * space.sizes[item[here]])]
    d, item = doc[place[here]], item[here]
    low = np.maximum(0, (place[last[here]] - words.first[d] - 2 * HALF - space.sizes[item]) // HALF + 1)
    high = np.minimum(np.diff(first_half)[d] - 1, (place[here] - words.first[d] + space.sizes[item]) // HALF)
    times = np.maximum(0, high - low + 1)
    half = np.repeat(first_half[d] + low - np.cumsum(times) + times, times) + np.arange(times.sum())
    return np.unique(half * k + np.repeat(item, times))


def _search(space: Space, data: np.ndarray, offsets: np.ndarray, cosine: float, rare: bool = True) -> list[tuple[int, int, float, float, bool, bool]]:
    """(document, item, cosine, share, answer, latent) of the leaks in a chunk of documents; the best place of each pair.

    The latent space proposes; with ``rare``, rare words propose what it misses.
    latent: whether the latent space has proposed the pair.
    """
    words = _words(data, offsets)
    column, there = space.keys.find(words.hash)
    if not there.any():
        return []
    # Halves of HALF words, counted from each document's start.
    halves = -(-np.diff(words.first) // HALF)
    first_half = np.concatenate([[0], np.cumsum(halves)])
    doc = words.word_doc()
    half = first_half[doc] + (np.arange(len(doc)) - words.first[doc]) // HALF
    index = np.flatnonzero(there)
    sums = np.zeros((first_half[-1] + 1, space.vectors.shape[1]), dtype=np.float32)
    for low in range(0, len(index), 1 << 14):
        part = index[low : low + (1 << 14)]
        begins = np.flatnonzero(np.concatenate([[True], half[part][1:] != half[part][:-1]]))
        sums[half[part][begins]] += np.add.reduceat(space.vectors[column[part]], begins, axis=0)
    half_doc = np.repeat(np.arange(len(halves)), halves)
    follows = np.concatenate([half_doc[1:] == half_doc[:-1], [False]]) if len(half_doc) else np.zeros(0, bool)
    both = sums[:-1].copy()
    both[follows] += sums[1:][follows]
    both /= np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-9)
    close = both @ space.passages.T
    at, passage = np.nonzero(close >= cosine)
    best: dict[tuple[int, int], tuple[float, float, bool]] = {}
    latent = np.unique(at * len(space.items) + space.owner[passage])
    proposed, seen = set(latent.tolist()), set()
    for pair in np.union1d(latent, _rare(space, words, column, doc, first_half)).tolist() if rare else latent.tolist():
        h, k = divmod(pair, len(space.items))
        d, item = int(half_doc[h]), space.items[k]
        start = int(words.first[d]) + (h - int(first_half[d])) * HALF
        pad = len(item.words)
        low, high = max(int(words.first[d]), start - pad), min(int(words.first[d + 1]), start + 2 * HALF + pad)
        # No more words can be in common than the region has of the item's.
        own = space.has[k][column[low:high]]
        if np.count_nonzero(own) < space.least[k]:
            continue
        leak, share, answer = item.matches(words.hash[low:high], own)
        if leak:
            if pair in proposed:
                seen.add((d, k))
            near = float(close[h, space.owner == k].max())
            if (share, near) > best.get((d, k), (0.0, -1.0))[1::-1]:
                best[d, k] = near, share, answer
    return [(d, k, *v, (d, k) in seen) for (d, k), v in sorted(best.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", rank: int = RANK, cosine: float = COSINE, rare: bool = True) -> DataFrame:
    """key, item_id, cosine, lcs_share, answer_found and latent of every pair of a document and an item that it leaks.

    latent: the latent search has proposed the pair; else the search by rare
    words has, the exact way for what the latent space misses, which ``rare``
    turns off.  An item of fewer than SHORT_ITEM words matches only as a run of
    words without gaps, as single words in common say nothing.
    Null and empty texts leak nothing; rows that repeat are searched one by
    one; other columns are dropped first; an empty benchmark gives no rows, and
    neither does an empty table.  Items that repeat (equal id and text) count
    once.  A very long text is searched whole, by itself.
    """
    rows = docs.select(docs[key].alias("_key"), docs[text].cast("binary").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, item_id long, cosine double, lcs_share double, answer_found boolean, latent boolean"
    out = None
    for group in spaces(docs, benchmark, text, rank):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                for low, high, data, offsets in chunks(batch.column(1)):
                    for space in shared.value:
                        if found := _search(space, data, offsets, cosine, rare):
                            own = batch.column(0).slice(low, high - low).take(pa.array([f[0] for f in found]))
                            rest = [pa.array([space.items[f[1]].item_id for f in found], pa.int64()), *(pa.array([f[i] for f in found], t) for i, t in ((2, pa.float64()), (3, pa.float64()), (4, pa.bool_()), (5, pa.bool_())))]
                            yield pa.RecordBatch.from_arrays([own, *rest], ["_key", "item_id", "cosine", "lcs_share", "answer_found", "latent"])

        part = rows.mapInArrow(lean(run), schema)
        out = part if out is None else out.unionByName(part)
    out = docs.sparkSession.createDataFrame([], schema) if out is None else out
    return out.withColumnRenamed("_key", key)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", rank: int = RANK, cosine: float = COSINE) -> DataFrame:
    """The documents that leak no item, with all their columns; rows are judged by their own text.

    Null and empty texts leak nothing and stay; rows that repeat are judged one
    by one; with an empty benchmark all rows stay.
    """
    names, schema = docs.columns, docs.schema
    out = docs
    for group in spaces(docs, benchmark, text, rank):
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                column = batch.column(names.index(text)).cast(pa.binary())
                for low, _, data, offsets in chunks(column):
                    for space in shared.value:
                        keep[[low + f[0] for f in _search(space, data, offsets, cosine)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(lean(run), schema)
    return out
