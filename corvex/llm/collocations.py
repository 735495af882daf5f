"""Phrase collocations from depth-limited count tries.

1. Each task reads its shard of the texts into tries of bounded size: a node is
   a run of up to ``max_words`` words within a piece, with its occurrences; the
   root of a part counts all its words.  Tries are built level by level with
   numpy.
2. A trie is serialised in order and cut at fixed borders into ranges of paths.
   The cuts of one range, one from each trie, meet in one task and are merged.
   Borders are quantiles of a sample; they decide how work is dealt and nothing
   else.
3. A walk along the merged order gives each node the counts of its ancestors,
   which are the left parts of all cuts.  Where a range begins inside a subtree,
   the ancestors are the last nodes of each depth in the ranges before it.
4. The suffix link of a node (its words but the first) gives the right parts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvex.llm import store

#: Words that a task holds before it writes its trie.
SHARD_WORDS = 1 << 20
#: Bytes of a text that are looked at together; slices end where a piece ends.
SLICE = 1 << 20
#: Nodes that a range is to hold, and the most ranges (their borders go to every task).
RANGE_NODES, MOST_RANGES = 1 << 20, 1 << 18
#: Texts that the borders are taken from, and paths for each border (which the driver holds for a moment).
SAMPLE_TEXTS, SAMPLE_PATHS = 4000, 48
#: Buckets of a part in the first round of the report, each of which keeps as many rows as the report has.
BUCKETS = 64

BREAK = b"\xff"  # no byte of UTF-8
_TABLE = bytes(0xFF if chr(i) in ".,;:!?\n\x0b\x0c\r" else i for i in range(256))


def _slices(text: bytes) -> Iterator[bytes]:
    """The lower-cased text with its separators marked, in slices of whole pieces; zero bytes are written as two others."""
    text = text.lower().translate(_TABLE)
    if b"\x00" in text or b"\x01" in text:
        text = _escaped(text)
    start = 0
    while len(text) - start > SLICE:
        end = text.rfind(BREAK, start, start + SLICE)
        end = text.find(BREAK, start + SLICE) if end <= start else end
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def _escaped(text: bytes) -> bytes:
    """The same order of bytes without a zero byte."""
    return text.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")


def _plain(text: bytes) -> str:
    return text.replace(b"\x01\x01", b"\x00").replace(b"\x01\x02", b"\x01").decode("utf-8", "replace") if b"\x01" in text else text.decode("utf-8", "replace")


class _Words(dict):
    """Word -> number, in order of first sight; a break is 0."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def build(ids: np.ndarray, size: int, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The trie's levels: (parent, word, n) of their nodes in order of (parent, word).

    ids are ranks of words from 1 to size - 1, with 0 between pieces.  Parents
    are places in the level above, from 0; the first level's parent is the root.
    """
    n = np.bincount(ids, minlength=size)[1:]
    words = np.flatnonzero(n)
    place = np.zeros(size, np.int64)
    place[words + 1] = np.arange(1, len(words) + 1)
    levels = [(np.zeros(len(words), np.int64), words + 1, n[words])]
    node = place[ids]  # of the run that starts here, from 1; 0 where there is none of this length
    for level in range(1, depth):
        node, after = node[: len(ids) - level], ids[level:]
        alive = np.flatnonzero((node != 0) & (after != 0))
        found, at, n = np.unique((node[alive] - 1) * size + after[alive], return_inverse=True, return_counts=True)
        levels.append((found // size, found % size, n))
        node = np.zeros_like(node)
        node[alive] = at + 1
    return levels


def serialised(ids: np.ndarray, size: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The trie in depth-first order: ranks of each path's words (0 behind its end) and occurrences; the root is first."""
    levels = build(ids, size, depth)
    sizes = [np.ones(len(n), np.int64) for _, _, n in levels]
    for k in range(len(levels) - 1, 0, -1):
        np.add.at(sizes[k - 1], levels[k][0], sizes[k])
    rows = 1 + sum(len(n) for _, _, n in levels)
    paths, counts = np.zeros((rows, depth), np.int64, order="F"), np.zeros(rows, np.int64)
    counts[0] = np.count_nonzero(ids)
    above = np.zeros(1, np.int64)  # places of the level above
    for k, ((parent, word, n), size_of) in enumerate(zip(levels, sizes)):
        before = np.cumsum(size_of) - size_of
        place = above[parent] + 1 + before - before[np.searchsorted(parent, parent)]
        paths[place, :k] = paths[above[parent], :k]
        paths[place, k], counts[place] = word, n
        above = place
    return paths, counts


def _cut(paths: np.ndarray, words: list[bytes], border: tuple[bytes, ...]) -> int:
    """The first row of a serialised trie that isn't before the border; words[r] has the rank r."""
    low, high = 0, len(paths)
    for k, word in enumerate(border):
        rank = bisect_left(words, word, 1)
        column = paths[low:high, k]
        if rank == len(words) or words[rank] != word:
            return low + int(np.searchsorted(column, rank))
        low, high = low + int(np.searchsorted(column, rank)), low + int(np.searchsorted(column, rank, "right"))
    return low


_ZSTD = "zstd"


def encode(paths: np.ndarray, n: np.ndarray, words: list[bytes]) -> bytes:
    """Rows of a serialised trie with the words they need."""
    used = np.unique(paths)
    used = used[used > 0]
    codes = np.where(paths > 0, np.searchsorted(used, paths) + 1, 0).astype(np.min_scalar_type(len(used) + 1))
    counts = n.astype(np.min_scalar_type(int(n.max())))
    vocabulary = b"\x00".join(words[r] for r in used.tolist())
    body = codes.T.tobytes() + counts.tobytes() + vocabulary
    head = np.array([len(n), codes.itemsize, counts.itemsize, len(body)], "<i8").tobytes()
    return head + pa.compress(body, _ZSTD, asbytes=True)


def decode(blob: bytes, depth: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Paths, whose ranks are places in the words from 1, occurrences and words."""
    rows, width, count_width, size = np.frombuffer(blob, "<i8", 4).tolist()
    body = pa.decompress(blob[32:], size, _ZSTD, asbytes=True)
    end = rows * depth * width
    paths = np.frombuffer(body, f"u{width}", rows * depth).reshape(depth, rows).T.astype(np.int64)
    n = np.frombuffer(body, f"u{count_width}", rows, end).astype(np.int64)
    words = body[end + rows * count_width :]
    return paths, n, words.split(b"\x00") if words else []


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[bytes], dict[bytes, np.ndarray]]]:
    """Sorted words (the first place is empty) and each part's ranks, for every so many words."""

    def ranked(words: _Words, parts: dict[bytes, list]) -> tuple[list[bytes], dict[bytes, np.ndarray]]:
        named = list(words)[1:]
        order = sorted(range(len(named)), key=named.__getitem__)
        rank = np.zeros(len(words), np.int64)
        rank[np.array(order, np.int64) + 1] = np.arange(1, len(words))
        return [b"", *(named[i] for i in order)], {p: rank[np.concatenate(parts[p])] for p in sorted(parts)}

    words, parts, held = _Words(), {}, 0
    for batch in batches:
        named = [_escaped(p.encode()) for p in batch.column("part").to_pylist()]
        for part, text in zip(named, batch.column("text")):
            for piece in _slices(text.cast(pa.binary()).as_py()):
                tokens = piece.replace(BREAK, b" \xff ").split()
                tokens.append(BREAK)
                parts.setdefault(part, []).append(np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens)))
                held += len(tokens)
                if held >= limit:
                    yield ranked(words, parts)
                    words, parts, held = _Words(), {}, 0
    if parts:
        yield ranked(words, parts)


def _tries(depth: int, limit: int, borders: list[tuple[bytes, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, parts in _shards(batches, limit):
            for part, ids in parts.items():
                paths, n = serialised(ids, len(words), depth)
                first, end = bisect_left(borders, (part,)), bisect_left(borders, (part + b"\x00",))
                cuts = [0, *(_cut(paths, words, border[1:]) for border in borders[first:end]), len(n)]
                named, blobs = [], []
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    if a < b:
                        named.append(first + k)
                        blobs.append(encode(paths[a:b], n[a:b], words))
                    if blobs and (len(blobs) == 1024 or b == len(n)):
                        yield pa.RecordBatch.from_pydict({"pid": pa.array(named, pa.int32()), "part": pa.array([part] * len(blobs), pa.binary()), "blob": pa.array(blobs, pa.binary())})
                        named, blobs = [], []

    return run


def _sampled(depth: int, share: float):
    """Paths of some positions of the given texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        for words, parts in _shards(batches, SHARD_WORDS):
            rows = []
            for part, ids in parts.items():
                for i in np.flatnonzero((ids != 0) & (rng.random(len(ids)) < share)).tolist():
                    run_ids = ids[i : i + depth].tolist()
                    run_ids = run_ids[: run_ids.index(0)] if 0 in run_ids else run_ids
                    rows.append([part, *(words[r] for r in run_ids)])
            yield pa.RecordBatch.from_pydict({"path": pa.array(rows, pa.list_(pa.binary()))})

    return run


def _borders(rows: DataFrame, depth: int) -> list[tuple[bytes, ...]]:
    """Distinct paths of a bounded sample at equal distances, one fewer than ranges."""
    total = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    nodes = (total.size or 0) // 4  # a node for each word or a little more
    ranges = min(MOST_RANGES, nodes // RANGE_NODES + 1)
    if ranges < 2:
        return []
    fraction = min(1.0, SAMPLE_TEXTS / total.n)
    share = min(1.0, SAMPLE_PATHS * ranges / (fraction * nodes))
    found = rows.sample(fraction, seed=7).mapInArrow(_sampled(depth, share), "path array<binary>").collect()  # SAMPLE_PATHS * ranges rows or so
    paths = sorted({tuple(map(bytes, r.path)) for r in found})
    return sorted({paths[len(paths) * k // ranges] for k in range(1, ranges)}) if paths else []


def _merged(blobs: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Serialised tries of one part and range -> one of distinct paths in order."""
    decoded = [decode(b, depth) for b in blobs]
    words = sorted(set().union(*(w for _, _, w in decoded)))
    rank = {w: i for i, w in enumerate(words, 1)}
    paths = np.concatenate([np.concatenate([[0], np.fromiter(map(rank.__getitem__, w), np.int64, len(w))])[p] for p, _, w in decoded])
    n = np.concatenate([n for _, n, _ in decoded])
    if (len(words) + 1) ** depth < 1 << 62:
        key = paths[:, 0]
        for k in range(1, depth):
            key = key * (len(words) + 1) + paths[:, k]
        order = np.argsort(key, kind="stable")
        changed = np.diff(key[order]) != 0
    else:
        order = np.lexsort(paths.T[::-1])
        changed = (np.diff(paths[order], axis=0) != 0).any(axis=1)
    starts = np.flatnonzero(np.concatenate([[True], changed]))
    return paths[order[starts]], np.add.reduceat(n[order], starts), words


def _walk(depth: int, least: int):
    """Merges each range and gives its frequent nodes their ancestors' counts, -1 where they lie in an earlier range."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[bytes, list[bytes]]]]:
        held, parts = None, {}
        for batch in batches:
            for pid, part, blob in zip(*(batch.column(c).to_pylist() for c in ("pid", "part", "blob"))):
                if pid != held and parts:
                    yield held, parts
                    parts = {}
                held = pid
                parts.setdefault(part, []).append(blob)
        if parts:
            yield held, parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pid, parts in ranges(batches):
            seen = 0
            for part in sorted(parts):
                paths, n, words = _merged(parts.pop(part), depth)
                level = np.count_nonzero(paths, axis=1)
                here = np.arange(len(n))
                left = np.empty((len(n), depth), np.int64)
                for k in range(depth):
                    at = np.maximum.accumulate(np.where(level == k, here, -1))
                    left[:, k] = np.where(at >= 0, n[at], -1)
                keep = np.flatnonzero((n >= least) | (level == 0))
                levels, lefts = level[keep].tolist(), left[keep].tolist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([_plain(part)] * len(keep), pa.string()),
                        "phrase": pa.array([_plain(b" ".join(words[r - 1] for r in p[:k])) for p, k in zip(paths[keep].tolist(), levels)], pa.string()),
                        "depth": pa.array(levels, pa.int32()),
                        "a": pa.array(n[keep]),
                        "lefts": pa.array([[x if x >= 0 else None for x in row[:k]] for row, k in zip(lefts, levels)], pa.list_(pa.int64())),
                        "pid": pa.array([pid] * len(keep), pa.int32()),
                        "seq": pa.array(keep + seen),
                    }
                )
                seen += len(n)

    return run


NODES = "part string, phrase string, depth int, a long, lefts array<long>, pid int, seq long"


def nodes(docs: DataFrame, max_words: int = 3, min_count: int = 10, text: str = "text", part: str = "lang") -> DataFrame:
    """(part, phrase, depth, a, lefts) of every run of words with at least min_count occurrences, and each part's root.  Staged.

    lefts[k] is the count of the first k words, lefts[0] that of all words of
    the part.  What is pruned has fewer occurrences than any of its longer runs
    could reach, so every ancestor of a kept node is kept.
    """
    store.small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("und")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tries = rows.mapInArrow(_tries(max_words, SHARD_WORDS, _borders(rows, max_words)), "pid int, part binary, blob binary")
    walked = store.stage(tries.repartition("pid").sortWithinPartitions("pid").mapInArrow(_walk(max_words, min_count), NODES), "trie-nodes")
    # One row for each range: the last node of every depth; a range takes them from the ranges before it.
    ends = walked.groupBy("pid").agg(*[F.max(F.when(F.col("depth") == k, F.struct("seq", "a")))["a"].alias(f"end{k}") for k in range(max_words)])
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("pid", F.array(*[F.last(f"end{k}", ignorenulls=True).over(before) for k in range(max_words)]).alias("ends"))
    whole = walked.join(F.broadcast(ends), "pid")  # as many rows as ranges, MOST_RANGES at most
    return whole.select("part", "phrase", "depth", "a", F.transform("lefts", lambda x, k: F.coalesce(x, F.get("ends", k))).alias("lefts"))


def candidates(found: DataFrame, max_words: int = 3, min_count: int = 10) -> DataFrame:
    """(part, phrase, depth, a, l, r, n, score) of the runs of two words and more, at the lowest-scoring cut.

    The suffix links of one depth are a join with the depth below on part and
    all words but the first.
    """
    rest = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    below, out = None, None
    for depth in range(1, max_words + 1):
        level = found.where(F.col("depth") == depth)
        if depth == 1:
            level = level.withColumn("rights", F.expr("cast(array() as array<bigint>)"))
        else:
            links = below.select("part", F.col("phrase").alias("_suffix"), F.concat(F.array("a"), "rights").alias("rights"))
            level = level.withColumn("_suffix", rest).join(links, ["part", "_suffix"]).drop("_suffix")
            out = level if out is None else out.unionByName(level)
        below = level
    out = out.where(F.col("a") >= min_count)
    # 38 digits hold 1000000 * a * a for up to 10^16 occurrences.
    score = "cast(1000000 * cast(a as decimal(20,0)) * cast(a as decimal(20,0)) div (cast(lefts[k] as decimal(20,0)) * cast(rights[k - 1] as decimal(20,0))) as bigint)"
    cut = F.expr(f"array_min(transform(sequence(1, depth - 1), k -> struct({score} as score, k as k, lefts[k] as l, rights[k - 1] as r)))")
    out = out.withColumn("_cut", cut)
    return out.select("part", "phrase", "depth", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.get("lefts", F.lit(0)).alias("n"), F.col("_cut.score").alias("score"))


def without_fragments(rows: DataFrame, percent: int = 50) -> DataFrame:
    """Candidates but those inside a longer candidate, dropped or not, that has at least so many per cent of their occurrences."""
    words = F.split("phrase", " ")
    inner = rows.where("depth > 2").select("part", "a", "depth", words.alias("w"))
    inner = inner.select("part", "a", F.explode(F.expr("flatten(transform(sequence(2, depth - 1), k -> transform(sequence(1, depth - k + 1), i -> array_join(slice(w, i, k), ' '))))")).alias("phrase"))
    longest = inner.groupBy("part", "phrase").agg(F.max("a").alias("_longer"))
    kept = rows.join(longest, ["part", "phrase"], "left")
    return kept.where(F.col("_longer").isNull() | (100 * F.col("_longer") < percent * F.col("a"))).drop("_longer")


def report(rows: DataFrame, top: int = 2000) -> DataFrame:
    """The first rows of each part by score, occurrences and phrase.

    Two rounds: buckets of a part keep as many rows as the report has, and the
    part ranks what is left, so that no task sorts a whole part.  If every bucket
    has so many rows that together they fill the report, nothing below the
    least score of these is in it, and the second round leaves that out.
    """
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)).cast("long")
    first = rows.withColumn("_b", bucket).withColumn("_r", F.row_number().over(Window.partitionBy("part", "_b").orderBy(*order))).where(F.col("_r") <= top)
    share = -(-top // BUCKETS)
    full = first.where(F.col("_r") == share).groupBy("part").agg(F.min("score").alias("_least"), F.count("*").alias("_n")).where(F.col("_n") == BUCKETS)
    # The bound goes to every bucket, so that a part's rows stay where they are.
    bound = full.select("part", "_least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BUCKETS - 1).cast("long"))).alias("_b"))
    first = first.join(bound, ["part", "_b"], "left").where(F.col("_least").isNull() | (F.col("score") >= F.col("_least"))).drop("_least")
    return first.drop("_b", "_r").withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def mine(docs: DataFrame, max_words: int = 3, min_count: int = 10, percent: int = 50, top: int = 2000, text: str = "text", part: str = "lang") -> DataFrame:
    """(part, rank, phrase, a, l, r, n, score): each part's collocations of two to max_words words.

    A null text is empty, a null part is ``und``; rows that repeat count again;
    equal scores and counts are ordered by the phrase's bytes; very long texts
    are read in slices of whole pieces; a piece without any separator is held
    whole.  An empty table, or one without a frequent phrase, gives no rows.
    Other columns are dropped first, so that their names cannot clash.
    """
    found = nodes(docs, max_words, min_count, text, part)
    kept = without_fragments(candidates(found, max_words, min_count), percent)
    return report(kept, top).select("part", "rank", "phrase", "a", "l", "r", "n", "score")
