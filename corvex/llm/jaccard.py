"""Jaccard join of word n-grams with multiple-global-order filtering.

Two documents whose sets overlap enough share a token among the first few of
either set under any one order of all tokens.  The first order puts frequent
tokens last (by counts over the whole corpus, gathered exactly enough to tell
frequent tokens from others) and finds the candidates: documents that share a
prefix token.  Sizes and the parity bitmaps of the sets prune them inside the
token's group, as does the token's place: a link shows in the group of the first
token that its documents share.  Pairs that are left must also share prefix tokens under further
orders (the same classes of frequency, other permutations inside them), and
those that do are verified on the whole sets.

Only the components of the link graph are asked for, so a group of n near copies
need not yield its n * n pairs.  The first round verifies each document's least
candidate, the second one a spanning forest between the components found so far,
the third one a pair for each two components that meet in a group, and the last
one every candidate pair that still lies between two components.  No
link that joins components can be missed: any link is a candidate pair, and in the
end each candidate pair either lies inside one component or has been verified.

The group of a frequent token is dealt in blocks of about ``GROUP_ROWS`` nodes,
each of which finds its own forest; the second round joins one representative of
each label, and the others compare those that are not of the token's largest
label with the nodes of every block, which is exact.  Two large components that
many links join yield one pair a block in the third round, and are one component
in the last.

Documents with equal sets are one node from the start.  Candidates come from one
hash of the words' bytes, verification counts common tokens by another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvex.llm import store
from corvex.llm.components import components
from corvex.llm.wordhash import SortedKeys, U, Words, chunks, combine, lean, lists, mix

#: Bits of a set's parity bitmap at least.
LEAST_BITS = 512
#: Wanted keys for which a filter of hashes is broadcast; for more of them rows are joined without it.
FILTER_KEYS = 1 << 20
#: Nodes of a token's group that one task takes at a time.
GROUP_ROWS = 512
#: Orders after the first.
MORE_ORDERS = (101, 102)
#: A token counts as frequent from this share of documents on, and from this number on at least.
FREQUENT_SHARE, FREQUENT_LEAST = 5e-5, 16
#: A task reports tokens that this many of its documents have; how many tokens it holds before it drops the single ones.
REPORT_LEAST, HELD_TOKENS = 4, 1_000_000
#: Frequent tokens that are broadcast at most; if there are more, those of the lower classes count as not frequent.
MOST_FREQUENT = 1 << 20


def token_sets(words: Words, shingle: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct tokens of each document in rising order, offsets).

    A token is the hash of ``shingle`` words; a document with fewer words has
    the hash of all its words as its only token, one without words has none.
    Hashes stand for those of the words, if given.
    """
    hashes = words.hash if hashes is None else hashes
    first, grams = words.first, combine(hashes, shingle)
    sizes = np.diff(first)
    parts, ends = [], np.zeros(len(sizes) + 1, dtype=np.int64)
    for i, n in enumerate(sizes.tolist()):
        if n >= shingle:
            s = np.sort(grams[first[i] : first[i] + n - shingle + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif n:
            s = mix(_short_token(hashes[first[i] : first[i] + n]), n)
        else:
            s = grams[:0]
        parts.append(s)
        ends[i + 1] = ends[i] + len(s)
    return np.concatenate([np.zeros(0, dtype=U), *parts]), ends


def _short_token(hashes: np.ndarray) -> np.ndarray:
    """One hash of a short run of word hashes."""
    total = U(0)
    with np.errstate(over="ignore"):
        for k, h in enumerate(hashes):
            total = total * U(0x9FB21C651E98DF25) + h + U(k)
    return np.array([total], dtype=U)


def prefix_size(n: int, percent: int) -> int:
    """Tokens of a set of n of which a set with enough overlap must have one."""
    return n - -(-percent * n // 100) + 1


class _Order:
    """Frequency classes of tokens: 0 for tokens that aren't frequent, else one more than log2 of the count."""

    def __init__(self, tokens: np.ndarray, classes: np.ndarray) -> None:
        self.keys = SortedKeys(tokens, classes)

    def places(self, tokens: np.ndarray, seed: int) -> np.ndarray:
        """Sort keys: the class in the top 8 bits, then a permutation."""
        classes = np.maximum(self.keys.find(tokens)[0], 0).astype(U)
        return classes << U(56) | mix(tokens, seed) >> U(8)


def _text(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    return docs.select(*more, docs[text].cast("binary").alias("_text"))


def frequent_tokens(docs: DataFrame, shingle: int, text: str = "text") -> _Order:
    """Frequent tokens of all documents.

    The order only steers the work; any order gives the same links.  The table
    is bounded by MOST_FREQUENT: the least class of counts that it takes in
    rises until it fits.
    """
    least = max(FREQUENT_LEAST, int(docs.count() * FREQUENT_SHARE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
        held: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(held), return_counts=True) if held else (tokens[:0], counts[:0])
            both, at = np.unique(np.concatenate([tokens, new]), return_inverse=True)
            total = np.bincount(at, np.concatenate([counts, n]), len(both)).astype(np.int64)
            keep = total > 1 if len(both) > HELD_TOKENS else slice(None)
            return both[keep], total[keep]

        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                held.append(token_sets(Words(data, offsets, lower=True), shingle)[0])
                if sum(map(len, held)) > HELD_TOKENS // 4:
                    tokens, counts = merged()
                    held = []
        tokens, counts = merged()
        keep = counts >= REPORT_LEAST
        yield pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep])], ["token", "n"])

    found = _text(docs, text).mapInArrow(lean(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    scratch = store.Scratch(docs.sparkSession)
    found = scratch.stage(found.withColumn("class", F.floor(F.log2("n")).cast("int")), "frequent")
    sizes, lowest, total = dict(found.groupBy("class").count().collect()), 64, 0
    for c in sorted(sizes, reverse=True):
        total += sizes[c]
        if total > MOST_FREQUENT:
            break
        lowest = c
    table = found.where(F.col("class") >= lowest).toArrow()
    scratch.drop_all()
    return _Order(table["token"].to_numpy().view(U), 1 + table["class"].to_numpy().astype(np.int64))


def prefixes(docs: DataFrame, order: _Order, shingle: int, percent: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """_key, mark (hash of the text), n (tokens), node (hash of the set, null if empty), bitmap and prefix (sort keys under the first order).

    Bitmap and prefix are null where the task has met the same set before.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column(2)):
                tokens, ends = token_sets(Words(data, offsets, lower=True), shingle)
                node, sizes = node_ids(tokens, ends), np.diff(ends)
                places = order.places(tokens, 0)
                parts, bound, valid, bits = [], [0], [], []
                for i, (a, n, name) in enumerate(zip(ends[:-1].tolist(), sizes.tolist(), node.tolist(), strict=True)):
                    fresh = n > 0 and name not in seen
                    if fresh:
                        if len(seen) > 1_000_000:
                            seen.clear()
                        seen.add(name)
                        parts.append(np.sort(places[a : ends[i + 1]])[: prefix_size(n, percent)])
                    bits.append(parity_bitmap(tokens[a : ends[i + 1]], percent) if fresh else None)
                    valid.append(fresh)
                    bound.append(bound[-1] + (len(parts[-1]) if fresh else 0))
                flat = np.concatenate([np.zeros(0, dtype=U), *parts]).view(np.int64)
                prefix = pa.ListArray.from_arrays(pa.array(np.array(bound, dtype=np.int32)), pa.array(flat), mask=pa.array(~np.array(valid, dtype=bool)))
                columns = [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(sizes), pa.array(node, mask=sizes == 0), pa.array(bits, pa.binary()), prefix]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "mark", "n", "node", "bitmap", "prefix"])

    rows = _text(docs, text, docs[key].alias("_key"), _mark(docs[text]).alias("mark"))
    return rows.mapInArrow(lean(run), f"_key {rows.schema['_key'].dataType.simpleString()}, mark long, n long, node long, bitmap binary, prefix array<long>")


def node_ids(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[U(0)], np.cumsum(mix(tokens, 21), dtype=U)])
        return mix(sums[ends[1:]] - sums[ends[:-1]] + np.diff(ends).astype(U), 22).view(np.int64)


def parity_bitmap(tokens: np.ndarray, percent: int) -> bytes:
    """Bit i is the parity of the tokens that hash to i: two bitmaps differ in at most as many bits as the sets in tokens.

    The bits are a power of two and twice as many as the tokens in which two
    sets of this size may differ, so that unrelated sets differ in more.
    """
    need = 4 * len(tokens) * (100 - percent) // (100 + percent)
    bits = max(LEAST_BITS, 1 << (need - 1).bit_length() if need > 1 else 1)
    odd = np.bincount((mix(tokens, 77) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Bitmaps:
    """The bitmaps of a token group; one of more bits is folded by exclusive or to be compared with one of fewer."""

    def __init__(self, raw: list[bytes]) -> None:
        self.width = np.array([len(r) // 8 for r in raw])
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        widths = np.unique(self.width)
        for w in widths.tolist():
            place, rows = np.full(len(raw), -1), []
            n = 0
            for v in widths[widths >= w].tolist():
                own = np.flatnonzero(self.width == v)
                matrix = np.frombuffer(b"".join([raw[i] for i in own]), dtype=np.uint64).reshape(len(own), v // w, w)
                rows.append(np.bitwise_xor.reduce(matrix, axis=1))
                place[own] = n + np.arange(len(own))
                n += len(own)
            self.levels[w] = place, np.concatenate(rows)

    def differ(self, one: int, others: np.ndarray) -> np.ndarray:
        """Bits in which one and each of the others differ."""
        out, level = np.zeros(len(others), dtype=np.int64), np.minimum(self.width[others], self.width[one])
        for w in np.unique(level).tolist():
            place, matrix = self.levels[w]
            part = level == w
            out[part] = np.bitwise_count(matrix[place[others[part]]] ^ matrix[place[one]]).sum(axis=1, dtype=np.int64)
        return out


class Group:
    """The documents that share a prefix token: nodes, set sizes, the token's place in each order, bitmaps, labels."""

    def __init__(self, node: np.ndarray, n: np.ndarray, place: np.ndarray, raw: list[bytes], label: np.ndarray, percent: int) -> None:
        self.node, self.n, self.rest, self.label, self.percent = node, n, n - place, label, percent
        self.raw, self.bitmaps = raw, None
        #: Which nodes come from other blocks of the token.
        self.sent = np.zeros(len(node), dtype=bool)

    def passes(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of the others may be similar enough to one.

        By size; by the tokens from this one on, if it is the first that the
        two share (a link is found in the group of its first token); by bitmap.
        """
        size, mine, total = self.n[others], self.n[one], 100 + self.percent
        both = size + mine
        fits = 100 * np.minimum(size, mine) >= self.percent * np.maximum(size, mine)
        fits &= np.minimum(self.rest[others], self.rest[one]) * total >= self.percent * both
        index = np.flatnonzero(fits)
        if len(index):
            if self.bitmaps is None:
                self.bitmaps = Bitmaps(self.raw)
            fits[index] = self.bitmaps.differ(one, others[index]) * total <= both[index] * (100 - self.percent)
        return fits

    def pair(self) -> list[tuple[int, int]]:
        """The edge of a group of two, without arrays."""
        (a, b), (x, y), (r, q) = self.n.tolist(), self.raw, self.rest.tolist()
        total, both = 100 + self.percent, a + b
        if self.label[0] == self.label[1] or 100 * min(a, b) < self.percent * max(a, b) or min(r, q) * total < self.percent * both:
            return []
        if len(x) == len(y):
            differ = (int.from_bytes(x, "little") ^ int.from_bytes(y, "little")).bit_count()
        else:
            differ = int(Bitmaps(self.raw).differ(0, np.array([1]))[0])
        return [(int(self.node[0]), int(self.node[1]))] if differ * total <= both * (100 - self.percent) else []


def survivor_sets(docs: DataFrame, wanted: DataFrame, order: _Order, shingle: int, percent: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """node, tokens (by the second hash; rising, little-endian) and the prefixes under further orders, of the wanted (node, _key).

    A node is there more than once if its key's row repeats.
    """
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column(1)):
                words = Words(data, offsets, lower=True)
                tokens, ends = token_sets(words, shingle)
                # Another row may have the same key: its set is not the wanted one.
                right = node_ids(tokens, ends) == batch.column(0).slice(low, high - low).to_numpy()
                index = np.flatnonzero(right)
                if not len(index):
                    continue
                sets = [tokens[ends[i] : ends[i + 1]] for i in index]
                others, bounds = token_sets(words, shingle, words.second())
                others = [others[bounds[i] : bounds[i + 1]] for i in index]
                more = []
                for seed in MORE_ORDERS:
                    more.append([np.sort(order.places(s, seed))[: prefix_size(len(s), percent)].view(np.int64) for s in sets])
                listed = lambda xs: lists(np.concatenate(xs), np.concatenate([[0], np.cumsum([len(x) for x in xs])]), pa.int64())
                columns = [batch.column(0).slice(low, high - low).take(pa.array(index)), pa.array([s.tobytes() for s in others], pa.binary()), *map(listed, more)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "tokens", *[f"prefix{i}" for i in range(len(more))]])

    rows = near_keys(_text(docs, text, docs[key].alias("k")), "k", wanted, "_key")
    rows = rows.join(wanted, F.col("k").eqNullSafe(F.col("_key"))).select("node", "_text")
    schema = "node long, tokens binary, " + ", ".join(f"prefix{i} array<long>" for i in range(len(MORE_ORDERS)))
    return rows.mapInArrow(lean(run), schema)


def near_keys(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, how: str = "left_semi") -> DataFrame:
    """Rows whose key may be wanted, by a hash of it; with how = "left_anti" those whose key is surely not wanted.

    It only spares texts an exchange before the join that decides.  What is
    broadcast is at most FILTER_KEYS numbers; for more wanted keys any row may
    be wanted.  wanted should be staged, as it is counted.
    """
    n = wanted.count()
    if n > FILTER_KEYS:
        return rows if how == "left_semi" else rows.limit(0)
    slots = 1 << max(10, (16 * n).bit_length())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    hashes = wanted.select(place(wanted_key).alias("_at")).distinct()
    return rows.join(F.broadcast(hashes), place(rows[key]) == hashes["_at"], how)


def forest(group: Group) -> list[tuple[int, int]]:
    """Edges that join each component of a token group's candidate graph; documents of one label are joined already."""
    node = group.node
    label = np.unique(group.label, return_inverse=True)[1]
    members = np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label))[:-1])
    left, edges = np.arange(len(node)), []
    while len(left):
        front = members[label[left[0]]].tolist()
        left = left[label[left] != label[left[0]]]
        while front and len(left):
            one = front.pop()
            found = left[group.passes(one, left)]
            if len(found):
                first = np.unique(label[found], return_index=True)[1]
                edges += [(node[one], node[x]) for x in found[first]]
                reached = np.unique(label[found])
                left = left[~np.isin(label[left], reached)]
                front += [x for k in reached for x in members[k].tolist()]
    return edges


def between(group: Group) -> list[tuple[int, int]]:
    """Candidate pairs of a token group whose documents have different labels."""
    names, inverse, counts = np.unique(group.label, return_inverse=True, return_counts=True)
    if len(names) == 1:
        return []
    rank, edges = np.argsort(np.argsort(counts, kind="stable")), []
    # Each pair is looked at from its label with fewer members.
    mine = rank[inverse]
    for one in np.flatnonzero(mine < len(names) - 1):
        others = np.flatnonzero(mine > mine[one])
        edges += [(group.node[one], group.node[x]) for x in others[group.passes(one, others)]]
    return edges


def across(group: Group) -> list[tuple[int, int]]:
    """Candidate pairs of the nodes that were sent to this block and its own nodes of other labels."""
    edges, own = [], np.flatnonzero(~group.sent)
    for one in np.flatnonzero(group.sent):
        others = own[group.label[own] != group.label[one]]
        edges += [(group.node[one], group.node[x]) for x in others[group.passes(one, others)]]
    return edges


def meeting(group: Group) -> list[tuple[int, int]]:
    """Of the pairs that across finds, one for each two labels."""
    edges, met, own = [], set(), np.flatnonzero(~group.sent)
    for one in np.flatnonzero(group.sent):
        mine = int(group.label[one])
        others = own[group.label[own] != mine]
        found = others[group.passes(one, others)]
        labels, first = np.unique(group.label[found], return_index=True)
        for label, x in zip(labels.tolist(), found[first].tolist(), strict=True):
            if (both := (min(mine, label), max(mine, label))) not in met:
                met.add(both)
                edges.append((group.node[one], group.node[x]))
    return edges


def blocks(token: Column) -> Column:
    """Blocks of a token's group, by the least count of its class."""
    least = F.pow(F.lit(2.0), F.shiftrightunsigned(token, 56) - 1)
    return F.greatest(F.lit(1), F.ceil(least / GROUP_ROWS)).cast("int")


def _by_token(entries: DataFrame, bits: DataFrame, choose, percent: int) -> DataFrame:  # noqa: ANN001
    """Distinct pairs (a < b, and their labels low < high) that choose finds in the groups of entries (token, salt, sent, node, n, place, label) with their bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: pa.Table) -> pa.RecordBatch:
            token, salt, sent, node, n, place, label = (rows.column(i).to_numpy() for i in (0, 1, 2, 3, 4, 5, 7))
            raw = rows.column(6).to_pylist()
            bound = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]), [True]]))
            found = set()
            for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                if b - a > 1:
                    group = Group(node[a:b], n[a:b], place[a:b], raw[a:b], label[a:b], percent)
                    group.sent = sent[a:b].astype(bool)
                    found.update((min(e), max(e)) for e in (group.pair() if b - a == 2 else choose(group)))
            ends = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
            known, first = np.unique(node, return_index=True)
            labels = np.sort(label[first[np.searchsorted(known, ends)]], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (*ends.T, *labels.T)], ["a", "b", "low", "high"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            token, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # The last group may go on in the next batch.
            low = int(np.searchsorted(token, token[-1]))
            at = low + int(np.searchsorted(salt[low:], salt[-1]))
            if at:
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = []
            elif held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (token[0], salt[0]):
                yield pairs(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(at))
        if held:
            yield pairs(pa.Table.from_batches(held))

    # Bitmaps come last, so that they are exchanged with a node and then once with each of its entries.
    rows = entries.join(bits, "node").select("token", "salt", "sent", "node", "n", "place", "bitmap", "label")
    rows = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "node")
    return rows.mapInArrow(lean(run), "a long, b long, low long, high long").distinct()


def _mixed(entries: DataFrame, scratch: store.Scratch) -> tuple[DataFrame, DataFrame]:
    """(entries of groups of several labels; those groups' tokens, staged)."""
    mixed = entries.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    mixed = scratch.stage(mixed, "mixed")
    return near_keys(entries, "token", mixed, "token").join(mixed, "token", "left_semi"), mixed


def _representatives(entries: DataFrame) -> DataFrame:
    """Of each label one node in each token's group, dealt in blocks by the number of labels."""
    first = entries.groupBy("token", "label").agg(F.min(F.struct("node", "n", "place")).alias("r"))
    counts = entries.groupBy("token").agg(F.approx_count_distinct("label").alias("labels"))
    first = first.join(counts, "token").withColumn("salt", F.pmod(F.xxhash64("label"), F.ceil(F.greatest(F.col("labels"), F.lit(1)) / (4 * GROUP_ROWS))).cast("int"))
    return first.select("token", "salt", F.lit(0).alias("sent"), "r.*", "label")


def _crossing(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of undivided groups; those of divided ones, with the nodes outside the group's largest label sent to every block)."""
    small, large = entries.where("blocks = 1"), entries.where("blocks > 1")
    counts = large.groupBy("token", "label").agg(F.count("*").alias("members"))
    largest = counts.groupBy("token").agg(F.max(F.struct("members", "label")).alias("top")).select("token", F.col("top.label").alias("largest"))
    large = large.join(largest, "token")
    sent = large.where("label <> largest").withColumn("sent", F.lit(1)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return small, large.unionByName(sent)


def verify(pairs: DataFrame, sets: DataFrame, percent: int, scratch: store.Scratch) -> DataFrame:
    """The pairs (a, b, low, high) that share prefix tokens under all further orders and whose whole sets are similar enough; staged."""
    more = [f"prefix{i}" for i in range(len(MORE_ORDERS))]
    ends = scratch.stage(pairs.select(F.col("a").alias("need")).unionByName(pairs.select(F.col("b").alias("need"))).distinct(), "ends")
    near = near_keys(sets, "node", ends, "need")
    light = near.select("node", *more)
    side = lambda rows, end: rows.select(*[F.col(c).alias(f"{end}_{c}" if c != "node" else end) for c in rows.columns])
    shared = F.lit(True)
    for c in more:
        shared = shared & F.arrays_overlap(f"a_{c}", f"b_{c}")
    kept = scratch.stage(pairs.join(side(light, "a"), "a").join(side(light, "b"), "b").where(shared).select("a", "b", "low", "high").distinct(), "candidates")
    whole = near.select("node", "tokens")
    rows = kept.join(side(whole, "a"), "a").join(side(whole, "b"), "b").select("a", "b", "low", "high", "a_tokens", "b_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=U) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(4)], ["a", "b", "low", "high"])

    out = scratch.stage(rows.mapInArrow(lean(run), "a long, b long, low long, high long").distinct(), "links")
    scratch.drop(ends, kept)
    return out


def _relabel(labels: DataFrame, links: DataFrame, scratch: store.Scratch) -> DataFrame:
    """(node, label) after links (low, high) between labels: a component's least node, staged.

    Only labels that a link joins are in the graph; what is joined already is
    one node of it.
    """
    roots = components(links, scratch, "low", "high")
    out = labels.join(roots.select(F.col("node").alias("label"), "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    out = scratch.stage(out, "labels")
    scratch.drop(roots)
    return out


def join(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", marks: bool = False, scratch: store.Scratch | None = None) -> DataFrame:
    """key, n_shingles and component_id of each document; with marks also mark, a hash of the text.

    Two documents link if 100 times the number of common shingles is at least
    ``percent`` times that of all of both; component_id is the least key that
    links reach.  Null text and text without words have an empty set, no links
    and their own key as component_id.  Rows that repeat are equal documents; a
    null key is never a component's least key unless all are null.  Other
    columns are dropped first.  Very long texts are hashed whole, one at a time.
    Tables that the result still reads are left to the scratch, if one is given.
    """
    store.small_batches(docs.sparkSession)
    scratch = scratch or store.Scratch(docs.sparkSession, collect=False)
    order = frequent_tokens(docs, shingle, text)
    rows = scratch.stage(prefixes(docs, order, shingle, percent, text, key), "prefixes")
    entries = rows.where("prefix is not null").select("node", "n", F.posexplode("prefix").alias("place", "token")).repartition("token").dropDuplicates()
    entries = entries.withColumn("blocks", blocks(F.col("token"))).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    near = Window.partitionBy("token", "salt").orderBy("n", "node")
    fits = lambda other: other.isNotNull() & (100 * F.least("n", other) >= percent * F.greatest("n", other))
    entries = entries.withColumns({"before": F.lag("n").over(near), "after": F.lead("n").over(near)})
    entries = entries.where((F.col("blocks") > 1) | fits(F.col("before")) | fits(F.col("after")))
    entries = scratch.stage(entries.select("token", "blocks", "salt", "node", "n", "place"), "shared-prefixes")
    bits = rows.where("prefix is not null").select("node", "bitmap").join(entries.select("node").distinct(), "node", "left_semi")
    bits = scratch.stage(bits.dropDuplicates(["node"]), "bitmaps")
    light = scratch.stage(rows.select("_key", "mark", "n", "node"), "keys")
    scratch.drop(rows)

    grouped = entries.withColumn("label", F.col("node")).withColumn("sent", F.lit(0))
    spanning = scratch.stage(_by_token(grouped, bits, forest, percent), "forest")
    # Sets are fetched for documents in candidate pairs only, and for those whose candidates may lie in other blocks.
    paired = spanning.select(F.col("a").alias("node")).unionByName(spanning.select(F.col("b").alias("node"))).unionByName(entries.where("blocks > 1").select("node"))
    paired = scratch.stage(paired.distinct(), "paired")
    light_entries = entries
    entries = scratch.stage(entries.join(paired, "node", "left_semi").withColumn("sent", F.lit(0)), "paired-prefixes")
    all_bits, bits = bits, scratch.stage(bits.join(paired, "node", "left_semi"), "paired-bitmaps")
    scratch.drop(light_entries, all_bits)
    wanted = light.where("node is not null").select("node", "_key").join(paired, "node", "left_semi").groupBy("node").agg(F.min("_key").alias("_key"))
    wanted = scratch.stage(wanted, "wanted")
    sets = scratch.stage(survivor_sets(docs, wanted, order, shingle, percent, text, key), "sets")
    # First each document with its least candidate, so that there are fewer pairs than documents.
    tried = scratch.stage(spanning.groupBy("b").agg(F.min("a").alias("a")).select("a", "b", F.col("a").alias("low"), F.col("b").alias("high")), "tried")
    scratch.drop(wanted, spanning)
    links = verify(tried, sets, percent, scratch)
    labels = _relabel(paired.withColumn("label", F.col("node")), links, scratch)
    tried = tried.select("a", "b")
    # Then what joins the components so far; in the end all that still lies between components.
    for turn in ("representatives", "labels", "last"):
        labelled, mixed = _mixed(entries.join(labels, "node"), scratch)
        if turn == "representatives":
            rest = _by_token(_representatives(labelled), bits, forest, percent)
        else:
            small, large = _crossing(labelled)
            inside, beyond = (between, across) if turn == "last" else (forest, meeting)
            rest = _by_token(small, bits, inside, percent).unionByName(_by_token(large, bits, beyond, percent)).distinct()
        rest = rest.join(tried, ["a", "b"], "left_anti")
        if turn == "representatives":
            rest = rest.groupBy("high").agg(F.min(F.struct("low", "a", "b")).alias("p")).select("p.a", "p.b", "p.low", "high")
        rest = scratch.stage(rest, "rest")
        scratch.drop(mixed)
        tried = tried.unionByName(rest.select("a", "b"))
        before, labels = labels, _relabel(labels, verify(rest, sets, percent, scratch), scratch)
        scratch.drop(before)

    # Least key of each node, then of each component.
    own = light.where("node is not null").groupBy("node").agg(F.min("_key").alias("own"))
    own = own.join(labels, "node", "left").select("node", "own", F.coalesce("label", "node").alias("root"))
    own = scratch.stage(own, "nodes")
    scratch.drop(*[t for t, _ in scratch.paths.values() if t is not own and t is not light])
    least = own.groupBy("root").agg(F.min("own").alias("component_id"))
    named = own.select("node", "root").join(least, "root").select("node", "component_id")
    out = light.select("_key", "n", "node", "mark").join(named, "node", "left")
    return out.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("_key")).otherwise(F.col("component_id")).alias("component_id"), *(["mark"] if marks else []))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The document with the least key of each component, with all its columns; of rows that repeat, one.

    Documents without words are in no group and stay.  A document without a key
    goes if it is linked with one that has a key.
    """
    scratch = store.Scratch(docs.sparkSession, collect=False)
    found = store.stage(join(docs.select(key, text), shingle, percent, text, key, marks=True, scratch=scratch), "classes")
    scratch.drop_all()
    facts = found.groupBy(F.col(key).alias("__k"), F.col("mark").alias("__m")).agg(F.count("*").alias("__n"), F.min("component_id").alias("__c"))
    facts = facts.select("__k", "__m", (~F.col("__c").eqNullSafe(F.col("__k"))).alias("__lost"), (F.col("__n") > 1).alias("__many")).where("__lost or __many")
    facts = store.stage(facts, "lost")
    # Only documents whose key may be among the facts are joined with them; the others' texts are not exchanged.
    clear, near = near_keys(docs, key, facts, "__k", "left_anti"), near_keys(docs, key, facts, "__k")
    own = near.select("*", _mark(near[text]).alias("__mark"))
    joined = own.join(facts, own[key].eqNullSafe(facts["__k"]) & (own["__mark"] == facts["__m"]), "left")
    kept = clear.unionByName(joined.where("__lost is null").select(*docs.columns))
    if facts.where("__many and not __lost").isEmpty():
        return kept
    return kept.unionByName(joined.where("__many and not __lost").dropDuplicates([key, "__mark"]).select(*docs.columns))


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))
