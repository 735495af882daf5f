"""Encoding and decoding with a SentencePiece vocabulary by batched Viterbi in numpy.

Distinct words of equal length advance together, one character at a time.  At
each end position the hashes of the substrings that end there are looked up
among the sorted piece keys; a path's score is the sum of its pieces' scores, or
minus infinity where two neighbours may not stand side by side, and the
vectorised maximum over lengths is stored as a backpointer.

The public vocabularies at hand are merge vocabularies, whose scores are merge
ranks and not log probabilities.  There, exactly one piece may follow the best
path of a prefix: a segmentation is the merge result if and only if no merge
across any of its borders would have come earlier than the merges around it.
That makes the maximum unique and the result equal to merging.

What follows depends on the last ``longest`` characters' states alone.  So a very
long word is cut into overlapping windows, which advance together like words of
equal length; a window whose states have not met its predecessor's by the end of
the overlap is run again from the predecessor's states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvex.llm.wordhash import KEPT, SortedKeys, U, _Powers, lean, mix

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Distinct words that a worker remembers, characters that it takes at a time.
CACHE_WORDS = 300_000
CHUNK_CHARS = 800_000
#: Slots (as powers of two) of the tables of words and of pairs of pieces.
WORD_BITS, PAIR_BITS = 20, 19
#: Characters of a word from which it is cut into windows, of the windows' steps and overlaps.
LONG_WORD, STEP, LAP = 4096, 1024, 128
#: Words of more characters than this are compared as such, not by their hash alone: their sums may cancel out.
HASHED_WORD = 32
#: Characters of equal words that one numpy pass takes.
PASS_CHARS = 1 << 17
_POWERS = _Powers(0xA0761D6478BD642F)
_CODE = np.random.default_rng(20240301).integers(1, 1 << 63, 0x110000, dtype=np.uint64)


class Vocabulary:
    """Pieces, their merge order, and a sorted table of their hashes."""

    def __init__(self, path: str = DEFAULT_MODEL) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        scores = np.array([model.get_score(i) for i in range(n)])
        self.byte_id = np.full(256, model.unk_id(), dtype=np.int64)
        for i in range(n):
            if model.is_byte(i):
                self.byte_id[int(self.pieces[i][3:5], 16)] = i
        self.size, self.unknown = n, model.unk_id()
        self.pair_tag, self.pair_good = np.full(1 << PAIR_BITS, -1, dtype=np.int64), np.zeros(1 << PAIR_BITS, dtype=bool)
        self.longest = max(len(p) for p, ok in zip(self.pieces, normal, strict=True) if ok)
        if any(SPACE in p.lstrip(SPACE) for p, ok in zip(self.pieces, normal, strict=True) if ok):
            raise ValueError("pieces that go beyond a word are not supported")
        order = np.unique(-scores, return_inverse=True)[1]
        ids = {p: i for i, p in enumerate(self.pieces) if normal[i]}
        #: Merge order (-1: a single character, there from the start) and the last merge's parts.
        self.rank = np.where([len(p) == 1 for p in self.pieces], -1, order).astype(np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        reachable = np.zeros(n, dtype=bool)
        for p, i in ids.items():
            if len(p) == 1:
                reachable[i] = True
            elif (parts := self._last_merge(p, ids)) is not None:
                self.left[i], self.right[i] = parts
                reachable[i] = True
        self.lengths = np.array([len(p) for p in self.pieces])
        #: Characters without a piece have the score after the last piece's.
        self.scores = np.append(scores, scores.min() - 1)
        self.key_of = np.zeros(n, dtype=U)
        for p, i in ids.items():
            self.key_of[i] = self._key(p)
        own = np.array(sorted(ids.values()))
        self.all_pieces = SortedKeys(self.key_of[own], own)
        # Every prefix of a piece that merging can make; -1 where the prefix is none itself.
        usable = {p: i for p, i in ids.items() if reachable[i]}
        prefixes = sorted({p[:k] for p in usable for k in range(1, len(p) + 1)})
        self.prefixes = SortedKeys(np.array([self._key(p) for p in prefixes], dtype=U), np.array([usable.get(p, -1) for p in prefixes]))
        # Which characters stand side by side in some piece: between others no merge is possible.
        pairs = {p[k : k + 2] for p in ids for k in range(len(p) - 1)}
        chars = sorted({c for p in pairs for c in p})
        self.char_class = np.zeros(0x110000, dtype=np.int16)
        self.char_class[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joins = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        for p in pairs:
            self.joins[self.char_class[ord(p[0])], self.char_class[ord(p[1])]] = True
        # Bytes of each piece, for decoding.
        raw = [b""] * n
        for i, p in enumerate(self.pieces):
            raw[i] = bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() if normal[i] else b""
        raw[self.unknown] = " ⁇ ".encode()
        self.raw_bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_length = np.array([len(r) for r in raw])
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length

    def _last_merge(self, piece: str, ids: dict[str, int]) -> tuple[int, int] | None:
        """The two parts that merging this piece's characters joins last; None if merging doesn't make it."""
        parts, last = list(piece), None
        while len(parts) > 1:
            ranks = [(self.rank[ids[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids]
            if not ranks:
                return None
            k = min(ranks)[1]
            last = parts[k], parts[k + 1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return ids.get(last[0], -1), ids.get(last[1], -1)

    @staticmethod
    def _key(piece: str) -> int:
        up, _ = _POWERS.upto(len(piece))
        with np.errstate(over="ignore"):
            return int((_CODE[[ord(c) for c in piece]] * up).sum(dtype=U))

    def _stands(self, pairs: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border inside each pair (a * 2**32 + b) of pieces.

        The last merges on either side are undone, latest first; the border
        falls if the pieces then beside it would merge before that.  Ids from
        ``size`` on stand for characters without a piece, which never merge.
        """
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        good = np.ones(len(pairs), dtype=bool)
        index = np.flatnonzero((a < self.size) & (b < self.size))
        a, b = a[index], b[index]
        limit = np.full(len(index), np.iinfo(np.int64).max)
        up, _ = _POWERS.upto(2 * self.longest)
        while len(index):
            with np.errstate(over="ignore"):
                joined = self.all_pieces.find(self.key_of[a] + self.key_of[b] * up[self.lengths[a]])[0]
            falls = (joined >= 0) & (self.rank[joined] < limit)
            good[index[falls]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~falls & ((ra >= 0) | (rb >= 0))
            index, a, b, ra, rb = index[on], a[on], b[on], ra[on], rb[on]
            undo = ra > rb
            limit = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return good

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may stand after piece a; answers are remembered in a table of fixed size."""
        pairs = a * (1 << 32) + b
        slot = (mix(pairs.view(U)) >> U(64 - PAIR_BITS)).astype(np.int64)
        new = np.flatnonzero(self.pair_tag[slot] != pairs)
        out = self.pair_good[slot]
        if len(new):
            fresh, at = np.unique(pairs[new], return_inverse=True)
            good = self._stands(fresh)
            out[new] = good[at]
            self.pair_tag[slot[new]], self.pair_good[slot[new]] = pairs[new], good[at]
            # Of two pairs that meet in one slot the tag is the last one's, and so must be the answer.
            clash = self.pair_tag[slot[new]] != pairs[new]
            self.pair_tag[slot[new][clash]] = -1
        return out

    def segment(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids of each word); a word is a slice of the code points."""
        order = np.argsort(length, kind="stable")
        sizes = length[order]
        parts, counts = [], np.zeros(len(start), dtype=np.int64)
        low = 0
        while low < len(order):
            size = int(sizes[low])
            if size > LONG_WORD:
                rows, high = order[low : low + 1], low + 1
                ids, counts[rows] = self._long(codes[start[rows[0]] : start[rows[0]] + size])
            else:
                high = min(int(np.searchsorted(sizes, size, side="right")), low + max(1, PASS_CHARS // size))
                rows = order[low:high]
                ids, counts[rows] = self._viterbi(codes[start[rows][:, None] + np.arange(size)])
            parts.append((rows, ids))
            low = high
        ends = np.cumsum(counts)
        flat = np.zeros(ends[-1] if len(ends) else 0, dtype=np.int32)
        for rows, ids in parts:
            n = counts[rows]
            flat[np.repeat(ends[rows] - n - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, counts

    def _states(self, codes: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(last piece of the best path to each place, its size) for rows of equal length.

        before holds the last pieces at the first places, if the rows go on from there.
        """
        n, length = codes.shape
        up, down = _POWERS.upto(length + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros((n, length + 1), dtype=U)
            np.cumsum(_CODE[codes] * up[:length], axis=1, out=sums[:, 1:])
        # Pieces by size: a start stays as long as what follows begins some piece.
        row, start = (x.ravel() for x in np.indices((n, length)))
        found: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(length + 1)]
        widest = min(length, self.longest)
        for size in range(1, widest + 1):
            keep = start + size <= length
            row, start = row[keep], start[keep]
            with np.errstate(over="ignore"):
                piece, known = self.prefixes.find((sums[row, start + size] - sums[row, start]) * down[start])
            if size == 1:
                piece = np.where(piece < 0, self.size + codes[row, start].astype(np.int64), piece)
            good = piece >= 0
            r, s, p = row[good], start[good], piece[good]
            by_end = np.argsort(s, kind="stable")
            bound = np.searchsorted(s[by_end], np.arange(length + 1))
            for first in range(length - size + 1):
                part = by_end[bound[first] : bound[first + 1]]
                if len(part):
                    found[first + size].append((r[part], s[part], p[part]))
            row, start = row[known], start[known]
            if not len(row):
                break
        last, back = np.full((n, length + 1), -1, dtype=np.int64), np.zeros((n, length + 1), dtype=np.int64)
        best = np.full((n, length + 1), -np.inf)
        known = 0 if before is None else before.shape[1] - 1
        best[:, 0] = 0.0
        if before is not None:
            last[:, : known + 1] = before
            best[:, : known + 1] = np.where(before >= 0, 0.0, -np.inf)
        every = np.arange(n)
        for end in range(known + 1, length + 1):
            r, s, p = (np.concatenate(x) for x in zip(*found[end], strict=True))
            score, left = best[r, s] + self.scores[np.minimum(p, self.size)], last[r, s]
            after = np.flatnonzero((left >= 0) & np.isfinite(score))
            score[after[~self.may_follow(left[after], p[after])]] = -np.inf
            by_size, pieces = np.full((n, widest), -np.inf), np.zeros((n, widest), dtype=np.int64)
            by_size[r, end - s - 1], pieces[r, end - s - 1] = score, p
            size = by_size.argmax(axis=1)
            best[:, end] = by_size[every, size]
            there = np.isfinite(best[:, end])
            last[there, end], back[there, end] = pieces[every, size][there], size[there] + 1
        return last, back

    def _viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids of each row) of words of equal length."""
        n, length = codes.shape
        last, back = self._states(codes)
        paths, at, every = [], np.full(n, length), np.arange(n)
        while (at > 0).any():
            paths.append(np.where(at > 0, last[every, at], -1))
            at = at - np.where(at > 0, back[every, at], 0)
        flat = np.stack(paths[::-1], axis=1)
        used = flat >= 0
        ids, counts = flat[used], used.sum(axis=1)
        if len(ids) and ids.max() >= self.size:
            ids, counts = self._with_bytes(ids, np.repeat(every, counts), n)
        return ids, counts

    def _long(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number) of one long word, by windows of STEP + LAP characters."""
        length, width = len(codes), STEP + LAP
        last, back = np.full(length + 1, -1, dtype=np.int32), np.zeros(length + 1, dtype=np.uint8)
        starts, rows = np.arange(0, length - LAP, STEP), max(1, PASS_CHARS // width)
        first = self._states(codes[None, :width])
        last[: width + 1], back[: width + 1] = first[0][0], first[1][0]
        for low in range(1, len(starts), rows):
            part = starts[low : low + rows]
            full = part[part + width <= length]
            states = [*zip(*self._states(codes[full[:, None] + np.arange(width)]), strict=True)] if len(full) else []
            states += [tuple(x[0] for x in self._states(codes[None, at:])) for at in part[len(full) :].tolist()]
            for at, (new, size) in zip(part.tolist(), states, strict=True):
                met = slice(LAP - self.longest, LAP + 1)
                if not (new[met] == last[at + met.start : at + met.stop]).all():
                    again = self._states(codes[None, at : at + width], last[None, at : at + LAP + 1].astype(np.int64))
                    new, size = again[0][0], again[1][0]
                to = at + len(new) - 1
                last[at + LAP + 1 : to + 1], back[at + LAP + 1 : to + 1] = new[LAP + 1 :], size[LAP + 1 :]
        ids, at, sizes, lasts = [], length, memoryview(back), memoryview(last)
        while at:
            ids.append(lasts[at])
            at -= sizes[at]
        ids = np.array(ids[::-1], dtype=np.int64)
        if ids.max() >= self.size:
            return self._with_bytes(ids, np.zeros(len(ids), dtype=np.int64), 1)
        return ids, np.array([len(ids)])

    def _with_bytes(self, ids: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their bytes."""
        code = np.maximum(ids - self.size, 0)
        width = np.where(ids < self.size, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        raw = np.frombuffer("".join(map(chr, code[ids >= self.size].tolist())).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        out = np.repeat(ids, width)
        out[out >= self.size] = self.byte_id[raw]
        return out, np.bincount(row, width, n).astype(np.int64)


class Coder:
    """Encodes and decodes lists of texts; remembers the words that it has met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.tag, self.word = np.zeros(1 << WORD_BITS, dtype=U), np.zeros(1 << WORD_BITS, dtype=np.int64)
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: Code points of the remembered words that are longer than HASHED_WORD.
        self.codes, self.code_start, self.code_length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Remembers new words with their ids."""
        flat, counts = self.vocabulary.segment(codes, start, length)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(counts) - counts])
        self.length = np.concatenate([self.length, counts])
        self.flat = np.concatenate([self.flat, flat])
        kept = np.where(length > HASHED_WORD, length, 0)
        ends = np.cumsum(kept)
        own = codes[np.repeat(start - ends + kept, kept) + np.arange(ends[-1])]
        self.code_start = np.concatenate([self.code_start, len(self.codes) + ends - kept])
        self.code_length = np.concatenate([self.code_length, length])
        self.codes = np.concatenate([self.codes, own])

    def _others(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The long words that differ from the remembered ones at their places: their hashes alone are equal."""
        long = np.flatnonzero(length > HASHED_WORD)
        same = [int(self.code_length[at[i]]) == int(length[i]) and np.array_equal(codes[start[i] : start[i] + length[i]], self.codes[(c := self.code_start[at[i]]) : c + length[i]]) for i in long.tolist()]
        return long[~np.array(same, dtype=bool)]

    def _units(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code points, start, length and hash of each unit, first unit of each text): no merge crosses a unit's ends."""
        v = self.vocabulary
        codes = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        codes[codes == 32] = ord(SPACE)
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 if t else 0 for t in texts])])
        n = len(codes)
        begins = np.ones(n, dtype=bool)
        kind = v.char_class[codes]
        begins[1:] = ~v.joins[kind[:-1], kind[1:]]
        inner = offsets[:-1]
        begins[inner[inner < n]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n)
        up, down = _POWERS.upto(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=U)
            np.cumsum(_CODE[codes] * up[:n], out=sums[1:])
            key = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U)) | U(1)
        return codes, start, end - start, key, np.searchsorted(start, offsets)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets); null and empty texts have none."""
        if not any(texts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        codes, start, length, key, first = self._units(texts)
        if len(self.start) > CACHE_WORDS or len(self.codes) > 8 * CACHE_WORDS:
            self._forget()
        slot = (key >> U(64 - WORD_BITS)).astype(np.int64)
        at = self.word[slot]
        new = np.flatnonzero(self.tag[slot] != key)
        if len(new):
            fresh, one, back = np.unique(key[new], return_index=True, return_inverse=True)
            known = len(self.start)
            self._add(codes, start[new[one]], length[new[one]])
            at[new] = known + back
            where = (fresh >> U(64 - WORD_BITS)).astype(np.int64)
            # One assignment of row numbers decides which of two words that meet in a slot has it.
            self.word[where] = known + np.arange(len(fresh))
            self.tag[where] = fresh[self.word[where] - known]
        if len(others := self._others(codes, start, length, at)):
            at[others] = len(self.start) + np.arange(len(others))
            self._add(codes, start[others], length[others])
        lengths = self.length[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(self.start[at] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids; the space that encoding puts first is taken off."""
        v = self.vocabulary
        lengths = v.raw_length[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        raw = v.raw_bytes[np.repeat(v.raw_start[ids] - ends[:-1], lengths) + np.arange(ends[-1])].tobytes()
        out = []
        for low, high in zip(ends[offsets[:-1]], ends[offsets[1:]], strict=True):
            piece = raw[low:high]
            out.append((piece[1:] if piece[:1] == b" " else piece).decode("utf-8", "replace"))
        return out


def coder(path: str = DEFAULT_MODEL) -> Coder:
    """The coder of a model file, made once in each worker; it stays until another operator's task comes."""
    if ("coder", path) not in KEPT:
        KEPT["coder", path] = Coder(Vocabulary(path))
    return KEPT["coder", path]


def slices(texts: list[str | None], size: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of rows of about ``size`` characters."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size or i == len(texts) - 1:
            yield at, i + 1
            at, total = i + 1, 0


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, token_ids and round_trip (whether decoding gives the text again).

    Null and empty text give no ids.  The space mark U+2581 in a text reads as
    a space, as in the public library, so that such a text does not come back
    whole (round_trip false).  Rows that repeat are coded one by one; other
    columns are dropped first; an empty table gives no rows.  A text, and a
    word of it, may be as long as a string can be: work grows in proportion.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in slices(texts):
                ids, offsets = code.encode(texts[low:high])
                same = [a == (b or "") for a, b in zip(code.decode(ids, offsets), texts[low:high], strict=True)]
                columns = [batch.column(0).slice(low, high - low), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "n_tokens", "token_ids", "round_trip"])

    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    out = rows.mapInArrow(lean(run, keeps=True), f"_key {rows.schema['_key'].dataType.simpleString()}, n_tokens long, token_ids array<int>, round_trip boolean")
    return out.withColumnRenamed("_key", key)


def decode(rows: DataFrame, model: str = DEFAULT_MODEL, ids: str = "token_ids", key: str = "doc_id") -> DataFrame:
    """key and text of rows of token ids; null ids give null, no ids the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(model)
        for batch in batches:
            lists = [np.array(x or [], dtype=np.int64) for x in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            texts = code.decode(np.concatenate([*lists, np.zeros(0, np.int64)]), offsets)
            valid = batch.column(1).is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t if ok else None for t, ok in zip(texts, valid, strict=True)], pa.string())], ["_key", "text"])

    rows = rows.select(rows[key].alias("_key"), rows[ids].alias("_ids"))
    return rows.mapInArrow(lean(run, keeps=True), f"_key {rows.schema['_key'].dataType.simpleString()}, text string").withColumnRenamed("_key", key)
