"""Transcript parsing: a hidden Markov model recovers who speaks, then turns are rendered canonically.

A text is first cut into pieces: before each line that begins with a speaker
marker, and at blank lines, so that a whole transcript may stand in one row.
Hidden states are the roles.  What is observed of a piece is its speaker marker
(the word before a colon, as in ``Human:``) and features of its lines; emission
and transition chances are counted on turns whose role is known.  Roles are read
off by Viterbi over all pieces of the conversation, whatever roles are stored
with it.  Between rows, and at an unmistakable marker, the role moves on as
between turns; at any other cut it mostly stays, and a change of the decoded
role is what makes a border: pieces of one role are one turn again.

A conversation of any length is decoded in segments of ``SEGMENT`` turns.  Each
segment becomes one small max-plus matrix, the matrices of a conversation give
the states at the segments' ends, and each segment is then decoded between its
own ends; that is the same path as over the whole conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvex.llm import store

ROLES = ("system", "user", "assistant")
#: Words that mark a speaker, and the role that they hint at.
MARKERS = {
    "system": "system|instruction|instructions|context",
    "user": "user|human|you|customer|prompt|question|q|me",
    "assistant": "assistant|ai|bot|agent|gpt|model|response|answer|a",
}
#: Words before a colon that always begin another turn inside a text.
SPEAKERS = "system|user|human|customer|assistant|ai|bot|agent|gpt"
#: The chances that the role changes inside a text: at another marker, and at a blank line.
SWITCHES = (0.5, 0.1)
SEGMENT = 512
#: Turns that a marker counts for as seen with its own role.
HINT = 100.0
#: (name, values) of each feature.
FEATURES = (("marker", 4), ("question", 2), ("size", 8), ("lines", 4), ("lower", 2))
#: Features that say nothing of a piece of a cut text, as they were counted on whole turns.
WHOLE = ("size", "lines", "lower")
END = "<|end|>"


def _marker(words: str) -> str:
    return rf"(?i)^[\s>*#_\[(]*(?:{words})[\s\])*_]*[:>][\s*_]*"


def features(text: Column) -> dict[str, Column]:
    """The observations of a turn, each a small number."""
    text = F.coalesce(text, F.lit(""))
    marker = F.lit(0)
    for i, role in enumerate(ROLES):
        marker = F.when(text.rlike(_marker(MARKERS[role])), F.lit(i + 1)).otherwise(marker)
    length, lines = F.length(text), F.size(F.split(text, "\n"))
    return {
        "marker": marker,
        "question": text.contains("?").cast("int"),
        "size": F.when(length < 16, 0).otherwise(F.least(F.lit(7), F.floor(F.log2(length / 8.0)).cast("int"))),
        "lines": F.least(F.lit(3), lines - 1),
        "lower": text.rlike(r"^\s*\p{Ll}").cast("int"),
    }


def _line(words: str) -> str:
    return rf"(?i:[ \t>*#_\[(]*(?:{words})[ \t\])*_]*:)"


def pieces(text: Column) -> Column:
    """The pieces of a text between its line breaks before markers and blank lines, in order; one at least."""
    return F.split(F.coalesce(text, F.lit("")), rf"\n(?={_line('|'.join(MARKERS.values()))}|\n)")


def _follows(piece: Column, unit: Column) -> Column:
    """0 where a piece begins a row or has an unmistakable marker, else 1 behind another marker and 2 behind a blank line, where it may belong to the one before it."""
    return F.when((unit == 0) | piece.rlike(f"^{_line(SPEAKERS)}"), 0).when(piece.rlike(f"^{_line('|'.join(MARKERS.values()))}"), 1).otherwise(2)


def _turns(roles: Column, parts: Column) -> Column:
    """The turns (role, text) of a row: pieces that follow in the same role are put together again."""
    begins = F.transform(roles, lambda x, i: (i == 0) | (_follows(F.get(parts, x["unit"]), x["unit"]) == 0) | (x["role_pred"] != F.get(roles, i - 1)["role_pred"]))
    heads = F.filter(F.transform(begins, lambda b, i: F.when(b, i)), lambda i: i.isNotNull())
    end = lambda j: F.coalesce(F.get(heads, j + 1), F.size(parts))
    return F.transform(heads, lambda h, j: F.struct(F.get(roles, h)["role_pred"].alias("role"), F.array_join(F.slice(parts, h + 1, end(j) - h), "\n").alias("text")))


def body(text: Column, role: Column) -> Column:
    """The text without a speaker marker of the role; what marks another role is text."""
    text, out = F.coalesce(text, F.lit("")), None
    for r in ROLES:
        bare = F.regexp_replace(text, _marker(MARKERS[r]), "")
        out = F.when(role == r, bare) if out is None else out.when(role == r, bare)
    return F.trim(out.otherwise(text))


class Model:
    """Log chances: start (roles), step (role, next role), the same at cuts that may be none, and one table (role, value) for each feature."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]) -> None:
        self.start, self.step = start, step
        n = len(start)
        inner = [np.log(np.where(np.eye(n, dtype=bool), 1 - x, x / (n - 1))) for x in SWITCHES]
        self.ways = np.stack([step, *inner])
        # The last value of each table stands for a feature that isn't looked at.
        self.emit = [np.concatenate([t, np.zeros((len(t), 1))], axis=1) for t in emit]

    def steps(self, follows: np.ndarray) -> np.ndarray:
        """The step into each piece."""
        return self.ways[follows]


def train(turns: DataFrame, smoothing: float = 1.0) -> Model:
    """Counts on all turns with a known role; only counts come to the driver.

    A turn's role is that of its first piece, and its successor is the one with
    the next turn number.  Rows that repeat count as often as they are there;
    other columns are dropped first.  Roles beyond ROLES, and null roles, are
    left out.  An empty table gives equal chances.
    """
    rows = turns.select("conv_id", "turn", F.lower("role").alias("role"), *[c.alias(k) for k, c in features(pieces(F.col("text"))[0]).items()]).where(F.col("role").isin(*ROLES))
    names = [k for k, _ in FEATURES]
    rows = store.stage(rows, "chat-training")
    emit = [np.full((len(ROLES), n), smoothing) for _, n in FEATURES]
    # A marker hints at its own role even where no training turn has it.
    for i in range(len(ROLES)):
        emit[names.index("marker")][i, i + 1] += HINT
    for r in rows.groupBy("role", *names).count().collect():
        for table, k in zip(emit, names, strict=True):
            table[ROLES.index(r["role"]), r[k]] += r["count"]
    place = rows.select("conv_id", "turn", "role").distinct()
    before = place.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before"))
    step, start = np.full((len(ROLES),) * 2, smoothing), np.full(len(ROLES), smoothing)
    for r in place.join(before, ["conv_id", "turn"], "left").groupBy("before", "role").count().collect():
        if r["before"] is None:
            start[ROLES.index(r["role"])] += r["count"]
        else:
            step[ROLES.index(r["before"]), ROLES.index(r["role"])] += r["count"]
    share = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return Model(share(start), share(step), [share(t) for t in emit])


def viterbi(scores: np.ndarray, start: np.ndarray, step: np.ndarray, end: int | None = None) -> np.ndarray:
    """The best path through scores (turn, role); start holds what stands before the first turn's score, step is one for all or one into each turn."""
    n = len(scores)
    step = np.broadcast_to(step, (n, *step.shape[-2:]))
    best, back = start + scores[0], np.zeros((n, scores.shape[1]), dtype=np.int64)
    for t in range(1, n):
        way = best[:, None] + step[t]
        back[t] = way.argmax(axis=0)
        best = way.max(axis=0) + scores[t]
    path = np.zeros(n, dtype=np.int64)
    path[-1] = best.argmax() if end is None else end
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def segment_matrix(scores: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best log chance from the role before a segment to the role at its end."""
    step = np.broadcast_to(step, (len(scores), *step.shape[-2:]))
    total = np.where(np.eye(step.shape[-1], dtype=bool), 0.0, -np.inf)
    for row, way in zip(scores, step):
        total = (total[:, :, None] + way[None]).max(axis=1) + row
    return total


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole runs of equal values in the first columns; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        names = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        at = 0
        for i, name in enumerate(names):
            if i and name != names[i - 1] or not i and held and name != last:
                if i > at:
                    held.append(batch.slice(at, i - at))
                yield pa.Table.from_batches(held)
                held, at = [], i
        if len(names) > at:
            held.append(batch.slice(at))
            last = names[-1]
    if held:
        yield pa.Table.from_batches(held)


def parse(turns: DataFrame, model: Model, segment: int = SEGMENT) -> DataFrame:
    """The columns of turns (conv_id, turn, role, text), with role_pred (of the first piece), n_pieces (the turns found in the text) and rendered.

    Pieces are decoded in the order of turn, then text, then place; equal rows
    of a conversation (same turn and text) are one turn and share its roles.
    Null text reads as empty; null conversation ids are one conversation; null
    turns come first.  Other columns are dropped first.  One row of nine numbers
    for each segment of a conversation meets in one task, and so do the pieces
    of a segment: those of ``segment`` turn numbers, or, where these have more
    than four times as many, of one turn and a prefix of the texts' hashes.  A
    very long text is cut and put together in its row.
    """
    names = [k for k, _ in FEATURES]
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("mark", F.sha1(F.coalesce("text", F.lit(""))))
    key = ["conv_id", "turn", "mark", "unit"]
    cut = rows.withColumn("_p", pieces(F.col("text"))).select("conv_id", "turn", "mark", (F.size("_p") > 1).alias("several"), F.posexplode("_p").alias("unit", "piece"))
    blind = {k: F.when(F.col("several"), n) for k, n in FEATURES if k in WHOLE}
    look = [(blind[k].otherwise(c) if k in blind else c).alias(k) for k, c in features(F.col("piece")).items()]
    seen = cut.select(*key, _follows(F.col("piece"), F.col("unit")).alias("follows"), *look).dropDuplicates(key)
    seen = store.stage(seen.withColumn("range", F.floor(F.coalesce("turn", F.lit(0)) / segment).cast("long")), "chat-turns")
    crowded = seen.groupBy(F.col("conv_id").alias("c"), F.col("range").alias("r")).agg(F.count("*").alias("n")).where(F.col("n") > 4 * segment)
    crowded = crowded.withColumn("digits", F.ceil(F.log2(F.col("n") / segment) / 4).cast("int")).drop("n")
    seen = seen.join(crowded, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")), "left")
    prefix = F.when(F.col("digits").isNotNull(), F.substring("mark", F.lit(1), F.col("digits"))).otherwise("")
    seen = seen.withColumn("part", F.struct("range", F.when(F.col("digits").isNotNull(), F.col("turn")).alias("turn"), prefix.alias("prefix")))
    seen = seen.select(*key, "part", "follows", *names)
    shared = turns.sparkSession.sparkContext.broadcast(model)

    def scores(part: pa.Table | pa.RecordBatch) -> np.ndarray:
        return sum(t[:, part.column(k).to_numpy()].T for t, k in zip(shared.value.emit, names, strict=True))

    def steps(part: pa.Table | pa.RecordBatch) -> np.ndarray:
        return shared.value.steps(part.column("follows").to_numpy())

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 2):
            total = segment_matrix(scores(run), steps(run))
            yield pa.RecordBatch.from_arrays([run.column(0).combine_chunks().slice(0, 1), run.column(1).combine_chunks().slice(0, 1), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["conv_id", "part", "total"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(ROLES)
        for run in _runs(batches, 1):
            totals = np.array(run.column(2).to_pylist()).reshape(-1, size, size)
            best, back = None, []
            for i, total in enumerate(totals):
                if i == 0:
                    # Before the first turn stands the start chance instead of a step.
                    best = first_ends(run.column(3)[0].as_py())
                    back.append(np.zeros(size, dtype=np.int64))
                else:
                    way = best[:, None] + total
                    back.append(way.argmax(axis=0))
                    best = way.max(axis=0)
            state = int(best.argmax())
            out = [state]
            for b in back[:0:-1]:
                out.append(int(b[out[-1]]))
            out = out[::-1]
            yield pa.RecordBatch.from_arrays([run.column(0).combine_chunks(), run.column(1).combine_chunks(), pa.array([None, *out[:-1]], pa.int32()), pa.array(out, pa.int32())], ["conv_id", "part", "enter", "leave"])

    def first_ends(flat: list[float]) -> np.ndarray:
        return np.array(flat)

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 2):
            s, m, way = scores(run), shared.value, steps(run)
            best = m.start + s[0]
            for t in range(1, len(s)):
                best = (best[:, None] + way[t]).max(axis=0) + s[t]
            yield pa.RecordBatch.from_arrays([run.column(0).combine_chunks().slice(0, 1), run.column(1).combine_chunks().slice(0, 1), pa.array([best.tolist()], pa.list_(pa.float64()))], ["conv_id", "part", "first"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 2):
            m, way = shared.value, steps(run)
            enter, leave = run.column("enter")[0].as_py(), run.column("leave")[0].as_py()
            path = viterbi(scores(run), m.start if enter is None else way[0][enter], way, leave)
            yield pa.RecordBatch.from_arrays([*(run.column(k).combine_chunks() for k in key), pa.array([ROLES[i] for i in path])], [*key, "role_pred"])

    kind = seen.schema["conv_id"].dataType.simpleString()
    order, part_kind = ["conv_id", "part", "turn", "mark", "unit"], seen.schema["part"].dataType.simpleString()
    # Only conversations of more than one segment need matrices.
    spans = seen.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    long = store.stage(seen.join(spans, seen["conv_id"].eqNullSafe(spans["conv_id"])).select(seen["*"], "low"), "chat-long")
    laid = lambda df: df.repartition("conv_id", "part").sortWithinPartitions(*order)
    columns = [*order, "follows", *names]
    totals = laid(long.where("part > low")).select(*columns).mapInArrow(matrices, f"conv_id {kind}, part {part_kind}, total array<double>")
    first = laid(long.where("part = low")).select(*columns).mapInArrow(starts, f"conv_id {kind}, part {part_kind}, first array<double>")
    joined = totals.withColumn("first", F.lit(None).cast("array<double>")).unionByName(first.withColumn("total", F.array(*[F.lit(0.0)] * len(ROLES) ** 2)))
    joined = joined.select("conv_id", "part", "total", "first").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    borders = store.stage(joined.mapInArrow(ends, f"conv_id {kind}, part {part_kind}, enter int, leave int"), "chat-borders")
    placed = seen.alias("s").join(borders.alias("b"), F.col("s.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("s.part") == F.col("b.part")), "left").select("s.*", "enter", "leave")
    turn_kind = seen.schema["turn"].dataType.simpleString()
    found = laid(placed).select(*columns, "enter", "leave").mapInArrow(decode, f"conv_id {kind}, turn {turn_kind}, mark string, unit int, role_pred string")
    found = found.groupBy("conv_id", "turn", "mark").agg(F.array_sort(F.collect_list(F.struct("unit", "role_pred"))).alias("roles"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in ("conv_id", "turn", "mark")]
    out = rows.alias("r").join(found.alias("f"), same[0] & same[1] & same[2]).select("r.conv_id", "r.turn", "r.role", "r.text", "f.roles")
    out = out.withColumn("_turns", _turns(F.col("roles"), pieces(F.col("text"))))
    turn = lambda x: render(x["role"], body(x["text"], x["role"]))
    return out.select("conv_id", "turn", "role", "text", F.col("roles")[0]["role_pred"].alias("role_pred"), F.size("_turns").alias("n_pieces"), F.array_join(F.transform("_turns", turn), "").alias("rendered"))


def render(role: Column, text: Column) -> Column:
    """A canonical turn; what looks like a control mark in the text is broken up."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.regexp_replace(text, r"<\|", "< |"), F.lit(f"\n{END}\n"))
