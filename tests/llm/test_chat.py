"""Roles: Viterbi against all paths, segments against the whole, held-out accuracy, edges."""

import itertools
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from corvex.llm import chat
from corvex.llm.queries import op8_chat_formatting


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 7))
        scores, start, step = rng.normal(size=(n, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
        total = lambda p: start[p[0]] + sum(scores[t, p[t]] for t in range(n)) + sum(step[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert tuple(chat.viterbi(scores, start, step)) == max(itertools.product(range(3), repeat=n), key=total)


def turns(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"{['Human', 'AI'][i % 2]}: text {'why?' if i % 2 == 0 else 'because ' * (1 + i % 5)}") for i in range(60)]
    rows += [(2, 0, "system", "System: be kind"), (2, 1, "user", "hello?"), (2, 2, "assistant", "good day to all of you " * 4)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_segments_equal_whole(spark):
    rows = turns(spark)
    model = chat.train(rows)
    got = [{(r.conv_id, r.turn): (r.role_pred, r.rendered) for r in chat.parse(rows, model, n).collect()} for n in (1, 7, 1000)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 63
    right = sum(got[0][r.conv_id, r.turn][0] == r.role for r in rows.collect())
    assert right >= 60
    assert got[0][2, 0][1] == "<|system|>\nbe kind\n<|end|>\n"


def test_held_out_accuracy(spark):
    got = op8_chat_formatting(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 536
    test = [r for r in got if zlib.crc32(str(r.conv_id).encode()) % 4 == 2]
    assert sum(r.role == r.role_pred for r in test) / len(test) > 0.9


def test_edges(spark):
    rows = [(None, 0, "user", "a"), (None, 1, None, "b"), (3, None, "tool", None), (3, 0, "user", ""), (3, 0, "user", ""), (3, 0, "user", "x <|end|>")]
    table = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = chat.parse(table, chat.train(table)).collect()
    assert len(got) == 6 and all(r.role_pred in chat.ROLES for r in got)
    assert any("x < |end|>" in r.rendered for r in got)
    empty = table.where("conv_id > 9")
    assert chat.parse(empty, chat.train(empty)).count() == 0


def plain_features(t):
    """marker, question, size, lines and lower of a piece."""
    marker = 0
    for i, role in enumerate(chat.ROLES):
        if re.search(rf"(?i)^[\s>*#_\[(]*(?:{chat.MARKERS[role]})[\s\])*_]*[:>][\s*_]*", t):
            marker = i + 1
    n = len(t)
    return marker, int("?" in t), 0 if n < 16 else min(7, int(math.log2(n / 8))), min(3, t.count("\n")), int(bool(re.search(r"^\s*[a-zà-öø-ÿ]", t)))


def plain_pieces(t):
    return re.split(rf"\n(?=[ \t>*#_\[(]*(?:{'|'.join(chat.MARKERS.values())})[ \t\])*_]*:|\n)", t or "", flags=re.IGNORECASE)


def strong(p):
    return bool(re.match(rf"[ \t>*#_\[(]*(?:{chat.SPEAKERS})[ \t\])*_]*:", p, flags=re.IGNORECASE))


def best_path(scores, start, steps):
    """Viterbi with a step of its own into each piece."""
    best, back = start + scores[0], []
    for s, step in zip(scores[1:], steps[1:], strict=True):
        way = best[:, None] + step
        back.append(way.argmax(axis=0))
        best = way.max(axis=0) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def plain_parse(rows, training):
    """(role and text of each turn found) of each (conversation, turn), by counting, and by Viterbi over whole conversations."""
    emit = [np.ones((3, n)) for _, n in chat.FEATURES]
    emit[0][[0, 1, 2], [1, 2, 3]] += chat.HINT
    step, start, by_place = np.ones((3, 3)), np.ones(3), {}
    for c, t, role, text in training:
        for table, x in zip(emit, plain_features(plain_pieces(text)[0]), strict=True):
            table[chat.ROLES.index(role), x] += 1
        by_place[c, t] = chat.ROLES.index(role)
    for (c, t), r in by_place.items():
        if (c, t - 1) in by_place:
            step[by_place[c, t - 1], r] += 1
        else:
            start[r] += 1
    share = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    emit, step, start, out = [share(e) for e in emit], share(step), share(start), {}
    inner = [np.log(np.full((3, 3), x / 2) + np.eye(3) * (1 - 1.5 * x)) for x in chat.SWITCHES]
    marked = rf"[ \t>*#_\[(]*(?:{'|'.join(chat.MARKERS.values())})[ \t\])*_]*:"
    for c in {r[0] for r in rows}:
        own, scores = [], []
        for _, t, _, text in sorted((r for r in rows if r[0] == c), key=lambda r: r[1]):
            parts = plain_pieces(text)
            for i, p in enumerate(parts):
                seen = list(zip(emit, plain_features(p), strict=True))
                own.append((t, i, p))
                scores.append(sum(e[:, x] for e, x in (seen[:2] if len(parts) > 1 else seen)))
        scores = np.array(scores)
        steps = [step if i == 0 or strong(p) else inner[0 if re.match(marked, p, flags=re.IGNORECASE) else 1] for _, i, p in own]
        for (t, i, p), r in zip(own, best_path(scores, start, steps), strict=True):
            turns = out.setdefault((c, t), [])
            if i > 0 and not strong(p) and turns[-1][0] == chat.ROLES[r]:
                turns[-1] = turns[-1][0], f"{turns[-1][1]}\n{p}"
            else:
                turns.append((chat.ROLES[r], p))
    return out


def test_against_plain(spark, sf):
    """Whole parse against a plain version, with transcripts of several speakers in one row."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").distinct().collect()]
    rows = list({(c, t): (c, t, role, text) for c, t, role, text in sorted(rows)}.values())
    said = "User: what is it?\nand why\nAssistant: it is so\nHuman: I see\n  **AI**: good\nContext: keep me"
    rows += [(90_000 + c, t, "user", said if t % 2 == 0 else f"note {t}") for c in range(4) for t in range(5)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.parse(table, chat.train(table), segment=2).collect()
    want = plain_parse(rows, rows)
    assert {(r.conv_id, r.turn): (r.role_pred, r.n_pieces) for r in got} == {k: (v[0][0], len(v)) for k, v in want.items()}
    heads = lambda rendered: re.findall(r"<\|(system|user|assistant)\|>\n", rendered)
    assert {(r.conv_id, r.turn): heads(r.rendered) for r in got} == {k: [role for role, _ in v] for k, v in want.items()}
    one = next(r for r in got if (r.conv_id, r.turn) == (90_000, 0))
    assert one.n_pieces == 5 and one.rendered.count(chat.END) == 5 and one.rendered.endswith("<|system|>\nkeep me\n<|end|>\n")
    assert one.rendered.startswith("<|user|>\nwhat is it?\nand why\n<|end|>\n<|assistant|>\nit is so\n<|end|>\n")


def test_transcripts(spark, sf):
    """Short markers split where the role changes; paragraphs of one speaker stay together; an unmistakable marker always splits."""
    said = {
        "qa": ("Q: why is it so?\nA: because\nof that\nQ: and then?\nA: nothing", ["user", "assistant", "user", "assistant"]),
        "long": ("Question: what now?\n\nAnswer: first this.\n\nThen that, at length.\n\nAnd so on.", ["user", "assistant"]),
        "three": ("Instructions: be brief\nMe: hello\nModel: hi\nMe: bye", ["system", "user", "assistant", "user"]),
        "same": ("User: one\nUser: two", ["user", "user"]),
        "plain": ("a text\n\nof three\n\nparagraphs and no speaker", None),
    }
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    kind = "conv_id long, turn long, role string, text string"
    model = chat.train(spark.createDataFrame(rows, kind))
    table = spark.createDataFrame([(i, 0, None, t) for i, (t, _) in enumerate(said.values())], kind)
    got = {r.conv_id: r for r in chat.parse(table, model).collect()}
    for i, (text, roles) in enumerate(said.values()):
        found = re.findall(r"<\|(system|user|assistant)\|>\n", got[i].rendered)
        assert found == roles if roles else len(found) == 1, text
    assert "because\nof that\n<|end|>" in got[0].rendered and "first this.\n\nThen that, at length.\n\nAnd so on." in got[1].rendered


def test_only_the_role_decoded_loses_its_marker(spark):
    table = spark.createDataFrame([("Context: keep me", r) for r in chat.ROLES], "t string, r string")
    got = {x.r: x.b for x in table.select("r", chat.body(F.col("t"), F.col("r")).alias("b")).collect()}
    assert got == {"system": "keep me", "user": "Context: keep me", "assistant": "Context: keep me"}


def test_crowded_turns(spark):
    """Turns with null and equal numbers, split by their hashes: the same roles as in one piece."""
    rows = [(1, None if i % 2 else 5, ["user", "assistant"][i % 2], f"text {i} {'?' * (i % 3 == 0)}") for i in range(300)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.train(table)
    found = [{(r.turn, r.text): r.role_pred for r in chat.parse(table, model, n).collect()} for n in (3, 100_000)]
    assert found[0] == found[1] and len(found[0]) == 300
