"""Packing against brute force: nothing lost, best fit, positions, edges."""

import random

import numpy as np

from corvex.llm import packing, pieces


def plain_best_fit(lengths, most):
    rooms, out = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in range(len(rooms)) if rooms[r] >= lengths[i]]
        if fits:
            r = min(fits, key=lambda r: rooms[r])
        else:
            r = len(rooms)
            rooms.append(most)
        rooms[r] -= lengths[i]
        out[i] = r
    return out, rooms


def test_best_fit():
    rng = random.Random(1)
    for _ in range(200):
        most = rng.choice([1, 5, 16, 100])
        lengths = [rng.randint(1, most) for _ in range(rng.randint(0, 60))]
        rows, n = packing.best_fit(np.array(lengths, dtype=np.int64), most)
        room = np.full(n, most)
        for length, r in zip(lengths, rows, strict=True):
            room[r] -= length
        assert (room >= 0).all()
        assert sorted(room.tolist()) == sorted(plain_best_fit(lengths, most)[1])


def back(rows):
    docs = {}
    for r in rows:
        ids, pos = np.frombuffer(r.input_ids, "<i4"), np.frombuffer(r.position_ids, "<i4")
        cu = r.cu_seqlens
        assert cu[0] == 0 and cu[-1] == r.n_tokens and len(cu) == len(r.doc_ids) + 1 == len(r.doc_offsets) + 1
        assert (ids[r.n_tokens :] == packing.PAD_ID).all() and (pos[r.n_tokens :] == 0).all()
        for d, o, a, b in zip(r.doc_ids, r.doc_offsets, cu, cu[1:], strict=False):
            assert pos[a:b].tolist() == list(range(b - a))
            docs.setdefault(d, []).append((o, ids[a:b].tolist()))
    return {d: [i for _, part in sorted(parts) for i in part] for d, parts in docs.items()}


def test_lossless(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, row_tokens=256, group_tokens=20_000).collect()
    assert len({r.pack_id for r in rows}) == len(rows)
    assert all(len(r.input_ids) == 4 * 256 for r in rows)
    want = {r.doc_id: [*r.token_ids, packing.END_ID] for r in pieces.encode(docs).collect()}
    assert back(rows) == want
    assert sum(r.n_tokens for r in rows) > 0.97 * 256 * len(rows)


def test_edges(spark):
    rows = spark.createDataFrame([(1, None, 1), (None, "a b", 2), (3, "", 3)], "doc_id long, text string, n_tokens int")
    got = back(packing.pack(rows.coalesce(1)).collect())
    assert got[1] == [packing.END_ID] and got[3] == [packing.END_ID] and len(got[None]) == 3
    assert packing.pack(rows.where("doc_id > 9")).count() == 0
