"""Packed pieces against whole-text tokenizing and the laws of packing."""
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import edited, odd_rows, prose
from pyspark.sql import functions as F
from tellsign.llm import common, packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


HARD = [" a", "a ", "a  b", "a  b c", "x  y z", "é é ©   q", "it's  we'll 's", "1 2\n 3 \t4 \x1c 5", "\u0085 k \u0085",
        "<|endoftext|> and <|endoftext|>", "\U0001f600 \U0001f600 x", "　 　a 　", "a\x00 b\x7f c", " " * 50 + "end", "Δ Δ​ x"]


def test_parts_give_the_ids_of_whole_texts():
    rng = random.Random(4)
    letters = ["a", "b ", " ", "\n", "'s", "é", " ", " ", "7", "漢", " ", "!", "\u0085", "İ", "<|endoftext|>"]
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [None, ""]
    encode, got = packing.Encoder(PATH), []
    for _, _, data, offsets in common.slices(pa.array(texts), 500):
        ids, counts = encode(data, offsets)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == whole(texts)


def laws(pieces, docs, capacity):
    """All pieces of all documents, each in its place; the sequences by number."""
    ids = {d: x + [0] for d, x in zip([r[0] for r in docs], whole([r[1] for r in docs]))}
    own, bins = defaultdict(list), defaultdict(list)
    for r in pieces:
        own[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert own.keys() == ids.keys()
    for d, rows in own.items():
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows))) and rows[0].start == 0
        assert len(rows) == -(-len(ids[d]) // capacity) and all(r.length == capacity for r in rows[1:])
        assert [r.start for r in rows[1:]] == list(np.cumsum([r.length for r in rows])[:-1])
        assert sum(r.length for r in rows) == len(ids[d])
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start:r.start + r.length], dtype="<u4").tobytes())
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return bins


def test_packing(documents):
    rng = random.Random(2)
    rows = [(i, prose(i, rng.choice([3, 30, 90, 200])), "en", "a", 0) for i in range(300)]
    rows += [(1000 + i, text, "en", "a", 0) for i, text in enumerate(HARD + [prose(5, 9000), edited(prose(6, 80), 1, 3)])]
    placed = packing.packed(documents(rows), PATH, capacity=256, ids_too=True).cache()
    bins = laws(placed.collect(), rows, 256)
    assert len(bins) == len(brute_best_fit([r.length for b in bins.values() for r in b], 256))
    got = {r.sequence_id: r.ids for r in packing.sequences(placed).collect()}
    assert got == {s: [x for r in sorted(b, key=lambda r: r.offset) for x in r.ids] for s, b in bins.items()}


def brute_best_fit(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in room if r >= s]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else capacity) - s)
    return sorted(capacity - r for r in room)


def test_best_fit_against_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 7, 200):
        sizes = np.array([rng.randint(1, 100) for _ in range(n)], dtype=np.int64)
        head, _, fill = packing.best_fit(sizes, 100)
        assert sorted(fill[i] for i in set(head.tolist())) == brute_best_fit(sizes.tolist(), 100)


@pytest.mark.parametrize("sizes", [
    lambda i: 1100, lambda i: 3, lambda i: 2047, lambda i: 1 + (i * 7919) % 2048, lambda i: 1025 if i % 3 else 1000])
def test_rounds_lose_nothing(spark, sizes):
    """Hundreds of tasks and three rounds, also where hardly anything fits together."""
    n = 6000
    own = [sizes(i) for i in range(n)]
    items = spark.createDataFrame([(i, s) for i, s in enumerate(own)], "item long, size int")
    got = packing.place(items, task_items=60).collect()
    assert sorted(r.item for r in got) == list(range(n))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, own[r.item]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(s for _, s in b[:i]) for i in range(len(b))] and sum(s for _, s in b) <= 2048
    assert len(bins) <= 1.08 * len(brute_best_fit(own, 2048)) + 2


def test_odd_rows(odd, clashing, documents):
    for df in (odd, clashing):
        got = packing.packed(df, PATH).collect()
        by_row = [(r[0], r[1]) for r in odd_rows()]
        want = sorted((d is None, d or 0, zlib.crc32(np.array(x + [0], dtype="<u4").tobytes()))
                      for (d, t), x in zip(by_row, whole([t for _, t in by_row])) if len(x) < 2048)
        assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_crc32) for r in got if r.doc_id != 8) == want
        assert sum(r.length for r in got if r.doc_id == 8) == len(whole([odd_rows()[8][1]])[0]) + 1
    assert packing.packed(documents([]), PATH).count() == 0


def test_columns(odd):
    assert packing.packed(odd, PATH).select(F.col("sequence_id")).count() == packing.packed(odd, PATH).count()
    assert packing.packed(odd, PATH).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
