"""Nearest neighbours, mixing and sharding: exactness, laws, odd tables."""
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from llm_cases import odd_rows, prose
from pyspark.sql import functions as F
from tellsign.llm import mixing, neighbours, shards
from tellsign.llm.minhash import node_id

VECTORS = "vec_id long, embedding array<float>"


def brute_nearest(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = neighbours.exact(np.broadcast_to(x[i], x.shape), x)
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r.query_id][r.rank] = (r.vec_id, r.score)
    return {q: [v[i] for i in range(1, len(v) + 1)] for q, v in out.items()}


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=24) * (1 + i % 3)]) for i in range(1500)]
    rows += [(2000 + i, rows[20][1]) for i in range(30)]
    want, got = brute_nearest(rows), found(neighbours.nearest(spark.createDataFrame(rows, VECTORS)))
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    assert [v for v, _ in got[20]] == [2000 + i for i in range(20)]
    for q in got:
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))


def test_no_vector_is_stored_for_a_table_or_a_probe(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(800)] + [(1, [9.0] * 8)] * 30
    vectors, stored = [], neighbours.stored

    def counted(df, purpose):
        out = stored(df, purpose)
        vectors.append(out.count() if "embedding" in out.columns else 0)
        return out

    monkeypatch.setattr(neighbours, "stored", counted)
    one = found(neighbours.nearest(spark.createDataFrame(rows, VECTORS)))
    assert sum(vectors) <= len(rows) + 40
    assert all(len({v for v, _ in got}) == 20 for got in one.values()) and len(one) == 40
    monkeypatch.setattr(neighbours, "ASKED_BYTES", 1000)  # several broadcasts
    assert found(neighbours.nearest(spark.createDataFrame(rows, VECTORS))) == one
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 1)  # pairs of hashes
    want, two = brute_nearest(rows[:800]), found(neighbours.nearest(spark.createDataFrame(rows[:800], VECTORS)))
    assert sum(len({v for v, _ in two[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_probes_and_best_rows_of_blocks():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(300, 6)), np.concatenate([np.eye(6)[:2], rng.normal(size=(5, 6))])
    x[100:140], ids = x[0], np.concatenate([np.arange(250), np.arange(50)])
    for hashes, probes in ((1, 5), (1, 16), (2, 60), (2, 10_000)):
        index = neighbours.CrossPolytope(6, float(np.linalg.norm(x, axis=1).max()), hashes)
        best = neighbours.Best(neighbours.Asked(np.arange(7), q, *index.limits(q, probes, 2)), index.norm, 4)
        frame = pd.DataFrame({"vec_id": ids, "embedding": list(x)})
        for block in neighbours._blocks(iter([frame[:170], frame[170:]]), 6, 4):
            neighbours._meet(best, *block, index)
        buckets = [index.bucket(x, t) for t in range(2)]
        for i in range(7):
            hit = [np.isin(buckets[t], np.argsort(index.distance(q[i], t), kind="stable")[:probes]) for t in range(2)]
            score = {}
            for j in np.flatnonzero((hit[0] | hit[1]) & (ids != i)):
                own = float(neighbours.exact(q[i:i + 1], x[j:j + 1])[0])
                score[ids[j]] = max(own, score.get(ids[j], -np.inf))
            want = sorted(score.items(), key=lambda p: (-p[1], p[0]))[:4]
            assert [(a, b) for a, b in zip(best.ids[i], best.scores[i]) if b > -np.inf] == want


def test_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]),
            (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [-1.0, -1.0]), (20, [1.0, 2.0]), (9, []), (40, None)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("code", F.lit(1)).withColumn("row", F.lit(2))
    assert found(neighbours.nearest(df)) == {0: [(1, 5.0), (20, 5.0), (8, -3.0)], 20: [(0, 5.0), (1, 5.0), (8, -3.0)]}
    for few in ([], rows[:1], rows[2:4]):
        assert neighbours.nearest(spark.createDataFrame(few, VECTORS)).count() == 0


def water(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, capped = {n: i % 3 + 1 for i, n in enumerate(names)}, {}
    while True:
        free = [n for n in names if n not in capped]
        level = (sum(sizes.values()) - sum(capped.values())) / max(1, sum(weight[n] for n in free))
        over = {n: 3.0 * sizes[n] for n in free if level * weight[n] > 3 * sizes[n]}
        if not over:
            return capped | {n: level * weight[n] for n in free}
        capped |= over


def test_mix(documents):
    rng, rows, i = random.Random(2), [], 0
    for source, n in (("a", 900), ("b", 30), ("c", 200), ("é", 90), (None, 60), ("B", 8)):
        for _ in range(n):
            rows.append((i, prose(i, rng.randint(0, 120)), "en", source, 0))
            i += 1
    df = documents(rows)
    key = [F.col("doc_id").alias("key"), "source", mixing.word_count(F.col("text")).alias("size")]
    mix = mixing.Mix(df.select(*key), shard_slots=256, block=16)
    got = {r.key: r for r in mix.taken().collect()}
    words, sizes, taken = {r[0]: len(r[1].split()) for r in rows}, Counter(), Counter()
    for d, _, _, source, _ in rows:
        sizes[source] += words[d]
        taken[source] += got[d].taken
    want = water(sizes)
    for d, _, _, source, _ in rows:
        r = got[d]
        assert r.size == words[d] and r.source_size == sizes[source] and r.taken <= 3 * r.size
        assert math.isclose(r.target, want[source], rel_tol=1e-9)
    for source in sizes:
        assert abs(taken[source] - want[source]) <= mix.block + 1
    drawn = Counter((r.shard, r.sid) for r in mix.slots.collect())
    assert len({s for s, _ in drawn}) > 1
    again = {r.key: r.taken for r in mixing.Mix(df.select(*key), shard_slots=256, block=16).taken().collect()}
    assert again == {d: r.taken for d, r in got.items()}


def test_blocks_do_not_depend_on_the_input(documents):
    """One block length for all sizes: every source is within a block of its target, small inputs and large blocks too."""
    rows = [(i, prose(i, 50 + i % 90), "en", "ab"[i % 3 == 0], 0) for i in range(400)]
    key = [F.col("doc_id").alias("key"), "source", mixing.word_count(F.col("text")).alias("size")]
    for n, block in ((400, mixing.BLOCK), (40, mixing.BLOCK), (400, 2048)):
        mix = mixing.Mix(documents(rows[:n]).select(*key), block=block)
        assert mix.block == block
        taken, want = Counter(), {}
        for r in mix.taken().collect():
            taken[rows[r.key][3]] += r.taken
            want[rows[r.key][3]] = r.target
        assert all(abs(taken[s] - want[s]) <= block + 1 for s in want)


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


def test_mix_of_odd_rows(odd, clashing, documents):
    rows = [F.col("doc_id").alias("key"), "source", mixing.word_count(F.col("text")).alias("size")]
    got = mixing.Mix(odd.select(*rows)).taken().collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.Mix(documents([]).select(*rows)).taken().count() == 0
    assert mixing.Mix(odd.where("text is null").select(*rows)).taken().count() == 3
    mixed = mixing.mixed_documents(clashing, node_id(clashing["doc_id"], clashing["text"]))
    assert mixed.columns == clashing.columns and mixed.count() > 0


def placed(docs, n=16):
    return shards.places(shards.records(docs), n).collect()


def test_shards(documents):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400) + "é", "en", "a", 0) for i in range(3000)]
    got = placed(documents(rows))
    loads, places = Counter(), defaultdict(list)
    for r in got:
        assert r.size == len(rows[r.doc_id][1].encode()) + 1 and r.text_crc32 == zlib.crc32(rows[r.doc_id][1].encode())
        loads[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert sorted(loads) == list(range(16)) and max(loads.values()) - min(loads.values()) < 0.01 * max(loads.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_rebalancing_moves_little(spark, documents):
    records = shards.records(documents([(i, "x" * (i % 90), "en", "a", 0) for i in range(2000)]), 512)
    sizes = shards.slot_bytes(records, 512)
    one = shards.rebalanced(shards.first_map(spark, 8, 512), sizes, 8)
    more = shards.rebalanced(one, sizes, 9)
    before, after = ({r.vslot: r.shard for r in m.collect()} for m in (one, more))
    assert {r.version for r in more.select("version").collect()} == {2} and set(after.values()) == set(range(9))
    assert sum(before[s] != after[s] for s in before) < 0.3 * len(before)


def test_shards_of_odd_rows(odd, clashing, documents):
    got = placed(odd)
    assert len(got) == len(odd_rows()) and all(0 <= r.shard < 16 for r in got)
    assert shards.places(shards.records(documents([]))).count() == 0
    out = shards.with_shard(clashing)
    assert sorted(out.columns) == sorted(clashing.columns) and out.count() == len(odd_rows())
    assert shards.with_shard(documents([])).count() == 0
