"""Near-duplicate groups, components and benchmark search against brute force."""
import random

import pyarrow as pa
from llm_cases import brute_groups, edited, odd_rows, prose, word_sets
from tellsign.llm import common, decontaminate, graph, minhash


def groups(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(df).collect()}


def test_word_hashes_see_words_as_the_pattern_does():
    texts = ["A  b\tc", "a\x0bb\x0cc", "", " x y", "x", "a b c d e", "A B C D E"]
    got = [len(s) for _, _, d, o in common.slices(pa.array(texts)) for s in common.shingles(d, o)]
    assert got == [len(s) for s in word_sets(texts)]
    (_, _, data, offsets), = common.slices(pa.array(["a b c d e", "A B C D E", "b a c d e"]))
    one, two, three = common.shingles(data, offsets)
    assert one == two and one != three


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups_equal_brute_force(documents):
    rows, k = [], 0
    for family in range(4):
        base = prose(100 + family, 150)
        for copy in range(60):
            rows.append((k, edited(base, 1000 * family + copy, copy % 6), "en", "a", 0))
            k += 1
    got = groups(documents(rows))
    want = brute_groups(rows)
    assert {i: v[1] for i, v in got.items()} == want
    assert len(set(want.values())) > 4


def test_groups_over_many_blocks_and_repeated_rows(documents, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = prose(77, 150)
    rows = [(k, edited(base, k, k % 7), "en", "a", 0) for k in range(60)]
    want = brute_groups(rows)
    assert {i: v[1] for i, v in groups(documents(rows)).items()} == want and len(set(want.values())) > 2
    twice = minhash.near_groups(documents(rows + rows[:30] * 2)).collect()
    assert len(twice) == 120 and {r.doc_id: r.component_id for r in twice} == want
    assert len({(r.doc_id, r.component_id) for r in twice}) == 60


def test_odd_groups(odd, documents):
    rows = minhash.near_groups(odd).collect()
    assert len(rows) == len(odd_rows())
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert got[2].component_id == 1 and not got[2].kept and got[1].kept
    assert got[3].n_shingles == got[4].n_shingles == got[5].n_shingles == 0 and got[4].kept
    assert got[10].component_id == 9 and got[9].n_shingles == 1
    nulls = sorted((r.component_id is not None, r.n_shingles, r.kept) for r in rows if r.doc_id is None)
    assert nulls == [(False, 0, True), (False, 36, True), (True, 56, False)]
    assert minhash.near_groups(documents([])).count() == 0


def test_keep_one_keeps_columns(clashing, documents):
    kept = minhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 8, 9, 11, 12] and ids.count(None) == 2
    assert minhash.keep_one(documents([])).count() == 0


def test_items_found(documents, spark):
    items = [(i, prose(500 + i, n)) for i, n in enumerate([5, 12, 20, 40, 70, 150, 300])]
    items += [(20, "three word item"), (21, None), (22, ""), (None, prose(500, 30)), (23, "three word item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i, (item, text) in enumerate(items[:7]):
        n = len(text.split())
        rows += [(10 * i, f"{prose(i, 3000)} {text.upper()} {prose(i + 50, 3000)}", "en", "a", 0),
                 (10 * i + 1, text, "en", "a", 0), (10 * i + 2, edited(text, i, max(1, n // 40)), "en", "a", 0),
                 (10 * i + 3, edited(text, i, max(1, n // 5)), "en", "a", 0)]
    rows += [(90, f"{prose(1, 9)} three word item {prose(2, 9)}", "en", "a", 0), (91, "three word", "en", "a", 0)]
    sets = dict(zip([r[0] for r in rows], word_sets([r[1] for r in rows])))
    want = set()
    for item, own in zip(items[:7], word_sets([t for _, t in items[:7]])):
        want |= {(d, item[0]) for d, s in sets.items() if len(own & s) >= 0.8 * len(own)}
    want |= {(90, 20), (90, 23)}
    df = documents(rows)
    found = decontaminate.find_items(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    left = {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert left == set(sets) - {d for d, _ in want}


def test_items_in_odd_tables(odd, clashing, documents, spark):
    bench = spark.createDataFrame([(7, prose(1, 60))], "item_id long, text string")
    found = decontaminate.find_items(odd, bench).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "1", "2", "None"]
    kept = decontaminate.drop_contaminated(clashing, bench)
    assert kept.columns == clashing.columns and kept.count() == len(odd_rows()) - 4
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_items(odd, none).count() == 0
    assert decontaminate.find_items(documents([]), bench).count() == 0


def test_short_items_and_the_twin(documents, spark):
    """Items of one to four words are found inside longer texts; the SQL twin finds the same."""
    import duckdb
    from tellsign.llm.queries import ORACLES

    docs = [(10, "x y Three word ITEM z and more of it", "en", "a", 0), (11, "three word item", "en", "a", 0), (12, "one", "en", "a", 0),
            (13, prose(3, 40) + " one " + prose(4, 20), "en", "a", 0), (14, "word item three", "en", "a", 0), (15, None, "en", "a", 0),
            (16, prose(9, 30), "en", "a", 0)]
    items = [(1, "three word item"), (2, "one"), (3, prose(4, 12)), (4, ""), (5, prose(9, 30)), (6, "four words are here")]
    got = {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in decontaminate.find_items(
        documents(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in docs])
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    twin = {tuple(r[:4]) for r in con.execute(ORACLES["op2_benchmark_containment"]).fetchall()}
    assert got == twin and {(10, 1), (11, 1), (12, 2), (13, 2), (13, 3), (16, 5)} == {r[:2] for r in got}
