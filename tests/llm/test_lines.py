"""Repeated line chunks against a plain count of the same chunks."""
from collections import defaultdict

import pyarrow as pa
from llm_cases import odd_rows, prose
from tellsign.llm import common
from tellsign.llm import lines as lines_op


def text(seed, n):
    return "\n".join(prose(seed * 1000 + i, 12) for i in range(n))


def plain_chunks(lines, marks):
    """(first line, end line) of the chunk that starts at each line of a text."""
    for i in range(len(lines)):
        if len(lines[i].split()) >= lines_op.MOST_WORDS:
            yield i, i + 1
            continue
        for j in range(i + 1, min(len(lines), i + lines_op.MOST_LINES)):
            if len(lines[j].split()) >= lines_op.MOST_WORDS:
                break
            words = sum(len(x.split()) for x in lines[i:j + 1])
            full = words >= lines_op.MOST_WORDS or j + 1 - i >= lines_op.MOST_LINES
            after = j + 1 == len(lines) or len(lines[j + 1].split()) >= lines_op.MOST_WORDS
            if words >= lines_op.LEAST_WORDS and (marks[j] or full or after):
                yield i, j + 1
                break


def brute(rows):
    """Bytes that go from each text: every chunk but its first occurrence, as disjoint spans."""
    seen, out = set(), {}
    for d, t, *_ in rows:
        own, at = [], 0
        for x in t.encode().split(b"\n"):
            if x:
                own.append((at, x))
            at += len(x) + 1
        (_, _, data, offsets), = common.slices(pa.array([t]))
        starts, ends, _ = common.word_bounds(data, offsets, lines_op._NEWLINE)
        marks = lines_op.boundary_marks(common.hash_spans(data, starts, ends, lower=False))
        gone = []
        for a, b in plain_chunks([x for _, x in own], marks):
            lo, hi = own[a][0], own[b - 1][0] + len(own[b - 1][1])
            chunk = t.encode()[lo:hi]
            if chunk in seen:
                if gone and lo < gone[-1][1]:
                    gone[-1] = gone[-1][0], max(gone[-1][1], hi)
                else:
                    gone.append((lo, hi))
            seen.add(chunk)
        out[d] = gone
    return out


def test_chunks_equal_brute_force(documents):
    shared, long_line = text(7, 12), prose(5, 60)
    rows = [(i, f"{text(100 + i, i % 5 + 1)}\n{shared}\né {text(300 + i, 3)}\n{long_line}\n{text(500 + i, 2)}", "en", "a", 0)
            for i in range(12)] + [(50 + i, text(900 + i, 8), "en", "a", 0) for i in range(5)]
    want, got = brute(rows), defaultdict(list)
    for r in lines_op.repeats(documents(rows)).collect():
        got[r.nid] = [(s.start, s.stop) for s in r.spans]
    assert {d: got[d] for d in want} == want and not want[0] and all(len(want[i]) == 2 for i in range(1, 12))
    left = {r.doc_id: r.text for r in lines_op.without_repeats(documents(rows)).collect()}
    assert left[0] == rows[0][1] and all(left[50 + i] == rows[12 + i][1] for i in range(5))
    for i in range(1, 12):
        assert long_line not in left[i] and sum(x in left[i] for x in shared.split("\n")) <= 2


def test_short_passages_are_found(documents):
    """Every repeated run of lines with 50 words goes from all documents but the first."""
    for n, words in ((2, 26), (3, 18), (5, 11), (10, 6)):
        shared = "\n".join(prose(40_000 + n * 100 + i, words) for i in range(n))
        rows = [(i, f"{text(600 + 20 * n + i, 3)}\n{shared}\n{text(800 + 20 * n + i, 3)}", "en", "a", 0) for i in range(9)]
        left = {r.doc_id: r.text for r in lines_op.without_repeats(documents(rows)).collect()}
        assert left[0] == rows[0][1] and all(shared not in left[i] for i in range(1, 9))
        assert all(text(600 + 20 * n + i, 3) in left[i] for i in range(9))


def test_many_equal_and_blank_lines(documents):
    rows = [(0, "a b\n" * 3000, "en", "a", 0), (1, " \n\n" * 3000, "en", "a", 0), (2, "a b\n" * 70 + "end", "en", "a", 0)]
    got = {r.nid: [(s.start, s.stop) for s in r.spans] for r in lines_op.repeats(documents(rows)).collect()}
    assert got == {d: spans for d, spans in brute(rows).items() if spans}


def test_odd_rows(odd, clashing, documents):
    out = lines_op.without_repeats(clashing)
    assert out.columns == clashing.columns and out.count() == len(odd_rows())
    kept = [r.text for r in lines_op.without_repeats(odd).where("doc_id = 1").collect()]
    assert kept == [prose(1, 60)] * 2
    assert [r.text for r in lines_op.without_repeats(odd).where("doc_id = 2").collect()] == [""]
    assert lines_op.without_repeats(documents([])).count() == 0
