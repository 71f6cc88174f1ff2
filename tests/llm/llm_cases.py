"""Test texts, odd rows and brute-force versions."""
import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASHES = ("nid", "row", "key", "copies", "vslot", "shard", "component", "size")


def prose(seed, words):
    rng = random.Random(seed)
    syllables = "ba co di fu ge ha ki lo mu na pe ri so tu va we".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words))


def edited(text, seed, n):
    """``text`` with ``n`` words replaced."""
    rng, words = random.Random(seed), text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"changed{seed}x{i}"
    return " ".join(words)


def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, equal texts."""
    return [
        (1, prose(1, 60), "en", "a", 1), (1, prose(1, 60), "en", "a", 1), (2, prose(1, 60), None, "b", None),
        (3, None, "en", "a", 3), (4, "", "en", None, 4), (5, " \t\n ", "en", None, 5),
        (None, prose(1, 60), "en", "a", 6), (None, prose(2, 40), "en", None, 7), (8, prose(8, 30_000), "en", "b", 8),
        (9, "one two", "en", "c", 9), (10, "ONE two", "en", "c", 10), (11, "été ü 漢字 \U0001f600 fin", "fr", "c", 11),
        (12, None, None, None, None), (None, None, None, None, None),
    ]


WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sets(texts):
    """Distinct five-word shingles; the whole sequence where there are fewer words."""
    out = []
    for t in texts:
        w = WORDS.findall((t or "").translate(LOWER))
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_groups(rows, percent=85):
    """Smallest id of the component of each document."""
    sets = dict(zip([r[0] for r in rows], word_sets([r[1] for r in rows])))
    by_shingle = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by_shingle[g].append(i)
    shared = Counter((a, b) for ids in by_shingle.values() for a in ids for b in ids if a < b)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}
