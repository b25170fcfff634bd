import random

from tillage.llm import near_dedup as N
from tillage.llm.components import components


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})).encode().split()
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(s), str(least.get(find(i))), d == least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = text(60)
    out = []
    for group in range(12):
        base = text(rng.randrange(30, 200)) + (passage if group % 3 == 0 else [])
        for _ in range(rng.choice([1, 2, 5, 90 if group == 0 else 8])):
            copy = base[:]
            for _ in range(rng.randrange(0, max(2, len(base) // 16))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary).lower()
            out.append(" ".join(copy))
    out += [" ".join(text(40) + passage) for _ in range(90)]  # a passage that many texts share
    return out + [None, "", " \n", "a b", "A\tb", "a b c d e", "a b c d e f", out[3], out[3], out[3].upper()]


def test_equals_brute_force(spark):
    for seed in (1,):
        rows = [(i * 3 % 1009 if i != 4 else None, t) for i, t in enumerate(corpus(seed))]
        docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, key string, n string").repartition(4)
        got = N.near_duplicates(docs).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(rows)
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(20, 60)] + [(3, 3), (5, 4), (4, 5)]
    got = {(r.member, r.component) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 100) for i in range(100, 161)} | {(i, 7) for i in [7, *range(20, 60)]} | {(4, 4), (5, 4)}


def test_large_nodes_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "NODE", 2)
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "LEVELS", 1)
    rows = [(i, t) for i, t in enumerate(corpus(3))]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(rows)


def test_recall_of_the_deeper_levels(spark, monkeypatch):
    """Pairs a little above the threshold behind a passage that all texts share: only deeper levels bring them together."""
    monkeypatch.setattr(N, "NODE", 2)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for pair in range(150):
        base = passage + [f"x{pair}_{i}" for i in range(140)]
        other = base[:]
        for k in range(rng.choice([4, 5])):  # each changed word takes five shingles of 196
            other[70 + 25 * k + rng.randrange(10)] = f"y{pair}_{k}"
        rows += [(2 * pair, " ".join(base)), (2 * pair + 1, " ".join(other))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    share = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert 0.75 <= min(share) and max(share) < 0.83 and len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.5
    monkeypatch.setattr(N, "_in_blocks", lambda nodes: nodes.limit(0).selectExpr("node", "0 AS i", "0 AS j", "0 AS own", "key", "component"))
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = sum(got[2 * k + 1] == 2 * k for k in range(150))
    assert all(got[2 * k] == 2 * k for k in range(150))  # none falsely
    assert linked >= 147, linked  # recall of 0.98 without comparing the blocks of the last level


def test_very_long_texts_and_one_huge_key(spark, monkeypatch):
    monkeypatch.setattr(N, "HUB", 30)
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    copy = " ".join(f"c{i}" for i in range(30))
    rows = [(1, " ".join(long)), (2, " ".join(long[:50_000])), (3, " ".join(long[:30_000]))] + [(10 + i, copy) for i in range(400)]
    rows += [(1000 + i, " ".join([*copy.split(), f"end{i}"])) for i in range(200)]
    got = {r.doc_id: (r.component_id, r.kept) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got[1] == (1, True) and got[2] == (1, False) and got[3] == (3, True)
    assert all(got[d][0] == 10 for d in got if d >= 10) and sum(kept for _, kept in got.values()) == 3
