import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomwork.llm import minhash as mh


def brute(texts, k, percent=80):
    sets = {}
    for i, t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        u = len(sets[a] | sets[b])
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * u:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near(seed, n=120):
    """Chains of edits, so that links aren't all to one centre, and short texts with ties."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, texts = [], [[r.choice(vocabulary) for _ in range(r.randint(1, 40))] for _ in range(15)]
    for i in range(n):
        t = list(r.choice(texts))
        for _ in range(r.randint(0, 2)):
            if t:
                t[r.randrange(len(t))] = r.choice(vocabulary)
        texts.append(t)
        rows.append((i * 7 % n, " ".join(t)))
    return rows


def test_components_equal_brute_force(spark):
    for seed, k in ((1, 2), (2, 5)):
        rows = near(seed)
        found = mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k).collect()
        want = brute(rows, k)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_odd_rows(odd, none):
    rows = mh.near_duplicates(odd, shingle=2).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == 1 and by[1].kept and not by[2].kept
    assert all(by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept for i in (3, 4, 5))
    assert by[6].n_shingles == 1 and by[7].component_id == by[8].component_id == 7
    assert sum(r.doc_id == 9 and r.kept for r in rows) == 2
    assert by[None].component_id is None and not by[None].kept
    assert mh.near_duplicates(none).count() == 0


def test_one_row_of_each_group_stays(odd):
    out = mh.deduplicate(odd, shingle=2)
    assert out.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, i) for i in (1, 3, 4, 5, 6, 7, 9, 11)] + [(True, 0)]


def test_every_coordinate_fills_and_estimates():
    r = np.random.default_rng(0)
    a = np.unique(r.integers(0, 2**63, 600, dtype=np.uint64))
    for share in (1.0, 0.8, 0.3):
        both = int(len(a) * share)
        b = np.unique(np.concatenate([a[:both], r.integers(0, 2**63, len(a) - both, dtype=np.uint64)]))
        x, y = mh.sketches([a, b])
        assert abs((x == y).mean() - both / (2 * len(a) - both)) < 0.15
    one = mh.sketches([np.array([5], np.uint64), np.array([5], np.uint64)])
    assert (one[0] == one[1]).all() and len(set(one[0].tolist())) > 100


def block(nodes, labels, sets, own=None, i=0, j=0):
    rows = [x.tobytes() for x in mh.sketches(sets)]
    n = len(nodes)
    return pa.record_batch(
        [pa.array([7] * n), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array(own or [0] * n, pa.int32()), pa.array(nodes), pa.array(labels), pa.array([len(x) for x in sets]), pa.array(rows), pa.array([b"k"] * n)],
        ["group", "i", "j", "own", "node", "label", "n", "sketch", "bucket"],
    )


def test_links_between_members_that_the_centre_misses():
    """The block comparison sees pairs of different components."""
    sets = [np.arange(100, dtype=np.uint64) + np.uint64(10**6 * g) for g in (0, 0, 1)]
    out = [p for b in mh._across(iter([block([b"a", b"b", b"c"], [b"a", b"b", b"c"], sets)]), 80, 8) for p in b.to_pylist()]
    assert [(p["x"], p["y"], p["same"]) for p in out] == [(b"a", b"b", 128), (b"b", b"a", 128)]


def test_a_block_emits_few_pairs_a_member():
    """Two components of 256 like members each: no product of them."""
    nodes = [bytes([k // 256, k % 256]) for k in range(512)]
    base = np.arange(400, dtype=np.uint64)
    sets = [np.append(base, np.uint64(10**6 + k)) for k in range(512)]
    labels = [bytes([k // 256]) for k in range(512)]
    for own, i, j in (([0] * 512, 0, 0), ([k // 256 for k in range(512)], 0, 1)):
        out = [p for b in mh._across(iter([block(nodes, labels, sets, own, i, j)]), 80, 4) for p in b.to_pylist()]
        assert len(out) == 4 * 512 + 1 and out[-1]["x"] is None
        assert Counter(p["x"] for p in out[:-1]) == dict.fromkeys(nodes, 4)


def test_one_bucket_of_many_components(spark, monkeypatch):
    """5,000 distinct texts that share a bucket, pairwise under 0.8: at most QUOTA pairs a member are verified in a round."""
    seen = []
    true_verify = mh._verify

    def counted(docs, classes, pairs, k, percent):
        seen.append(pairs.count())
        return true_verify(docs, classes, pairs, k, percent)

    monkeypatch.setattr(mh, "_verify", counted)
    monkeypatch.setattr(mh, "BLOCK", 700)
    n = 5000
    common = " ".join(f"c{k}" for k in range(30))
    rows = [(i, f"{common} " + " ".join(f"u{i}_{k}" for k in range(22))) for i in range(n)]
    rows += [(n + i, rows[7 * i][1] + " tail") for i in range(40)]
    found = {r.doc_id: r.component_id for r in mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert found == {i: i for i in range(n)} | {n + i: 7 * i for i in range(40)}
    assert all(c <= mh.QUOTA * mh.GROWTH**k * len(rows) for k, c in enumerate(seen[1:])) and seen[0] <= mh.BANDS * len(rows)


def test_chains_through_small_blocks_and_quotas(spark, monkeypatch):
    """Many candidates a member, of which few are links, with blocks and quotas that don't hold them at once."""
    monkeypatch.setattr(mh, "BLOCK", 6)
    monkeypatch.setattr(mh, "QUOTA", 1)
    monkeypatch.setattr(mh, "GROUP", 2)
    r = random.Random(9)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(90):
        t = list(base)
        for k in r.sample(range(60), r.choice([3, 4, 5, 6])):
            t[k] = f"x{i}_{k}"
        rows.append((i, " ".join(t)))
    found = mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == brute(rows, 1)


def test_a_large_cluster_is_not_verified_pair_by_pair(spark, monkeypatch):
    """300 like texts and 40 that share much with all of them but, at under 0.8, are linked with none: that takes no quota after quota."""
    seen = []
    true_verify = mh._verify

    def counted(docs, classes, pairs, k, percent):
        seen.append(pairs.count())
        return true_verify(docs, classes, pairs, k, percent)

    monkeypatch.setattr(mh, "_verify", counted)
    monkeypatch.setattr(mh, "QUOTA", 2)
    monkeypatch.setattr(mh, "BLOCK", 100)
    monkeypatch.setattr(mh, "HELD", 7, raising=False)
    r = random.Random(5)
    rows = []
    for i in range(340):
        t = [f"b{k}" for k in range(100)]
        for k in r.sample(range(100), 17 if i % 17 < 2 else r.randint(1, 4)):
            t[k] = f"x{i}_{k}"
        rows.append((i, " ".join(t)))
    found = mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1).collect()
    want = brute(rows, 1)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == want
    assert len({c for _, c in want.values()}) == 41 and len(seen) == 2 and seen[1] <= 2 * len(rows)


def beside(rows):
    names = ["bucket", "h", "part", "past", "node", "label", "text"]
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.string()]
    return pa.record_batch([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names)


def test_held_texts_meet_each_other_and_those_that_go_past():
    """Across batches; one link for each pair of components, none between groups."""
    x, y, z = (" ".join(f"{c}{k}" for k in range(20)) for c in "xyz")
    rows = [
        (b"k", 0, 0, False, b"a", b"a", x), (b"k", 0, 0, False, b"b", b"b", y), (b"k", 0, 0, False, b"c", b"c", x + " more"),
        (b"k", 0, 0, True, b"d", b"m", y), (b"k", 0, 0, True, b"e", b"m", y + " more"), (b"k", 0, 0, True, b"f", b"m", z),
        (b"k", 1, 0, False, b"g", b"g", z), (b"k", 1, 0, True, b"h", b"m", x),
        (b"l", 0, 0, False, b"i", b"i", z), (b"l", 0, 0, False, b"j", b"j", z + " more"),
    ]
    for cut in (2, 3, 4, 9, 10):
        batches = [beside(rows[:cut]), beside(rows[cut:])]
        links = [(p["a"], p["b"]) for b in mh._beside(iter(batches), 1, 80) for p in b.to_pylist()]
        assert links == [(b"a", b"c"), (b"b", b"d"), (b"i", b"j")]


def test_a_pair_is_seen_in_its_first_band():
    sets = [np.arange(100, dtype=np.uint64)] * 2
    for bucket, n in ((b"\0", 2), (b"\1", 0)):
        b = block([b"a", b"b"], [b"a", b"b"], sets)
        b = b.set_column(b.schema.get_field_index("bucket"), "bucket", pa.array([bucket] * 2))
        assert sum(x.num_rows for x in mh._across(iter([b]), 80, 8)) == n


def test_similarities_under_the_bands_are_refused(odd):
    with pytest.raises(ValueError, match="79"):
        mh.near_duplicates(odd, percent=79)
    assert mh.near_duplicates(odd, percent=95).count() == 12


def test_clashing_names_keep_their_values(spark):
    names = ["_key", "_row", "_id", "row", "id", "node", "lead", "n", "kept", "ROW_"]
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(2, text, *range(10)), (1, text + " more", *range(10, 20)), (3, "", *range(20, 30))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = sorted(tuple(r) for r in mh.deduplicate(docs).collect())
    assert out == [(1, text + " more", *range(10, 20)), (3, "", *range(20, 30))]
    assert sorted(r.component_id for r in mh.near_duplicates(docs).collect()) == [1, 1, 3]


def test_connected_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 201)]
    labels, _ = mh.connected(spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in path], "a binary, b binary"))
    found = {r.node[0]: r.label[0] for r in labels.collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
