import random
import re

import numpy as np

from loomwork.llm import decontam as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window):
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            q = words(x)
            n = min(window, len(q))
            for a in range(len(q) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[a : a + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found))
    return out


def case(seed):
    r = random.Random(seed)
    v = ["the", "a", "of", "Ünï", "日本", "x1", "y", "Z"]
    items = [(i, " ".join(r.choice(v) for _ in range(r.choice([0, 1, 2, 3, 5, 12, 20])))) for i in range(12)]
    docs = []
    for i in range(60):
        t = [r.choice(v) for _ in range(r.randint(0, 30))]
        if i % 3 == 0:
            t[r.randint(0, len(t)) : 0] = items[r.randrange(12)][1].split()
        docs.append((i, r.choice([" ", ", ", "\n- "]).join(t)))
    return docs, items


def test_equals_brute_force(spark):
    for seed, window, limit in ((1, 4, 10**6), (2, 10, 10**6), (3, 3, 60), (4, 1, 10**6)):
        docs, items = case(seed)
        found = dc.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window, max_broadcast=limit).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in found} == brute(docs, items, window)


def test_longest_match_and_place(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "zz " + item + " yy " + " ".join(f"q{i}" for i in range(12)))], "doc_id long, text string")
    r = dc.find_overlaps(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert (r.longest_words, r.longest_at, r.longest_item, r.n_hit) == (30, 1, "7", 42)


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the old"), (1, "one"), (2, None), (None, "token"), (3, ""), (4, "!!!")], "item_id long, text string")
    out = dc.find_overlaps(odd, items)
    assert out.columns == [*(c for c in odd.columns if c != "n_words"), *dc.ADDED]
    rows = out.collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert dc.build_test_side(["null", None, "a"], ["x", "x", "x"], 10).ids == ["null", "a", "null"]
    assert by[1]["items"] == by[2]["items"] == by[6]["items"] == ["1"] and by[11]["items"] == ["null"]
    assert (by[3].n_words, by[4].n_words, by[5].n_words, by[9].n_words) == (0, 0, 0, 1)
    clean = dc.decontaminate(odd, items)
    assert clean.columns == odd.columns and clean.count() == 8
    assert dc.find_overlaps(none, items).count() == 0
    assert dc.find_overlaps(odd, items.limit(0)).where("n_hit > 0").count() == 0


def test_suffix_array_is_sorted_at_full_depth():
    r = np.random.default_rng(1)
    for n, v in ((0, 3), (1, 3), (300, 3), (2000, 2), (500, 200)):
        word = r.integers(0, v, n).astype(np.int32)
        if n == 2000:
            word[500:900] = word[1000:1400] = 1
        suffix = lambda i: word[i : i + dc._room(word)[i]].tolist()
        order = dc.suffix_array(word).tolist()
        assert sorted(order) == np.flatnonzero(word).tolist()
        assert all(suffix(a) <= suffix(b) for a, b in zip(order, order[1:]))
    same = np.array([1, 2, 3, 0, 1, 2, 3, 1, 0], np.int32)
    x = dc.Prefixes(same)
    assert dc.common(x, np.array([0, 1, 2, 0]), x, np.array([4, 5, 7, 1])).tolist() == [3, 2, 0, 0]


def test_longest_matches_equal_brute_force(spark):
    for seed, limit in ((5, 10**6), (6, 60)):
        docs, items = case(seed)
        rows = dc.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4, max_broadcast=limit).collect()
        for r in rows:
            w = words(r.text)
            runs = {}
            for i, x in items:
                q = words(x)
                for a in range(len(q)):
                    for p in range(len(w)):
                        n = next((k for k in range(min(len(q) - a, len(w) - p)) if q[a + k] != w[p + k]), min(len(q) - a, len(w) - p))
                        if n >= 4:
                            runs.setdefault((-n, p), set()).add(str(i))
            if runs:
                n, p = min(runs)
                if r.longest_words != -n:  # a shorter item may be whole
                    assert any(len(words(x)) < 4 for _, x in items) and r.longest_words > -n
                else:
                    assert r.longest_at == p and r.longest_item in runs[n, p]


def test_a_window_of_many_items_over_slices(spark):
    shared = " ".join(f"licence{k}" for k in range(14))
    items = [(f"i{k:05d}", f"own{k} {shared} rest{k % 7}") for k in range(10_000)]
    docs = [(1, f"a {shared} b"), (2, "own77 " + shared + " rest0"), (3, "nothing")] + [(10 + k, shared) for k in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    one, many = ({r.doc_id: r for r in dc.find_overlaps(d, b, max_broadcast=m).collect()} for m in (10**8, 500_000))
    assert {i: (r.n_hit, r.longest_words, r.longest_at) for i, r in one.items()} == {i: (r.n_hit, r.longest_words, r.longest_at) for i, r in many.items()}
    for by in (one, many):
        assert by[1].n_hit == 14 and len(by[1]["items"]) == 10_000 and by[3]["items"] == []
        assert (by[2].n_hit, by[2].longest_words, by[2].longest_item) == (16, 16, "i00077")
    assert sorted(r.doc_id for r in dc.decontaminate(d, b, max_broadcast=500_000).collect()) == [3]


def test_clashing_names_keep_their_values(spark):
    names = ["n_words", "N_hit", "items", "longest_words", "slice", "path", "id", "_key"]
    docs = spark.createDataFrame([(1, "one two three", *range(8)), (2, "clean text", *range(8))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    out = dc.decontaminate(docs, items).collect()
    assert [tuple(r) for r in out] == [(2, "clean text", *range(8))]
    assert dc.find_overlaps(docs, items).columns == ["doc_id", "text", "slice", "path", "id", "_key", *dc.ADDED]
