import math
from collections import Counter, defaultdict

import numpy as np
import xxhash

from gapline.llm.common import forest, shingles, words
from gapline.llm.simhash import hamming_links, keep_one, near_duplicates, node_pairs, similar_links, simhash, simhash_components
from tests.conftest import SF
from tests.llm.fixtures import documents, empty


def test_fingerprint_is_the_majority_of_each_bit():
    h = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d")]
    assert simhash(b"A b\tC d") == h[0] & h[1]  # over half of two: both
    assert simhash(b"a b") == xxhash.xxh64_intdigest(b"a b", 42) and simhash(b" \n") == 0


def test_trie_join_finds_every_pair_within_the_budget():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    fp = np.unique(np.concatenate([base, near]))
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if bin(int(fp[i] ^ fp[j])).count("1") <= 3}
    got = [(int(a), int(b)) for i, j, _ in node_pairs(fp, 0, 3) for a, b in zip(i, j)]
    assert len(got) == len(set(got)) and set(got) == want


def brute(rows, linked):
    up = {i: i for i in range(len(rows))}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i], rows[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(rows))]


def test_components_match_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, simhash((r.text or "").encode())) for r in docs.select("doc_id", "text").collect()]
    comp = brute(rows, lambda x, y: bin(x[1] ^ y[1]).count("1") <= 3)
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(rows, comp)), key=repr)
    assert sorted(map(tuple, simhash_components(docs).collect()), key=repr) == want
    assert simhash_components(empty(spark)).count() == 0
    assert hamming_links(spark.createDataFrame([], "fp long")).count() == 0


def jaccard(a, b):
    a, b = (set(shingles(words((t or "").encode()), 5)) for t in (a, b))
    return len(a & b) / len(a | b) if a or b else 1.0


def test_near_duplicates_match_brute_force(spark):
    base = [" ".join(f"x{(i * 37 + k * k) % 997}" for k in range(120)) for i in range(8)]
    texts = base + [b.replace(b.split()[60], "edited") for b in base] + [b + " and more" for b in base[:3]] + ["", None, "short one", "SHORT one"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, texts[2])], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    comp = dict(zip([d for d, _ in rows], brute(rows, lambda x, y: jaccard(x[1], y[1]) >= 0.8)))
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == comp


def test_near_duplicates_find_added_and_cut_blocks(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    texts = []
    for part in (0.80, 0.82, 0.85, 0.90):
        for n in range(18):
            base, more = fresh(400), fresh(int(400 * (1 / part - 1)) - 12)
            edited = (base + more, base[: int(400 * part) + 4], base[:200] + more + base[200:])[n % 3]
            texts += [" ".join(base), " ".join(edited)]
    pairs = list(zip(texts[::2], texts[1::2]))
    assert all(0.8 <= jaccard(a, b) < 0.95 for a, b in pairs)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {n: n - n % 2 for n in range(len(texts))}


def test_near_duplicates_find_every_variant_of_a_text(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 10**9, 600)]
    texts = []
    for _ in range(300):
        w = list(base)
        for at in rng.choice(np.arange(5, 595, 5), 10, replace=False):
            w[at] = f"v{rng.integers(0, 10**9)}"
        texts.append(" ".join(w))
    texts.insert(150, " ".join(base))
    assert all(0.8 <= jaccard(t, texts[150]) for t in texts) and jaccard(texts[0], texts[1]) < 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in near_duplicates(docs).collect()} == {0}
    for size in (400_000, 60_000):
        monkeypatch.setattr("gapline.llm.simhash.UNIT_BYTES", size)
        assert {r.component_id for r in near_duplicates(docs).collect()} == {0}


def test_shuffled_words_do_not_hide_a_near_copy(spark):
    w = [f"w{i}" for i in range(120)]
    mixed = [w[(i * 37 + 11) % 120] for i in range(120)]
    texts = [w, mixed, [*mixed[:-2], mixed[-1], mixed[-2]]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {0: 0, 1: 1, 2: 1}


def similar_pairs(sets):
    """All pairs of different sets with a similarity of 0.8 or more: they share one of the rarest fifth of each one's shingles."""
    freq = Counter(g for x in sets for g in x)
    index, pairs = defaultdict(list), set()
    for n in sorted(range(len(sets)), key=lambda n: len(sets[n])):
        x = sorted(sets[n], key=lambda g: (freq[g], g))
        rare = x[: len(x) - math.ceil(0.8 * len(x) - 1e-9) + 1]
        for m in {m for g in rare for m in index[g]}:
            both = len(sets[n] & sets[m])
            if both >= 0.8 * (len(x) + len(sets[m]) - both) - 1e-9:
                pairs.add((m, n))
        for g in rare:
            index[g].append(n)
    return pairs


def test_near_duplicates_of_a_corpus_are_those_of_all_pairs(spark):
    """Recall at sf0.1 is 1: every pair of similarity 0.8 or more is linked, and components are just those of such pairs."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text").collect()]
    own = [frozenset(shingles(words((t or "").encode()), 5)) for _, t in rows]
    sets = list(dict.fromkeys(own))
    place = {x: n for n, x in enumerate(sets)}
    pairs = similar_pairs(sets)
    label = forest(len(sets), *np.array(sorted(pairs)).T)
    low = {}
    for (d, _), x in zip(rows, own):
        k = int(label[place[x]])
        low[k] = min(low.get(k, d), d)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 30 and got == {d: low[int(label[place[x]])] for (d, _), x in zip(rows, own)}


def test_similar_links_match_brute_force():
    rng = np.random.default_rng(7)
    base = [rng.choice(500, n, replace=False) for n in (1, 2, 9, 10, 40, 200)]
    sets = [np.unique(np.r_[rng.permutation(b)[: max(1, int(len(b) * rng.uniform(0.7, 1)))], rng.choice(500, int(len(b) * rng.uniform(0, 0.2)))]).astype(np.uint64) for b in base for _ in range(30)]
    near = lambda x, y: len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))
    for side in (np.zeros(len(sets), int), rng.integers(0, 2, len(sets)), rng.choice([0, 2], len(sets))):
        apart = {0: (), 1: (0,), 2: (0, 2)}[side.max()]  # sides within which nothing is compared
        some = lambda x, y: near(x[1][1], y[1][1]) and not (x[1][0] == y[1][0] and x[1][0] in apart)
        rows = list(enumerate(zip(side, sets)))
        links = set(similar_links(sets, side, 0.8))
        assert all(near(sets[a], sets[b]) for a, b in links)
        assert brute(rows, lambda x, y: (x[0], y[0]) in links or (y[0], x[0]) in links) == brute(rows, some)


def test_keep_one_keeps_one_row_of_each_group(spark):
    docs = documents(spark)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 2 and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert 0 in ids and not {60, 61} & set(ids)
    assert keep_one(empty(spark)).count() == 0
