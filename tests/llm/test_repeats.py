import hashlib
import random

import numpy as np
import pytest

from gapline.llm import phrases, suffixes
from tests.llm.fixtures import documents, empty


def small(spark, seed):
    rng = random.Random(seed)
    passage = [rng.choice("pqrst") for _ in range(30)]
    texts = []
    for _ in range(25):
        w = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(w))
            x = rng.randint(0, 15)
            w[at:at] = passage[x : x + rng.randint(1, 20)]
        texts.append(" ".join(w))
    twice = " ".join(["u", *passage, "v"])
    texts += [" ".join(["s", *passage, "t"]), f"{twice} {twice}", texts[3], texts[3], "x x x x x x x x x x x x x", "x x x x x x x x", "", None, "é à ü é à ü é à ü"]
    return spark.createDataFrame([*enumerate(texts), (5, texts[5]), (None, texts[3]), (None, None), (6, texts[8])], "doc_id long, text string")


@pytest.mark.parametrize(("window", "gram", "hot"), [(5, 2, 2), (8, 8, 1000), (12, 3, 1)])
def test_words_match_brute_force(spark, window, gram, hot):
    docs = small(spark, window)
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
    first = {}
    for d, w in rows:
        for s in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[s : s + window])
                first[k] = min(first.get(k, d), d)
    want = []
    for d, w in rows:
        gone = set()
        for s in range(len(w) - window + 1):
            if d is not None and first[tuple(w[s : s + window])] < d:
                gone.update(range(s, s + window))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    for automaton in (phrases.AUTOMATON, 3):
        out = phrases.remove_repeats(docs, window=window, gram=gram, hot_least=hot, automaton=automaton)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(("window", "gram", "hot"), [(7, 3, 2), (16, 16, 1000), (20, 5, 1)])
def test_bytes_match_brute_force(spark, window, gram, hot):
    docs = small(spark, window)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = {}
    for _, t in rows:
        for s in range(len(t) - window + 1):
            seen[t[s : s + window]] = seen.get(t[s : s + window], 0) + 1
    want = []
    for d, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - window + 1):
            if seen[t[s : s + window]] > 1:
                gone[s : s + window] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        left = bytes(c for c, g in zip(t, gone) if not g)
        want.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    for spread in (1 << 22, 40):
        out = suffixes.remove_repeats(docs, window=window, gram=gram, hot_least=hot, spread=spread)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_bytes_of_the_least_id_beside_none(spark):
    t, part = "0123456789abcdefghijklmnopqrst", "0123456789abcdefghij"
    least = -(1 << 63)
    docs = spark.createDataFrame([(least, t), (None, t), (1, f"{part}-{part}"), (2, "XYZ")], "doc_id long, text string")
    got = suffixes.remove_repeats(docs, window=20, gram=5, keep_text=True).collect()
    want = [(least, 30, 30, 1, b""), (None, 30, 30, 1, b""), (1, 41, 40, 2, b"-"), (2, 3, 0, 0, b"XYZ")]
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], key=repr) == sorted(want, key=repr)


def test_awkward_rows_and_kept_text(spark):
    docs = documents(spark)
    for f, n in ((phrases.remove_repeats, 5), (suffixes.remove_repeats, 6)):
        out = f(docs, window=20, gram=5, keep_text=True)
        got = out.collect()
        assert len(got) == docs.count() and len(out.columns) == n
        for r in got:
            kept = r.kept.encode() if isinstance(r.kept, str) else bytes(r.kept)
            assert hashlib.sha256(kept).hexdigest() == r.kept_sha256
        assert f(empty(spark)).count() == 0


def test_longest_factors_match_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        s = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40)))
        match = lambda i, j: next((k for k in range(len(s)) if max(i, j) + k >= len(s) or s[i + k] != s[j + k]), 0)
        before = [max((match(i, j) for j in range(i)), default=0) for i in range(len(s))]
        after = [max((match(i, j) for j in range(i + 1, len(s))), default=0) for i in range(len(s))]
        p, n = suffixes.longest_factors(np.frombuffer(s, np.uint8).astype(np.int64), 64)
        assert (p.tolist(), n.tolist()) == (before, after)


def test_later_copies_go_and_the_first_stays():
    found = suffixes.repeated_starts([b"abcdefgh-abcdefgh"], [10], 8, earlier_only=True)
    assert found[0].tolist() == [9]
    assert suffixes.repeated_starts([b"abcdefgh-abcdefgh"], [10], 8)[0].tolist() == [0, 9]
