import hashlib
import random
import re
import zlib

from gapline.llm.secrets import ASSIGN, BASE62, automaton, scan, spans
from tests.llm.fixtures import documents, empty


def brute(t):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(found, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_matches_plain_patterns_on_made_texts():
    rng, a = random.Random(5), automaton()
    bits = ["password", "PassWd", "secret", "token", "api_key", "apikey", "API_KEY", '"', "'", " ", ":", "=", "abcdefgh", "x", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "ÿ", "İ", "ſecret", "toKen", "\n", "-"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert spans(t, a) == brute(t), t
    assert spans("secret: token: abcdefghij", a) == []  # the failing match takes "token" along


def test_checksums_decide():
    body = "abcdefghijABCDEFGHIJ0123456789"
    n, check = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        check = BASE62[r] + check
    good = f"ghp_{body}{check.rjust(6, '0')}"
    a = automaton()
    assert spans(f"see {good}.", a) == [("checked", 4, 4 + len(good))]
    assert spans(f"see {good[:-1]}{'a' if good[-1] != 'a' else 'b'}.", a) == [] and spans(f"x{good}", a) == []


def test_rows(spark):
    docs = documents(spark)
    out = scan(docs).collect()
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    assert len(out) == len(texts)
    want = sorted(((d, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in brute(t)).encode()).hexdigest()) for d, t in texts), key=repr)
    assert sorted(((r.doc_id, r.base_sha256) for r in out), key=repr) == want
    assert scan(empty(spark)).count() == 0
