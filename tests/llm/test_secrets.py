import hashlib
import random
import re
import zlib

from feedloom.llm import secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ASSIGN = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    text, out = text or "", []
    out += [(m.start(), 0, "assign", m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(s, e, k) for s, _, k, e in sorted(out)]


def token(body, prefix="ghp_"):
    return prefix + body + secrets.base62(zlib.crc32(body.encode()))


def texts():
    rng = random.Random(3)
    parts = [
        "password", "PassWD", "secret=", "token: '", "api_key", "APIKEY", "=", ":", "  ", '"', "AKIA", "AKIAAKIA", "ſecret=abcdefgh1",
        "0123456789abcdef", "deadbeef", "é", "東", "İ", "\n", "hunter2hunter2", "abc", "==", "passwordpassword=", "toKen=", "A1B2C3D4E5F6G7H8",
    ]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    return out + [None, "", "x" * 100_000 + "password=abcdefgh", "ab" * 60_000, "password=" * 2000 + "short"]


def test_base_spans_equal_plain_search():
    for text in texts():
        assert [s for s in secrets.spans(text) if s[2] in secrets.BASE] == brute(text)


def test_checksums_decide():
    good = token("A" * 30)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    kinds = lambda t: [k for _, _, k in secrets.spans(t)]
    assert kinds(f"x {good} y") == ["github"] and kinds(f"x {bad} y") == []
    assert kinds(token("0" * 30, "npm_")) == ["npm"] and kinds(good + "Z") == []
    assert secrets.masked(f"a {good}, token={'b' * 8}.") == "a [secret], [secret]" and secrets.masked(None) is None


def test_query_columns(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts()[:200] + [None, "", token("q" * 30), "token=" + "a" * 40])]
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 3) for i, t in rows * 2], SCHEMA + ", spans string, kinds int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.op2_secrets(spark, str(tmp_path)).collect()
    assert len(got) == 2 * len(rows)
    for row in got:
        text = dict(rows)[row["doc_id"]]
        wanted = brute(text)
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(k == x for _, _, k in wanted) for x in secrets.BASE]
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in wanted).encode()).hexdigest()
        assert row["spans"] == ",".join(f"{k}:{s}:{e}" for s, e, k in secrets.spans(text))
    assert secrets.mask_secrets(docs).schema == docs.schema
    assert secrets.find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0
