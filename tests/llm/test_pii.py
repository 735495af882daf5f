"""Personal data against the patterns as they stand, on hand-made and on generated texts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from corvex.llm import pii
from corvex.llm.queries import op9_pii


def plain(text):
    """The base spans by the plain patterns."""
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def test_base_equals_plain_patterns():
    rng = random.Random(5)
    alphabet = "ab.@+-0123456789 ()_%é\n"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70)))
        assert [s[:3] for s in pii.find(text) if s[0] in pii.BASE_KINDS] == plain(text), repr(text)


def test_cases():
    assert pii.find(None) == pii.find("") == []
    assert [s[:3] for s in pii.find("é a@b.c@d.e 1.2.3.4.5.6.7.8 999.1.1.1")] == [("email", 2, 7), ("ip", 12, 19), ("ip", 20, 27)]
    kinds = [s[0] for s in pii.find("pay DE89 3704 0044 0532 0130 00 or DE88 3704 0044 0532 0130 00")]
    assert kinds == ["iban"]
    assert [s[0] for s in pii.find("SSN 123-45-6789")] == ["ssn"]
    # A word after the number is no part of it; the country tells the length.
    for text in ("IBAN BE68 5390 0754 7034 BIC KRED", "BE68539007547034 ABC", "GB82 WEST 1234 5698 7654 32 THE", "NO93 8601 1117 947 A"):
        assert [s[0] for s in pii.find(text)] == ["iban"], text
    assert pii.find("XX68 5390 0754 7034") == pii.find("BE68 5390 0754 70345") == []
    # Nearby words lower the score as well as raise it.
    assert pii.find("for example BE68539007547034") == pii.find("ssn of an example: ISBN 123-45-6789 version")[1:] == []
    assert pii.find("bank account, as in the example: BE68539007547034")[0][3] == 0.8
    assert pii.find("part 123-45-6789 of a catalogue") == []
    assert pii.redact("to a@b.co, 10.0.0.1.", pii.find("to a@b.co, 10.0.0.1.")) == "to <EMAIL>, <IP>."


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1 " * 300_000, "+1" * 100_000, "a@" * 100_000, "1." * 100_000):
        pii.find(text)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op9_pii(spark, sf).collect():
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.BASE_KINDS)


def test_nulls_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, None, "x"), (None, "a@b.co", "y"), (1, None, "x"), (2, "", None)], "doc_id long, text string, found string")
    got = sorted((r.doc_id or -1, len(r.found)) for r in pii.detect(rows).collect())
    assert got == [(-1, 1), (1, 0), (1, 0), (2, 0)]
    assert sorted(r.text or "" for r in pii.redacted(rows).collect()) == ["", "", "", "<EMAIL>"]
    assert pii.detect(rows.where(F.lit(False))).count() == 0
