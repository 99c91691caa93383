"""Anchored parsers against plain patterns, added kinds, redaction."""

import hashlib
import random
import re
import time

import pytest

from driftloom.llm.pii import BASE, ORDER, find, luhn, personal_data, redact, span_digest
from driftloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_random_texts_equal_the_patterns():
    rng = random.Random(1)
    pools = ["a@.-", "0123456789", "+1 ().-", "@é😀 \n", "12 .", "0.1+", "5-5 "]
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 40)))
        assert [s for s in find(text) if s[0] in BASE] == brute(text), text


def test_query_equals_brute_force_on_its_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = QUERIES["op7_pii"](spark, SF).collect()
    assert len(out) == len(docs) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in out) > 20
    for r in out:
        spans = brute(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in BASE]
        assert r.base_sha256 == digest(spans)
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in find(docs[r.doc_id]))


def test_added_kinds():
    text = "see https://a.example/x?y=1. IBAN: DE89 3704 0044 0532 0130 00 password=hunter22x IBAN GB00WEST12345698765432"
    found = {k: text[a:b] for k, a, b in find(text)}
    assert found["url"] == "https://a.example/x?y=1" and found["secret"] == "hunter22x"
    assert found["account"].startswith("DE89") and "GB00" not in str(found)


@pytest.mark.parametrize("piece", ["a://", "://", "a:// ", "1a://.,", "a@", "+1 ", "1.", "password ", "IBAN ", "token=", "account no ", "1-1 ", "https://x.yz,"])
def test_long_texts_take_time_in_proportion(piece):
    """A megabyte of anchors; what is read again for each of them would take minutes."""
    text = piece * (1_000_000 // len(piece))
    start = time.process_time()
    find(text)
    assert time.process_time() - start < 30


def test_urls_inside_urls():
    assert [s for s in find("a://b://c, d://e ://f") if s[0] == "url"] == [("url", 0, 9), ("url", 11, 16)]


def test_edges(spark):
    schema = "doc_id long, text string, spans string, kind int"
    rows = [(1, None, "", 1), (2, "", "", 1), (None, "a@b.cc", "", 1), (3, "1" * 60_000, "", 1), (4, "+1 " * 20_000, "", 1), (5, "a@b.cc", None, None), (5, "a@b.cc", None, None)]
    df = spark.createDataFrame(rows, schema)
    out = sorted(span_digest(personal_data(df)).collect(), key=str)
    assert len(out) == len(rows) and sum(r.n_email for r in out) == 3 and out == sorted(span_digest(personal_data(df.repartition(5))).collect(), key=str)
    assert next(r for r in out if r.doc_id == 1).base_sha256 == digest([])
    clean = redact(df)
    assert clean.columns == df.columns and {r.text for r in clean.filter("doc_id = 5").collect()} == {"[email]"}
    assert clean.filter("doc_id = 1").first().text is None
    assert personal_data(df.limit(0)).collect() == [] and redact(df.limit(0)).collect() == []
