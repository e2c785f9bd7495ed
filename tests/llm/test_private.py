"""Personal data against plain regular expressions, and discovery by context."""

import hashlib
import re

from rainrisk.llm import private

EMAIL, PHONE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IP, CARD = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+")
SCHEMA = "doc_id long, text string"
TEXTS = [None, "", "a@b.c@d.ef x.@y-z.w..u q@@r.st @a.b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 79927398713",
         "+1 (743) 555-3824 +49.89-1234 5678 +1 2 +" + "1" * 20, "é😀 mail me.now+tag@sub.example.co.uk!", "4242424242424242" * 3, "1" * 9000 + ".1.1.1", "u" * 9000 + "@x.yz",
         "tel +1 555 010 9999 4111111111111111 10.0.0.1"]


def luhn(s):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def plain(text):
    t = text or ""
    found = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(t)]
    found += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(t) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(t) if 12 <= len(re.sub(r"\D", "", m[0])) <= 19 and luhn(re.sub(r"\D", "", m[0]))]
    found += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(2, TEXTS[2]), (None, TEXTS[6])], SCHEMA)
    got = private.scanned(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = plain(TEXTS[r["doc_id"] if r["doc_id"] is not None else 6])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["spans"] == want and r["n_added"] == 0
        assert r["n_email"] == want.count("email:") and r["n_card"] == want.count("card:")


def test_contexts_discover_unseen_identifiers(spark):
    known = [(i, f"please write to user{i}@example.com today, badge number AB-{i}77 is lost") for i in range(12)]
    docs = spark.createDataFrame(known + [(90, "please write to user77_at_example today"), (91, "they sold 1234567 stones today")], SCHEMA)
    got = {r["doc_id"]: r for r in private.scanned(docs).collect()}
    assert got[90]["spans"] == f"email:16:{16 + len("user77_at_example")}" and got[90]["n_added"] == 1
    # a context without seeds discovers nothing
    assert got[91]["spans"] == "" and all(got[i]["n_added"] == 0 for i in range(12))


def test_copies_add_no_evidence(spark):
    docs = spark.createDataFrame([(i, "please write to user1@example.com today") for i in range(30)] + [(90, "please write to user77_at_example today")], SCHEMA)
    assert {r["n_added"] for r in private.scanned(docs).collect()} == {0}


def test_empty(spark):
    assert private.scanned(spark.createDataFrame([], SCHEMA)).count() == 0
