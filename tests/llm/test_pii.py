"""Personal data against the patterns as they are defined."""

import hashlib
import random
import re

import pytest

from citeharbor.llm import pii
from citeharbor.llm.queries import QUERIES
from tests.llm.conftest import edge_rows

SIMPLE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    number = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number)))
        return 12 <= len(number) <= 19 and total % 10 == 0
    if kind == "phone":
        return 9 <= len(number) <= 15
    return True


def plain(text):
    found = [(m.start(), rank, kind, m.end()) for rank, (kind, p) in enumerate(SIMPLE.items())
             for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return sorted(found)


def check(frame, rows):
    got = {r.doc_id: r for r in pii.digest(pii.personal_data(frame)).collect()}
    for i, text in rows:
        want = plain(text)
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (text, line)
        assert [got[i][f"n_{k}"] for k in SIMPLE] == [sum(x[2] == k for x in want) for k in SIMPLE]
        spans = got[i].spans.split(",") if got[i].spans else []
        assert set(line.split(",") if line else []) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), ["email", "ip", "card", "phone", "secret"].index(s.split(":")[0]), int(s.split(":")[2])))
    assert len(got) == len({i for i, _ in rows})


@pytest.mark.parametrize("alphabet", ["a@.-+ ", "01.25 ", "0123456789 -", "+(). -0123456789", "aé@.1+ -\n%_"])
def test_random_texts(docs, alphabet):
    rng = random.Random(len(alphabet))
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(400)]
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111 2", "x4111111111111111", "1 4111111111111111", "378282246310005"]
    rows += [(1000 + k, f"é {c}, {c} a@b.c+d@e.f..g@h.i") for k, c in enumerate(cards)]
    check(docs(rows), rows)


def test_documents_match_the_simple_patterns(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    assert sum(len(plain(t)) for _, t in rows) > 0
    check(table, rows)


def test_very_long_runs(docs):
    rows = [(1, "1 " * 60_000), (2, "9" * 100_000), (3, "a." * 50_000), (4, "x@" + "a." * 30_000 + "b"), (5, "+1" + "." * 50_000),
            (6, "1." * 40_000), (7, "c@d.e " * 3_000), (8, None), (9, "")]
    # The simple patterns read such runs over and over; what they find is known.
    got = {r.doc_id: r for r in pii.digest(pii.personal_data(docs(rows))).collect()}
    assert [got[i].n_email for i in range(1, 10)] == [0, 0, 0, 1, 0, 0, 3000, 0, 0]
    assert got[6].n_ip == 10_000
    assert [got[i].n_card + got[i].n_phone for i in range(1, 10)] == [0] * 9


def test_edge_cases(docs):
    rows = [r for r in edge_rows() if r[0] not in (4, None)]
    check(docs(rows), rows)
    assert len(pii.digest(pii.personal_data(docs(edge_rows()))).collect()) == len(edge_rows())
    assert pii.digest(pii.personal_data(docs([]))).collect() == []


def test_votes_add_spans_and_drop_decoys(docs):
    rows = [(i, f"Call +1 (415) 555-{1000 + i} now or mail me at joe{i}@mail.com") for i in range(200)]
    rows += [(1000 + i, f"phone (415) 555-{2000 + i} today") for i in range(50)]
    rows += [(2000 + i, f"password=b7db7aa4a5{1000 + i}") for i in range(50)]
    rows += [(3000 + i, f"see 9999 8888 7777 {6000 + i} there") for i in range(50)]
    got = {r.doc_id: r.spans for r in pii.digest(pii.personal_data(docs(rows))).collect()}
    assert sum("card" in got[3000 + i] for i in range(50)) < 10
    assert sum("phone" in got[1000 + i] for i in range(50)) == 50
    assert sum("secret" in got[2000 + i] for i in range(50)) == 50


def test_reliabilities_recover_planted_labelers():
    rng = random.Random(1)
    right = [0.95, 0.8, 0.7, 0.9]
    counts = {}
    for _ in range(20_000):
        truth = rng.random() < 0.4
        votes = tuple((1 if truth else -1) * (1 if rng.random() < r else -1) for r in right)
        counts[votes] = counts.get(votes, 0) + 1
    share, good = pii.reliabilities(sorted(counts.items()), 0.5)
    assert abs(share - 0.4) < 0.03
    for k, r in enumerate(right):
        assert abs(good[1][k][1] - r) < 0.03


def test_whole_query_runs_no_python(spark, sf_dir):
    plan = QUERIES["op2_personal_data"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
