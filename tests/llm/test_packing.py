"""Packing: the library's ids, whole coverage, full sequences, and the subset search by brute force."""

import itertools
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from citeharbor.llm import packing
from citeharbor.llm.queries import QUERIES
from tests.llm.conftest import edge_rows


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.default_tokenizer())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


ODD = ["", " ", "\n", "a<|endoftext|> b", " <|endoftext|>x", "\n\n日-ǅ", "\nx\n y\n\nz \n w", "don't we'll é's ×'s", "a  b   c",
       "x y  z", "\x1ca\x85 b", "tail  ", "aà, ÷, ÿ!"]


def test_segments_give_the_ids_of_whole_texts(library):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("aB.,'' \n\tst<|é1!  　 Ġ×÷ÿñ\x1c\x85_-日ǅ́​") for _ in range(30))
                   for _ in range(5000)]
    chars = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    texts += [f"a{c}.b c\n{c} {c}'s" for c in chars]
    coder = packing.Segments(packing.default_tokenizer())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from the remembered segments
        assert [t for t, g, w in zip(texts, coder.batch(pa.array(texts)), want) if g.tolist() != w] == []


def test_another_tokenizer_is_used_as_it_is():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [t for t in ODD if t]
    other = Tokenizer.from_file(path)
    assert [x.tolist() for x in packing.Segments(path).batch(pa.array(texts))] == [ids_of(other, t) for t in texts]


def test_subset_against_all_subsets():
    rng = random.Random(3)
    for _ in range(300):
        lengths = {rng.randint(1, 30): rng.randint(0, 3) for _ in range(rng.randint(0, 5))}
        target = rng.randint(0, 60)
        best, counts = packing.subset(lengths, target)
        sums = (sum(x * n for x, n in zip(lengths, c))
                for c in itertools.product(*[range(n + 1) for n in lengths.values()]))
        assert best == max(s for s in sums if s <= target)
        assert sum(x * n for x, n in counts.items()) == best
        assert all(0 < n <= lengths[x] for x, n in counts.items())


@pytest.mark.parametrize("seed", range(8))
def test_plans_place_every_id_and_leave_no_slack(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 32, 64])
    histogram = {rng.randint(1, capacity - 1): rng.choice([1, 2, 7, 400]) for _ in range(rng.randint(1, 12))}
    if seed == 7:
        histogram, capacity = {11: 1000}, 16  # one length only: every sequence needs a cut
    plan = packing.Plan(dict(histogram), capacity)
    used = defaultdict(list)
    for length, n in histogram.items():
        for rank in range(n):
            pieces = list(plan.places(length, rank))
            assert [p[0] for p in pieces] == list(itertools.accumulate([0] + [p[1] for p in pieces[:-1]]))
            assert sum(p[1] for p in pieces) == length
            for _, size, sequence, offset in pieces:
                used[sequence] += range(offset, offset + size)
    total = sum(x * n for x, n in histogram.items())
    assert sorted(used) == list(range(plan.sequences))
    sizes = Counter(len(v) for v in used.values())
    assert all(sorted(v) == list(range(len(v))) for v in used.values())
    assert sizes[capacity] == total // capacity
    assert sum(s for s in sizes.elements() if s < capacity) == total % capacity
    assert all(s & (s - 1) == 0 and (n == 1 or s == capacity) for s, n in sizes.items())


def check(rows, documents, library, capacity=1024, end_id=0):
    """Every id of every document in one piece; every sequence gapless and full or a power of two."""
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for doc_id, text in documents:
        ids = ids_of(library, text) + [end_id]
        want[doc_id, len(ids)] += 1
        found = sorted(by_doc[doc_id, len(ids)], key=lambda r: r["start"])
        for r in found:
            raw = np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes()
            assert r["length"] > 0
            if want[doc_id, len(ids)] == 1 and documents.count((doc_id, text)) == 1 and doc_id is not None:
                assert zlib.crc32(raw) == r["ids_crc32"]
    assert set(by_doc) == set(want)
    for (_, n), found in by_doc.items():
        copies = want[_, n]
        assert sum(r["length"] for r in found) == n * copies
        covered = Counter(i for r in found for i in range(r["start"], r["start"] + r["length"]))
        assert set(covered.values()) == {copies} and len(covered) == n
    sizes = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        sizes.append(at)
    short = [s for s in sizes if s != capacity]
    assert all(s < capacity and s & (s - 1) == 0 for s in short) and len(short) == len(set(short))


def crc_rows(pieces):
    return [{**r.asDict(), "ids_crc32": zlib.crc32(r["ids"])} for r in pieces.collect()]


def test_edge_rows(docs, library):
    rows = edge_rows()
    check(crc_rows(packing.pack(docs(rows).repartition(3))), rows, library)


def test_small_capacity_and_copies(docs, library):
    rows = [(i, "one two three four five") for i in range(200)] + [(1000 + i, "a b " * i) for i in range(40)]
    check(crc_rows(packing.pack(docs(rows).repartition(4), capacity=16)), rows, library, capacity=16)


def test_empty_table(docs):
    assert packing.pack(docs([])).count() == 0


def test_query_on_the_whole_table(spark, sf_dir, library):
    documents = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check([r.asDict() for r in QUERIES["op11_packing"](spark, sf_dir).collect()], documents, library)
