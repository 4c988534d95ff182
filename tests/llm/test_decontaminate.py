import random

import pytest

from memlode.llm import decontaminate as D
from tests.llm.util import documents, no_documents


def plain(text, k=5):
    w = D.fold_words((text or "").encode())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def cases():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choices(vocab, k=rng.choice((2, 4, 5, 9, 30, 60)))) for _ in range(40)] + ["", None]
    docs = []
    for i in range(120):
        body = rng.choices(vocab, k=rng.randint(0, 400))
        if i % 2:
            piece = (items[i % 40]).split()
            if i % 4 == 1 and len(piece) > 8:
                piece[len(piece) // 2] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = piece
        docs.append(" ".join(body))
    return items, docs + [items[0], items[3], None]


@pytest.mark.parametrize("block_bytes", [1 << 20, 1500, 400])
def test_brute_force(spark, block_bytes):
    items, docs = cases()
    want = set()
    for i, d in enumerate(docs):
        for j, t in enumerate(items):
            s = plain(t)
            own = plain(d, min(5, len((t or "").split()) or 5))
            if s and len(s & own) / len(s) >= 0.8:
                want.add((i, j, round(len(s & own) / len(s), 9)))
    a = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(r.containment, 9)) for r in D.contaminated(a, b, block_bytes=block_bytes).collect()}
    assert got == want and len(want) > 20
    kept = {r.doc_id for r in D.decontaminate(a, b, block_bytes=block_bytes).collect()}
    assert kept == set(range(len(docs))) - {w[0] for w in want}


def test_short_items_inside_long_texts():
    find = D.Searcher(["four word test item", "one", "two words", "five words are a shingle"])
    text = "A sentence with a four-word test item in it; it has two words more. " * 3
    assert find.search(text.encode()) == [(0, 1.0), (2, 1.0)] and find.search(b"One!") == [(1, 1.0)] and find.search(b"item four word test") == []


def test_sketches_prune_and_lose_nothing():
    rng = random.Random(5)
    items = [" ".join(f"i{j}w{rng.randrange(50)}" for _ in range(rng.choice((8, 20, 60, 300)))) for j in range(60)]
    find = D.Searcher(items)
    far = false = 0
    for j, t in enumerate(items):
        w = t.split()
        n = len(find.shingles(j))
        for cut in range(0, len(w), max(1, len(w) // 12)):
            text = " ".join(["before", *w[cut:], "after"]).encode()
            share = len(set(find._shingles(w[cut:] and [x.encode() for x in w[cut:]])) & set(find.shingles(j))) / n if len(w) - cut >= 5 else 0
            assert (share >= 0.8) == (j in [i for i, _ in find.search(text)])
            far += share < 0.5
            false += share < 0.5 and j in find.candidates(text)
    assert far > 300 and false <= 0.02 * far  # a sketch is a sample: few that are far from contained get through, and are verified
    assert all(p[1].size <= sum(len(find.shingles(j)) for j in range(60)) for p in find.partitions)


def test_a_text_in_pieces(monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    text = ("filler words " * 40 + item + " more words" * 40).encode()
    monkeypatch.setattr(D, "_PIECE", 97)
    assert D.Searcher([item]).search(text) == [(0, 1.0)]


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog and runs"), (1, "The quick brown fox jumps over the lazy dog and runs"), (None, "one two three"), (3, None)], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id or -1) for r in D.contaminated(documents(spark), items).collect())
    assert got == [(-1, 1), (1, 1), (2, 1), (2, 1), (3, 1), (8, -1)]
    assert D.contaminated(no_documents(spark), items).count() == 0
    assert D.contaminated(documents(spark), items.where("false")).count() == 0
    clean = D.decontaminate(documents(spark), items)
    assert clean.columns == documents(spark).columns and clean.count() == documents(spark).count() - 6
