import random

import numpy as np
import pytest

from memlode.llm import simhash
from tests.llm.util import documents, no_documents


def brute(fps, tau):
    """Least index reachable over links of at most tau bits."""
    f = np.array(fps, dtype=np.int64).view(np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= tau
    label = np.arange(len(f))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(f))])
        if (new == label).all():
            return label.tolist()
        label = new


def test_fingerprint_matches_a_plain_count():
    import xxhash

    text = "A bé c D e F g a b c D e"
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


@pytest.mark.parametrize("tau", [1, 3, 4])
@pytest.mark.parametrize("tile", [4096, 8])
def test_links_span_the_brute_force_classes(spark, tau, tile):
    rng = random.Random(tau)
    centres = [rng.getrandbits(64) for _ in range(12)]
    raw = {0}
    for _ in range(400):
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 7)):
            x ^= 1 << rng.randrange(64)
        raw.add(x)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in raw)
    from memlode.operators.graph import connected_components

    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), tau, tile)
    got = dict(connected_components(links).collect())
    label = {x: got.get(x, x) for x in fps}
    want = brute(fps, tau)
    assert [label[x] for x in fps] == [fps[i] for i in want]


def test_awkward_rows(spark):
    out = simhash.near_duplicates(documents(spark)).collect()
    assert len(out) == documents(spark).count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.component_id)
    assert by[1] == [1] and by[2] == [1, 1]
    assert by[4] == by[5] == by[6] == [4]
    assert None in by and 1 in by[None]


def test_one_document_of_each_class_stays(spark):
    d = documents(spark)
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in kept.collect())
    ids = [g[1] for g in got if g[0]]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(4) == 1 and 5 not in ids and ids.count(11) == 2
    assert sum(not g[0] for g in got) == 1


def test_empty(spark):
    assert simhash.near_duplicates(no_documents(spark)).count() == 0
    assert simhash.keep_one(no_documents(spark)).count() == 0
