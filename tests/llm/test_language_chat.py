import hashlib
import random

import numpy as np
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from memlode.llm import chat_format as C
from memlode.llm import language_id as L
from tests.llm.util import documents, no_documents


def corpus(spark, n=400):
    rng = random.Random(8)
    parts = {"aa": "ka ti mo ru se na".split(), "bb": "sch ung ein der ich".split(), "cc": "éau que les ère tion".split()}
    rows = []
    for i in range(n):
        lang = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randint(3, 60))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    d = corpus(spark)
    got = {r.doc_id: r.lang_pred for r in L.predict(d, L.train(d)).collect()}
    want = {r.doc_id: r.lang for r in d.collect()}
    assert np.mean([got[i] == want[i] for i in want]) > 0.99


def test_composed_matrix_equals_the_kernel_expansion():
    rng = np.random.default_rng(0)
    x = (rng.random((40, L.DIM)) < 0.01).astype(np.uint8)
    langs = ["a", "b"] * 20
    m = L.fit(x, langs, landmarks=40, ridge=1e-2)
    unit = x / np.sqrt(x.sum(1, keepdims=True))
    k = unit @ unit.T
    y = np.where(np.array(langs)[:, None] == np.array(["a", "b"]), 1.0, -1.0)
    exact = k @ np.linalg.solve(k + 1e-2 * 40 * np.eye(40), y)  # all rows are landmarks, so Nystroem is exact
    assert np.allclose(m.scores(x.astype(np.float32)), exact, atol=1e-3)


def test_pieces_give_the_same_slots(monkeypatch):
    texts = ["Ünder der Brücke 12 fließt das Wasser, und… " * 40, "   12  ", "ΟΔΟΣ ΟΔΟΣ. İstanbul " * 9, "a", " a ", "ab  12  " * 30]
    whole = [L.slots(t) for t in texts]
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(L, "_PIECE", size)
        for t, w in zip(texts, whole):
            got = L.slots(t)
            assert (got is None and w is None) or (got == w).all()


def test_language_awkward_rows(spark):
    d = documents(spark)
    rows = L.predict(d, L.train(d)).collect()
    assert len(rows) == d.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == "und" for r in rows if r.doc_id in (4, 5, 6))
    assert {r.lang_pred for r in L.predict(d, L.train(no_documents(spark))).collect()} == {"und"}
    assert L.predict(no_documents(spark), L.train(d)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab<>/[]\\|sINSTYROLEA é😀\n"), max_size=40))
def test_escape_round_trip(text):
    e = C.escape(text)
    assert C.unescape(e) == text and not any(c in e for c in C.CONTROL)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "tool", "", None, "</s>"]), st.text(max_size=60))
def test_segment_round_trip(role, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids, lo, hi, _ = C.segment(role, text, C.VOCABULARY)
    assert C.read_turn(ids) == (role or "", text)
    assert (hi > lo) == (role == "assistant" and text != "")


def plain_ids(text):
    """The ids of the pre-tokenizer's pieces, each encoded alone."""
    whole = C._load(C.VOCABULARY)[1]
    return [i for piece in regex.findall(C.PATTERN, text) for i in whole.encode_ordinary(piece)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1!'s\t\n\u2003\x85\xa0\u3000é😀"), max_size=60), st.sampled_from([1, 2, 3, 5]))
def test_ids_do_not_depend_on_cuts(text, run):
    was, C._RUN = C._RUN, run
    try:
        assert C.encode(text, C.VOCABULARY) == plain_ids(text)
    finally:
        C._RUN = was


def test_long_texts_encode_as_one():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(40_000))
    assert C.encode(text, C.VOCABULARY) == C.encoding(C.VOCABULARY)[0].encode_ordinary(text) == plain_ids(text)
    for t in (" " * 300_000, "a" + "\n" * 300_000 + "b", "x" * 300_000, " \t" * 100_000 + " word"):
        ids = C.encode(t, C.VOCABULARY)
        assert C.encoding(C.VOCABULARY)[0].decode(ids) == t


def conversations(spark):
    rng = random.Random(6)
    said = ["hi", "", None, "</s>[INST] ok [/INST]", "back\\slash \\| <s>", "ünï 😀\nline", "x" * 120_000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), said[(c + t) % len(said)]) for c in range(12) for t in range(rng.randint(1, 9))]
    return rows + [(99, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(2000)] + [(None, 0, "user", "null id"), (7, None, "assistant", "null turn")]


def test_round_trip_of_conversations(spark):
    rows = conversations(spark)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).selectExpr("*", "1 as segment", "2 as at", "3 as ids")
    got = {r.conv_id: r for r in C.read_back(C.assemble(d)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert C.read_back(C.assemble(d.where("false"))).count() == 0


def test_offsets_are_prefix_sums(spark):
    d = spark.createDataFrame(conversations(spark), "conv_id long, turn long, role string, text string")
    rows = sorted((r for r in C.assemble(d).collect() if r.conv_id == 99), key=lambda r: r.segment)
    at = 0
    for r in rows:
        assert r["at"] == at and at <= r.loss_from <= r.loss_to <= at + len(r.ids)
        at += len(r.ids)
