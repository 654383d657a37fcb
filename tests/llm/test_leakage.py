import random

import numpy as np

from stranda.llm.leakage import ItemIndex, leaks, words_of

WORDS = [f"w{i}" for i in range(30)] + ["the", "of"]


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words_of(t) if t else []
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words_of((t or "").partition("\n\n")[2])
        for k in range(len(w) - 11):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, item_text string")
    got = [tuple(r) for r in leaks(d, i, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_against_brute_force(spark):
    """Few words, so that many passages score high without a shared run of twelve."""
    rnd = random.Random(1)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(8, 40)))) for i in range(60)]
    docs = []
    for d in range(120):
        body = [rnd.choice(WORDS + ["other"] * 3) for _ in range(60)]
        if d % 3 == 0:
            w = items[rnd.randrange(60)][1].split()
            n = rnd.choice([9, 11, 12, 13, 20])
            at = rnd.randint(0, max(0, len(w) - n))
            body[20:20] = [x.upper() + rnd.choice(["", ",", " -", "_"]) for x in w[at : at + n]]
        docs.append((d, "From: x\n\n" + " ".join(body)))
    want = brute(docs, items)
    assert want and run(spark, docs, items) == want
    # Items beyond one shard are searched shard by shard.
    assert run(spark, docs, items, shard_chars=1500) == want


def test_wand_finds_what_full_scoring_finds():
    """Skipping by pivots and block maxima loses no item that full scoring brings to the threshold, and adds none."""
    rnd = random.Random(5)
    ix = ItemIndex([(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(12, 40)))) for i in range(150)])
    for _ in range(60):
        terms = np.array(sorted(rnd.sample(range(len(ix.vocab)), rnd.randint(3, 14))))
        score = np.zeros(len(ix.item_ids))
        for t in terms:
            score[ix.items[ix.edges[t] : ix.edges[t + 1]]] += ix.impact[ix.edges[t] : ix.edges[t + 1]]
        assert sorted(ix.candidates(terms)) == np.flatnonzero(score >= 1 - 1e-9).tolist()


def test_candidates_decide(monkeypatch):
    """A shared passage whose item the search doesn't bring up is not reported."""
    text = " ".join(WORDS[:12])
    ix = ItemIndex([(5, text)])
    assert ix.leaked("a: b\n\n" + text) == {5}
    monkeypatch.setattr(ItemIndex, "candidates", lambda self, terms: [])
    assert ix.leaked("a: b\n\n" + text) == set()


def test_no_candidate_is_lost():
    """Each window of twelve words of an item reaches the threshold by itself."""
    rnd = random.Random(2)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(40))) for i in range(40)]
    ix = ItemIndex(items)
    for n, (_, t) in enumerate(items):
        w = [ix.vocab[x] for x in words_of(t)]
        for k in range(len(w) - 11):
            assert n in ix.candidates(np.unique(w[k : k + 12]))


def test_parts_and_odd_texts(spark):
    text = " ".join(WORDS[:12])
    item = [(5, text), (6, None), (7, "too short"), (8, text + " x")]
    html = "Content-Type: text/html\n\n" + "<br>".join(w[0] + "<b>" + w[1:] + "</b> " for w in WORDS[:12])
    split = "Content-Type: multipart/mixed; boundary=b\n\n--b\n\n" + " ".join(WORDS[:6]) + "\n--b\n\n" + " ".join(WORDS[6:12]) + "\n--b--\n"
    docs = [(1, "a: b\n\n" + text), (2, html), (3, split), (4, None), (5, ""), (6, "Subject: " + text + "\n\nnone"), (7, "a: b\n\n" + "> " + "\n> ".join(WORDS[:12]))]
    assert run(spark, docs, item) == {(d, i) for d in (1, 2, 7) for i in (5, 8)}
    assert run(spark, [], item) == set() and run(spark, docs, [(1, None)]) == set()
