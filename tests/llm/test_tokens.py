import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from stranda.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no vocabulary file")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.TOKENIZER)
    t.encode_special_tokens = True
    return t


def encoded(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    return {r.doc_id: r.ids for r in tokens.encode_corpus(df).collect()}


FIXED = [None, "", " ", "\n\n \t", "it's  they'LL we've\n\n  x ", "<|endoftext|>", "a" * 3000, "ab" * 700 + " " * 50 + "z", "  x 　y\x0b\x1c.", "é ١٢ ½²", "\U0010ffff a  b\U0010ffff", "\U0010fffd \U0010fffc  x\U0010fffd\uf8ff", "\x00\x01", "🙂👍🏽", "=" * 500, "x\r\ny", "ꙮ𐍈"]


def test_fixed_texts(spark, library):
    got = encoded(spark, FIXED)
    assert got[0] == got[1] == []
    for i, t in enumerate(FIXED):
        assert got[i] == library.encode(t or "", add_special_tokens=False).ids, repr(t)[:40]
        assert tokens.decode_ids(got[i]) == (t or "")


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdtl1.é a"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=20))
def test_any_texts(spark, library, texts):
    got = encoded(spark, texts)
    assert [got[i] for i in range(len(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def merged_one_by_one(word, merges):
    """The leftmost pair of least rank, one place at a time."""
    rank = {int(p): (k, int(m)) for k, (p, m) in enumerate(zip(merges["pair"], merges["merged"]))}
    ids = [int(merges["byte"][b]) for b in word.encode()]
    while True:
        pairs = [(rank[a * 65536 + b][0], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a * 65536 + b in rank]
        if not pairs:
            return ids
        i = min(pairs)[1]
        ids[i : i + 2] = [rank[ids[i] * 65536 + ids[i + 1]][1]]


def test_words_of_all_lengths(library):
    """Places of one rank contracted in one round give the ids of one place a round, for short and long words alike."""
    merges = tokens.load_merges()
    words = ["aaaaaaaaaaaaaa", "banananana", "mississippi", "=" * 77, "abcabcabcd", "a" * 255, "a" * 256, "a" * 257, "-=" * 300, "x"]
    e = tokens.Encoder(merges)
    e.learn(words)
    flat, starts, sizes = (tokens.np.concatenate(x) for x in (e.flat, e.starts, e.sizes))
    got = [flat[s : s + n].tolist() for s, n in zip(starts, sizes)]
    assert got == [merged_one_by_one(w, merges) for w in words] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_forgetting_changes_nothing(library):
    import pyarrow as pa

    e = tokens.Encoder(tokens.load_merges())
    tokens.CACHE_BYTES, kept = 1, tokens.CACHE_BYTES
    try:
        out = [e.encode(pa.array([t])).to_pylist()[0] for t in ("one two three", "two three four", "one")]
    finally:
        tokens.CACHE_BYTES = kept
    assert out == [library.encode(t, add_special_tokens=False).ids for t in ("one two three", "two three four", "one")]


def test_empty_table_and_repeated_ids(spark):
    assert encoded(spark, []) == {}
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert tokens.encode_corpus(df).count() == 3
