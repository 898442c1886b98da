import hashlib

import edge
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lapse.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a", "I'll we've it's can't 'S 'LL", "don''t", "ΑΣ ΣΑΣ ς", "İstanbul ǅ ﬁ ß ẞ", "é ́ ạ́",
    "<|startoftext|>a<|endoftext|><|endoftext|>b <|END|>", "x<|endoftext|", "12345 ½ ² Ⅳ ٣", "日本語 ひらがな 한국어 가",
    "a b c　d​e f\x85g\x1ch\x1di\x00j", "😀👍🏽 zwj 👩‍💻", "supercalifragilisticexpialidocious" * 30,
    "﻿bom", "!!!???...---", "a" * 3000, "tion" * 500, "` Å  x ;", "Mixed\tTabs\r\nLines\x0b\x0c",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.read_vocabulary(PATH))


def same(library, own, texts):
    names = bpe.token_names(bpe.read_vocabulary(PATH))
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), text
        assert bpe.text_of(ids, names) == library.decode(want, skip_special_tokens=False)


def test_odd_texts(library, own):
    same(library, own, [*ODD, *(t or "" for t in edge.texts())])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_any_text(library, own, texts):
    same(library, own, texts)


@settings(max_examples=300, deadline=None)
@given(st.text("aeinorsth'", max_size=40))
def test_letters_that_merge(library, own, text):
    same(library, own, [text])


def test_full_trie_keeps_what_fits(library, monkeypatch):
    """Prefixes are forgotten when there are too many of them; which tokens can follow each other need not be found again."""
    texts = ["the thin tiger thinks other things", "another thinner tiger there"] * 2
    roomy = bpe.Encoder(bpe.read_vocabulary(PATH))
    roomy.encode(texts[:2])
    monkeypatch.setattr(bpe, "MOST_NODES", 5)
    tight = bpe.Encoder(bpe.read_vocabulary(PATH))
    same(library, tight, texts)
    assert len(tight.trie.nodes) < len(roomy.trie.nodes) and tight.trie.pairs == roomy.trie.pairs


def test_every_plain_character(library, own):
    """The rules for plain text are the tokenizer's."""
    letters = [chr(c) for c in range(bpe.PLAIN + 40)]
    same(library, own, [f"a{c}b 1{c}2 .{c}; {c}{d}" for c, d in zip(letters, letters[1:], strict=False)])


def test_bounded_memory_changes_nothing(library, own, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_NODES", 20)
    monkeypatch.setattr(bpe, "MOST_PAIRS", 5)
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    same(library, own, ODD)


@pytest.mark.parametrize("letters", ["a", "acgt", "=", "wordles"])
def test_a_word_of_a_million_letters(library, letters):
    """Memory grows with the letters, not with their square, and nothing of the word is kept."""
    import random
    import tracemalloc

    own = bpe.Encoder(bpe.read_vocabulary(PATH))
    word = "".join(random.Random(len(letters)).choices(letters, k=1_000_000))
    own.encode(["some words", word[:300]])
    tracemalloc.start()
    (ids,) = own.encode([word])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20 and all(len(w) <= bpe.LONG_WORD for w in own.known)
    assert len(own.trie.nodes) <= 3 * bpe.LONG_WORD
    want = library.encode(word[:20_000], add_special_tokens=False).ids
    assert own.encode([word[:20_000]]) == [" ".join(map(str, want))]
    assert ids.split()[: len(want) - 50] == [str(i) for i in want[:-50]]


def test_prefixes_are_shared(own):
    own.trie.clear()
    own.trie.encode(["international", "internationale", "internet"])
    assert len(own.trie.nodes) == len("internationale") + len("et")


@pytest.mark.parametrize("extra", [False, True])
def test_round_trip(spark, library, extra):
    docs = edge.documents(spark, extra)
    file = bpe.read_vocabulary(PATH)
    rows = bpe.decode(bpe.encode(docs, file), file).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == " ".join(map(str, ids)) and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(edge.empty(spark), file).collect() == []


@pytest.mark.skipif(not edge.have_data(), reason="test tables not present")
def test_query(spark, library):
    from lapse.llm.queries import op2_bpe

    texts = {r["doc_id"]: r["text"] for r in edge.small(spark).collect()}
    for r in op2_bpe(spark, edge.SMALL).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
