import hashlib
import re

import edge
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lapse.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = [int(c) for c in m.group() if "0" <= c <= "9"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], list(PLAIN).index(s[0])))


CASES = [
    "a@b.c", "a@b", "a@@b.c", "x.y+z@-.-.", "@a.b", "a@b.c@d.e", "a@b.c.d@e.f.g", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.02.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111-1", "+1 (437) 555-0689.", "+123456789", "++49 30 1234567-", "ü4111111111111111é",
    "00000000000000", "a@b.c " * 3, "1" * 500, "+1" * 50, "٣٣٣٣.1.2.3", "x@y.z\n+1 (111) 222-3333 9.9.9.9",
]


@pytest.mark.parametrize("text", CASES)
def test_base(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=500, deadline=None)
@given(st.text("a1.2@+- ()49Z", max_size=60))
def test_base_of_any_text(text):
    assert pii.base_spans(text) == plain(text)


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(edge.documents(spark))


def test_repeated_mention_takes_the_label(model):
    text = "Call +1 (437) 555-0689 today. " + "Nothing here. " * 50 + "Again: 437-555-0689, or order 998-111-2223."
    base, added = pii.spans(text, model)
    assert [text[s:e] for _, s, e in base] == ["+1 (437) 555-0689"]
    assert [(k, text[s:e]) for k, s, e in added] == [("phone", "437-555-0689")]


def test_similar_addresses_agree(spark):
    model = pii.train(edge.empty(spark))
    text = "Write to jane.doe@mail.example.org soon. Or jane.doe@mailhost, not to price@ten."
    base, added = pii.spans(text, model)
    assert [text[s:e] for _, s, e in base] == ["jane.doe@mail.example.org"]
    assert [(k, text[s:e].rstrip(",")) for k, s, e in added] == [("email", "jane.doe@mailhost")]


def test_clean_numbers_stay_clean(model):
    for text in ("Lot 1234567 and lot 7654321", "ISBN 978-3-16-148410-0", "4111 1111 1111 1112", ""):
        assert pii.spans(text, model) == ([], [])


def test_messages_agree_with_enumeration(model):
    """On a tree, sum-product is exact."""
    import itertools

    import numpy as np

    text = "1234567 x 555-0689-11 y 998-111-2223"
    nodes = pii.mentions(text, [])
    p = np.zeros((len(nodes), 5))
    own = [model.unary.get(m.shape, model.unseen) for m in nodes]
    for labels in itertools.product(range(5), repeat=len(nodes)):
        w = sum(own[i][x] for i, x in enumerate(labels))
        w += sum(model.chain[a, b] for a, b in zip(labels, labels[1:], strict=False))
        for i, x in enumerate(labels):
            p[i, x] += np.exp(w)
    assert np.allclose(pii.marginals(nodes, model, rounds=200), p / p.sum(1, keepdims=True), atol=1e-3)


def test_untrained_model_and_empty_table(spark):
    model = pii.train(edge.empty(spark))
    assert pii.find(edge.empty(spark), model).collect() == []
    assert pii.spans("a@b.c", model) == ([("email", 0, 5)], [])


@pytest.mark.parametrize("extra", [False, True])
def test_find_and_redact(spark, model, extra):
    docs = edge.documents(spark, extra)
    rows = pii.find(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == plain(r["text"] or "")
    clean = [r["text"] for r in pii.redact(docs, model).collect()]
    assert clean.count(None) == 2 and not any(plain(t or "") for t in clean)
    assert sum("<EMAIL> or <PHONE> from <IP>" in (t or "") for t in clean) == 4


def test_overlapping_spans_are_replaced_once(spark, model):
    docs = spark.createDataFrame([(1, "x +1.22.33.44 y a@1.2.3.4 z")], "doc_id long, text string")
    assert pii.redact(docs, model).first()["text"] == "x +<IP> y <EMAIL> z"


@pytest.mark.skipif(not edge.have_data(), reason="test tables not present")
def test_query(spark):
    from lapse.llm.queries import op3_pii

    texts = {r["doc_id"]: r["text"] for r in edge.small(spark).collect()}
    for r in op3_pii(spark, edge.SMALL).collect():
        base = plain(texts[r["doc_id"]] or "")
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert set(listed.split(",")) <= set(r["spans"].split(","))


def repeats(n, gap="Nothing here. " * 10):
    return "Call +1 (437) 555-0689 today. " + gap + gap.join(f"Again 437-555-0689, number {i}. " for i in range(n))


@pytest.mark.parametrize("n", [1, 2, 3, 6, 10, 100])
def test_every_repeat_takes_the_label(spark, n):
    """However often a number is repeated, each repeat hears of the match."""
    text = repeats(n)
    base, added = pii.spans(text, pii.train(edge.empty(spark)))
    assert [text[s:e] for _, s, e in base] == ["+1 (437) 555-0689"]
    assert [(k, text[s:e]) for k, s, e in added] == [("phone", "437-555-0689")] * n


def test_messages_settle_on_long_paths(model):
    """A chain of neighbours longer than the rounds: messages agree with a forward-backward pass."""
    import numpy as np

    nodes = pii.mentions(" ".join(f"{1000000 + i * 7919} x" for i in range(300)), [])
    chain = np.full((5, 5), -4.0) + np.eye(5) * 4.0
    far = pii.Model({}, np.log(np.full(5, 0.2)), chain, chain)
    own = np.tile(far.unseen, (len(nodes), 1))
    nodes[0] = pii.Mention(nodes[0].start, nodes[0].end, 4, nodes[0].shape, nodes[0].key)
    own[0] = -np.inf
    own[0, 4] = 0.0
    joint = np.exp(chain)
    want = [np.eye(5)[4]]
    for _ in nodes[1:]:
        want.append(want[-1] @ joint / joint[0].sum())
    assert len(pii._chain(nodes)) == len(nodes) - 1 and not pii._skips(nodes)
    assert np.allclose(pii.marginals(nodes, far), want, atol=1e-2)


def test_many_unprefixed_numbers_hide_no_repeat(spark):
    """A model trained on thousands of numbers without a match, and on repeats, still adds repeats only."""
    import random

    rng = random.Random(5)
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    filler = "nothing here " * 10
    rows = [(i, f"Order {number()} and {filler} again {number()}, see {number()}.") for i in range(2000)]
    rows += [(5000 + i, repeats(3).replace("437-555-0689", number())) for i in range(200)]
    for i in range(200):
        own = number()
        rows.append((6000 + i, f"Call +1 {own} now. {filler} Or {own}. {filler} Or {own}."))
    trained = pii.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    for n in (1, 3, 10):
        text = repeats(n)
        assert [(k, text[s:e]) for k, s, e in pii.spans(text, trained)[1]] == [("phone", "437-555-0689")] * n
    assert all(pii.spans(t, trained)[1] == [] for _, t in rows[:300])
    near = f"Call +1 (437) 555-0689, order {number()} or {number()}."
    assert pii.spans(near, trained)[1] == []
