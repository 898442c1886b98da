"""Personal data: pattern matches, made consistent by a skip-chain random field.

Pattern matches (the base) are certain. A document's mentions - the matches, and
whatever else looks like a number of seven digits or more or holds an `@` - are
the nodes of a conditional random field over the labels none, email, ip, card,
phone. Neighbouring mentions share a chain potential; mentions that repeat or
resemble each other, however far apart, share a skip potential. Loopy
sum-product messages pass until they settle; a mention outside the base whose
label is probable enough becomes an added span.

The potentials are trained piecewise: each factor is fitted by itself to counts
over pattern-labelled documents. A mention that resembles a match of its document
has no known label: it teaches nothing, and what is learned from unmatched
mentions of its shape, which resemble no match, is not held against it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lapse.llm.common import by_bytes

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Mentions further apart than so many characters are no neighbours.
NEAR = 80

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number starts where no digit stands before it: the patterns cannot start later with success
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().-]{0,3}[0-9])++")
_AT = re.compile(r"[^\s@]++@[^\s@]++")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each @ outwards: no run of letters is read twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and not _NOT_LOCAL.match(text, left - 1, left):
            left -= 1
        found = _DOMAIN.match(text, at + 1) if left < at else None
        if found:
            done = found.end()
            yield "email", left, done
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """Pattern matches by start, then kind; offsets in code points, end exclusive."""
    spans = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.groups()):
                spans.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    spans.append(("phone", *m.span()))
    return sorted(spans, key=_place)


def _place(span: Span) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    #: 0 for a mention outside the base, else the number of its label.
    label: int
    shape: str
    #: Mentions with the same key resemble each other.
    key: str


def mentions(text: str, base: list[Span]) -> list[Mention]:
    """Nodes of the field, by start. Base spans are nodes; other mentions must not touch one."""
    found = [_mention(text, s, e, LABELS.index(kind)) for kind, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    loose = [m.span() for m in _AT.finditer(text)] if "@" in text else []
    loose += [m.span() for m in _NUMBER.finditer(text) if len(_digits(m.group())) >= 7]
    last, i = 0, 0
    for s, e in sorted(loose):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= last and not (i < len(taken) and taken[i][0] < e):
            found.append(_mention(text, s, e, 0))
            last = e
    return sorted(found, key=lambda m: (m.start, m.label))


def _mention(text: str, start: int, end: int, label: int) -> Mention:
    body = text[start:end]
    if "@" in body:
        local = body.partition("@")[0].strip("<>()[]{},;:'\"").lower()
        return Mention(start, end, label, "@" + "." * ("." in body.partition("@")[2]), "@" + local)
    digits = _digits(body)
    marks = "".join(c for c in ".(-" if c in body)
    valid = "L" * (14 <= len(digits) <= 19 and luhn(digits))
    return Mention(start, end, label, f"{min(len(digits), 20)}{marks}{valid}", digits[-9:])


def _chain(nodes: list[Mention]) -> list[tuple[int, int]]:
    """Neighbours with at most `NEAR` characters between them."""
    return [(i, i + 1) for i, (a, b) in enumerate(zip(nodes, nodes[1:], strict=False)) if b.start - a.end <= NEAR]


def _skips(nodes: list[Mention]) -> list[tuple[int, int]]:
    """Each mention outside the base and the first match of each kind with its key, so that a match
    speaks to every repeat directly; where there is none, the next mention with its key. Matches with
    one key are linked in turn. At most as many edges as mentions times kinds."""
    hubs = _hubs(nodes)
    seen: dict[str, int] = {}
    edges = []
    for i, m in enumerate(nodes):
        if not m.label and m.key in hubs:
            edges += [(hub, i) for hub in hubs[m.key].values()]
            continue
        if m.key in seen:
            edges.append((seen[m.key], i))
        seen[m.key] = i
    return edges


def _hubs(nodes: list[Mention]) -> dict[str, dict[int, int]]:
    """By key and label, the first base mention."""
    found: dict[str, dict[int, int]] = {}
    for i, m in enumerate(nodes):
        if m.label:
            found.setdefault(m.key, {}).setdefault(m.label, i)
    return found


def _unknown(nodes: list[Mention]) -> list[bool]:
    """Whether a mention is outside the base and has the key of a base mention."""
    hubs = _hubs(nodes)
    return [not m.label and m.key in hubs for m in nodes]


@dataclass(frozen=True)
class Model:
    unary: dict[str, np.ndarray]
    unseen: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


_PRIOR = np.array([2.0, 0.5, 0.5, 0.5, 0.5])


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_docs: int = 20_000) -> Model:
    """Fit the potentials to the pattern matches of about `sample_docs` documents, picked by a hash of
    `key`. What is gathered is bounded by the number of shapes (some hundreds) and label pairs.
    Without documents the potentials are the priors."""
    docs = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("h")).where("text is not null")
    share = min(1.0, sample_docs / max(1, docs.count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            n: Counter = Counter()
            for t in batch.column("text").to_pylist():
                nodes = mentions(t, base_spans(t))
                unknown = _unknown(nodes)
                n.update(("unary", m.shape, m.label, 0) for m, u in zip(nodes, unknown, strict=True) if not u)
                for factor, pairs in (("chain", _chain(nodes)), ("skip", _skips(nodes))):
                    known = ((i, j) for i, j in pairs if not (unknown[i] or unknown[j]))
                    n.update((factor, "", nodes[i].label, nodes[j].label) for i, j in known)
            rows = [(*k, v) for k, v in n.items()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["factor", "shape", "a", "b", "n"]
            )

    sample = docs.where(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003).select("text")
    counts = sample.mapInArrow(count, "factor string, shape string, a long, b long, n long")
    unary: dict[str, np.ndarray] = {}
    # before any count, neighbours are independent and mentions that resemble each other agree
    pairs = {"chain": np.ones((5, 5)), "skip": np.full((5, 5), 0.05) + np.eye(5) * 4.95}
    for r in counts.groupBy("factor", "shape", "a", "b").agg(F.sum("n").alias("n")).collect():
        if r["factor"] == "unary":
            unary.setdefault(r["shape"], _PRIOR.copy())[r["a"]] += r["n"]
        else:
            pairs[r["factor"]][r["a"], r["b"]] += r["n"]
    return Model(
        {s: np.log(c / c.sum()) for s, c in unary.items()}, np.log(_PRIOR / _PRIOR.sum()),
        _association(pairs["chain"]), _association(pairs["skip"]),
    )


def _association(counts: np.ndarray) -> np.ndarray:
    """How much oftener two labels meet than if they were independent, as a logarithm; symmetric."""
    joint = (counts + counts.T) / (2 * counts.sum())
    return np.log(joint) - np.log(joint.sum(0)[:, None]) - np.log(joint.sum(1)[None, :])


def marginals(nodes: list[Mention], model: Model, rounds: int = 30, damping: float = 0.5) -> np.ndarray:
    """Label probabilities of each mention by loopy sum-product; base mentions are clamped. Messages pass
    until they settle, at most `rounds` times and four times for each mention (no path is longer)."""
    unknown = _unknown(nodes)
    shapes = (None if u else m.shape for m, u in zip(nodes, unknown, strict=True))
    own = np.stack([model.unary.get(shape, model.unseen) for shape in shapes])
    for i, m in enumerate(nodes):
        if m.label:
            own[i] = -np.inf  # certain, however many repeats speak against it
            own[i, m.label] = 0.0
    chain, skip = _chain(nodes), _skips(nodes)
    if not chain and not skip:
        return _normal(own)
    one = np.array(chain + skip)
    source = np.concatenate([one[:, 0], one[:, 1]])
    target = np.concatenate([one[:, 1], one[:, 0]])
    edges = len(one)
    reverse = np.concatenate([np.arange(edges, 2 * edges), np.arange(edges)])
    factor = np.concatenate([np.stack([model.chain] * len(chain) + [model.skip] * len(skip))] * 2)
    message = np.zeros((2 * edges, len(LABELS)))
    for _ in range(rounds + 4 * len(nodes)):
        belief = own.copy()
        np.add.at(belief, target, message)
        # what a node knows without its receiver's own message
        known = (belief[source] - message[reverse])[:, :, None] + factor
        top = known.max(1)
        new = top + np.log(np.exp(known - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        moved = np.abs(new - message).max()
        message = damping * message + (1 - damping) * new
        if moved < 1e-4:
            break
    belief = own.copy()
    np.add.at(belief, target, message)
    return _normal(belief)


def _normal(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def spans(text: str, model: Model, least: float = 0.9) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans)."""
    base = base_spans(text)
    nodes = mentions(text, base)
    if all(m.label for m in nodes):
        return base, []
    p = marginals(nodes, model)
    best = p.argmax(1)
    added = [
        (LABELS[best[i]], m.start, m.end)
        for i, m in enumerate(nodes)
        if not m.label and best[i] and p[i, best[i]] >= least
    ]
    return base, added


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with `spans`, every column kept (a clashing one is replaced): all spans by start, then kind;
    `base` tells pattern matches from added ones. Null and empty text: no spans."""
    docs = docs.drop("spans")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"spans {SPANS}").fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    )

    def add(batch: pa.RecordBatch) -> list[pa.Array]:
        found = []
        for t in batch.column(text).to_pylist():
            base, added = spans(t or "", shared.value)
            both = sorted([(*s, True) for s in base] + [(*s, False) for s in added], key=_place)
            found.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in both])
        return [*batch.columns, pa.array(found, kind)]

    return docs.mapInArrow(_each(add, text, [*docs.columns, "spans"]), schema)


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with every span of `text` replaced by its kind, as `<EMAIL>`; spans that overlap are
    replaced together by the kind of the first. Null text stays null."""
    fields = [StructField(f.name, StringType()) if f.name == text else f for f in docs.schema.fields]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        base, added = spans(t, shared.value)
        parts, last = [], 0
        for kind, start, end in sorted(base + added, key=_place):
            if start >= last:
                parts += [t[last:start], f"<{kind.upper()}>"]
            last = max(last, end)
        return "".join([*parts, t[last:]])

    def put(batch: pa.RecordBatch) -> list[pa.Array]:
        new = pa.array([clean(t) for t in batch.column(text).to_pylist()], pa.string())
        return [new if n == text else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]

    return docs.mapInArrow(_each(put, text, docs.columns), StructType(fields))


def _each(change: Callable, text: str, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text):
            yield pa.RecordBatch.from_arrays(change(batch), names=names)

    return run


def listed(spans: Column, base: bool = False) -> Column:
    """kind:start:end of the spans, comma-joined; `base`: of the pattern matches only."""
    spans = F.filter(spans, lambda s: s["base"]) if base else spans
    texts = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(texts, ",")


def counted(spans: Column, kind: str) -> Column:
    """How many pattern matches of a kind there are."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
