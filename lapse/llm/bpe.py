"""BPE encoding and decoding over a trie of distinct words.

A BPE encoding extends like this: if a word's last token is t, what stands before
t is encoded as that prefix is by itself, and t can follow only tokens it is
compatible with (the letters of the two, merged side by side, end as these two).
So a prefix is described by its last token alone. Distinct words go into a trie;
a depth-first walk finds each node's last token among the vocabulary's entries
that end there, and words with a common prefix share its nodes and its work.
A word's ids are read back from its last node upwards. The trie and the words'
encodings are kept by a worker from batch to batch, up to a bounded size.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from lapse.llm.common import by_bytes

END = "</w>"
#: Trie nodes, token pairs and encoded words a worker holds; beyond that it starts anew with these. Results do not depend on it.
MOST_NODES = 250_000
MOST_PAIRS = 200_000
MOST_WORDS = 200_000
#: Letters of a word that leave nodes in the trie, and letters of a word that is remembered.
LONG_WORD = 256
#: Byte letters are below 2^9.
LETTER_BITS = 9

_NEVER = 1 << 60

#: Below this code point normal form changes nothing, lower case stays below it, and every edition of Unicode agrees.
PLAIN = 0x180
#: Of the plain characters, U+0130 changes length in lower case, and U+0000 marks words here.
_NOT_PLAIN = re.compile("[\x00\u0130\u0180-\U0010ffff]")
#: The word pattern (a fixed value of the tokenizer file) that is known here.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _plain_words() -> re.Pattern:
    """`_PATTERN` for plain text."""

    def held(category: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == category)

    letters, digits, spaces = held("L"), held("N"), r"\t-\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+")


_WORDS = _plain_words()


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for 256, 257, ..."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


Side = list[tuple[str, int]]
Follow = dict[str, "Follow | bool"]


class Vocabulary:
    """Tokens, merge ranks and special strings of a tokenizer file with word ends."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("a BPE vocabulary with word ends is expected")
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.longest = max(len(t.removesuffix(END)) for t in self.ids)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # character rules (normal form, case, word pattern) of text that is not plain
        rules = Tokenizer.from_str(file)
        self.normalizer, self.pre_tokenizer = rules.normalizer, rules.pre_tokenizer
        cut = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.plain = cut == [_PATTERN]
        self.letters = [_byte_letters()[b] for b in range(256)]

    def merge(self, symbols: list[str]) -> tuple[list[str], Side, Side]:
        """Merge the pair of least rank, leftmost first, until none is left. Also what the first and the
        last symbol were in turn, each with the rank of the merge that ended it."""
        first, last = [], []
        while len(symbols) > 1:
            rank, at = min((self.rank.get(p, _NEVER), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == _NEVER:
                break
            if at == 0:
                first.append((symbols[0], rank))
            if at == len(symbols) - 2:
                last.append((symbols[-1], rank))
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols, [*first, (symbols[0], _NEVER)], [*last, (symbols[-1], _NEVER)]

    @staticmethod
    def symbols(token: str) -> list[str]:
        body = token.removesuffix(END)
        return [*body[:-1], body[-1] + END] if len(body) < len(token) else [*body]


class Trie:
    """Prefixes of the words met so far. A node is found by its parent and its letter and holds where its
    last token starts; the encoding of what stands before is that of the node there."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.sides: dict[str, tuple[Side, Side, bool] | None] = {}
        self.after: dict[str, Follow] = {}
        self.clear()

    def clear(self) -> None:
        """Forget everything. Entries of `after` refer to each other, so they are emptied."""
        for follow in self.after.values():
            follow.clear()
        #: By token, and "" for the start of a word: by token that may stand next, its own entry here, or False if it cannot.
        self.after = {"": {}}
        self.pairs = 0
        self.sides.clear()
        self.clear_nodes()

    def clear_nodes(self) -> None:
        """Forget the prefixes, not which tokens can stand next to each other."""
        #: (parent << LETTER_BITS | letter) to a node, and by node where its last token starts; node 0 is the root.
        self.nodes: dict[int, int] = {}
        self.starts = [0]
        #: By node, what can follow its last token.
        self.follows = [self.after[""]]

    def encode(self, words: Iterable[str]) -> dict[str, list[str]]:
        """Tokens of each distinct word (in byte letters). Words in sorted order are the depth-first
        walk: what a word shares with the one before stays on the path. Words of more than
        `LONG_WORD` letters leave no nodes."""
        # along the path: the node, where the last token starts, and what can follow it
        tokens: dict[str, list[str]] = {}
        ids, longest = self.vocabulary.ids, self.vocabulary.longest
        path, starts, follows, before = [0], [0], [self.after[""]], ""
        for word in sorted(words):
            if len(self.nodes) > MOST_NODES or self.pairs > MOST_PAIRS:
                if self.pairs > MOST_PAIRS:
                    self.clear()
                else:
                    self.clear_nodes()
                path, starts, follows, before = [0], [0], [self.after[""]], ""
            shared, most = 0, min(len(before), len(word), LONG_WORD)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :], starts[shared + 1 :], follows[shared + 1 :]
            nodes, node_starts, node_follows, node = self.nodes, self.starts, self.follows, path[-1]
            for depth in range(shared + 1, len(word) + 1):
                if depth <= LONG_WORD:
                    key = node << LETTER_BITS | ord(word[depth - 1])
                    node = nodes.get(key)
                    if node is not None:
                        path.append(node)
                        starts.append(node_starts[node])
                        follows.append(node_follows[node])
                        continue
                # the one entry that ends at this depth and is compatible with what stands before it
                for start in range(depth - 1, max(-1, depth - longest - 1), -1):
                    token = word[start:depth]
                    follow = follows[start].get(token)
                    if follow is None:
                        if token not in ids:
                            continue
                        follow = self._follow(word, start, starts, follows, token)
                    if follow is not False:
                        break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
                starts.append(start)
                follows.append(follow)
                if depth <= LONG_WORD:
                    node = nodes[key] = len(node_starts)
                    node_starts.append(start)
                    node_follows.append(follow)
                    path.append(node)
            ended = word + END
            for at in range(len(word) - 1, max(-1, len(word) - longest - 1), -1):
                token = ended[at:]
                follow = follows[at].get(token)
                if follow is None:
                    if token not in ids:
                        continue
                    follow = self._follow(word, at, starts, follows, token)
                if follow is not False:
                    break
            else:
                raise ValueError(f"no token ends {word!r}")
            found = [token]
            while at:
                start = starts[at]
                found.append(word[start:at])
                at = start
            found.reverse()
            tokens[word] = found
            before = word
        return tokens

    def _follow(self, word: str, start: int, starts: list[int], follows: list[Follow], token: str) -> Follow | bool:
        """What can follow an entry that begins at `start`, or False if it does not fit what stands before it."""
        found: Follow | bool = False
        if self._fits(word[starts[start] : start], token):
            found = self.after.get(token)
            if found is None:
                found = self.after[token] = {}
        follows[start][token] = found
        self.pairs += 1
        return found

    def _sides(self, token: str) -> tuple[Side, Side, bool] | None:
        """A token's first and last symbols in turn, and whether their ranks rise; None if its letters
        do not merge to it."""
        if token not in self.sides:
            merged, first, last = self.vocabulary.merge(Vocabulary.symbols(token))
            ranked = all(x[1] < y[1] for side in (first, last) for x, y in zip(side, side[1:], strict=False))
            self.sides[token] = (first, last, ranked) if len(merged) == 1 else None
        return self.sides[token]

    def _fits(self, left: str, right: str) -> bool:
        """Whether the letters of both merge to just these two: as symbols grow on either side of the
        border, no pair across it is ever due before the next merge on its own side."""
        after = self._sides(right)
        if after is None or not left:
            return after is not None
        before = self._sides(left)
        if not (after[2] and before[2]):  # merges out of the order of ranks: try it
            symbols = Vocabulary.symbols(left) + Vocabulary.symbols(right)
            return self.vocabulary.merge(symbols)[0] == [left, right]
        rank, i, j = self.vocabulary.rank, 0, 0
        while True:
            (a, a_ends), (b, b_ends) = before[1][i], after[0][j]
            across = rank.get((a, b), _NEVER)
            # of equal ranks the left one is merged first
            if across < a_ends and across <= b_ends:
                return False
            if a_ends == b_ends == _NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1


class Encoder:
    """Texts to ids; remembers the words that it has met."""

    def __init__(self, file: str):
        self.vocabulary = Vocabulary(file)
        self.trie = Trie(self.vocabulary)
        self.names = {t: str(i) for t, i in self.vocabulary.ids.items()}
        #: Ids joined by spaces, by word; a zero byte comes before words in byte letters, two before special strings.
        self.known: dict[str, str] = {}
        #: Words met before those, from which they are taken over when they are met again.
        self.older: dict[str, str] = {}

    def _words(self, text: str) -> list[str]:
        rules, words = self.vocabulary, []
        for i, part in enumerate(rules.specials.split(text) if rules.specials else [text]):
            if i % 2:
                words.append("\0\0" + part)
            elif rules.plain and not _NOT_PLAIN.search(part):
                words += _WORDS.findall(part.lower())
            else:
                cut = rules.pre_tokenizer.pre_tokenize_str(rules.normalizer.normalize_str(part))
                words += ["\0" + w for w, _ in cut]
        return words

    def _learn(self, words: set[str]) -> None:
        rules, spelt = self.vocabulary, {}
        for w in words:
            if w.startswith("\0\0"):
                self.known[w] = str(rules.special[w[2:]])
            elif w[0] == "\0":
                spelt[w] = w[1:]
            elif w.isascii() and w.isprintable():  # its own byte letters
                spelt[w] = w
            else:
                spelt[w] = "".join([rules.letters[b] for b in w.encode()])
        tokens, names = self.trie.encode(set(spelt.values())), self.names
        for w, spelling in spelt.items():
            self.known[w] = " ".join([names[t] for t in tokens[spelling]])

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of each text, joined by spaces. No reference cycles are given up here, so they are not looked for meanwhile."""
        looked = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if looked:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[str]:
        cut = [self._words(t) for t in texts]
        if 2 * len(self.known) > MOST_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = {w for words in cut for w in words if w not in known}
        for w in new & older.keys():
            known[w] = older[w]
        new -= older.keys()
        self._learn(new)
        found = [" ".join([known[w] for w in words]) for words in cut]
        for w in new:
            if len(w) > LONG_WORD:
                del known[w]
        return found


_ENCODERS: dict[str, Encoder] = {}


def _encoder(file: str) -> Encoder:
    """One per worker process and vocabulary."""
    name = hashlib.sha256(file.encode()).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(file)
    return _ENCODERS[name]


def token_names(file: str) -> dict[str, str]:
    """Tokens by decimal id."""
    spec = json.loads(file)
    names = {str(i): t for t, i in spec["model"]["vocab"].items()}
    return names | {str(t["id"]): t["content"] for t in spec["added_tokens"]}


def text_of(ids: str, names: dict[str, str]) -> str:
    """Tokens joined by spaces, as a tokenizer file without a decoder decodes; unknown ids are left out."""
    known = ids.split()
    try:
        return " ".join(map(names.__getitem__, known))
    except KeyError:
        return " ".join([names[i] for i in known if i in names])


def encode(docs: DataFrame, file: str, text: str = "text") -> DataFrame:
    """`docs` with `n_tokens long, ids string`, every column kept (a clashing one is replaced).

    `file` is the content of the tokenizer file; `ids` are decimal and joined by spaces.
    Null and empty texts have no tokens."""
    docs = docs.drop("n_tokens", "ids")
    shared = docs.sparkSession.sparkContext.broadcast(file)
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("n_tokens long, ids string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in by_bytes(batches, text, 4 << 20):
            found = encoder.encode([t or "" for t in batch.column(text).to_pylist()])
            counts = [x.count(" ") + 1 if x else 0 for x in found]
            added = [pa.array(counts, pa.int64()), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "n_tokens", "ids"])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, file: str, ids: str = "ids") -> DataFrame:
    """`docs` with `decoded string`, every column kept (a clashing one is replaced). Null ids: null."""
    docs = docs.drop("decoded")
    shared = docs.sparkSession.sparkContext.broadcast(file)
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("decoded string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = token_names(shared.value)
        for batch in by_bytes(batches, ids, 4 << 20):
            found = [None if x is None else text_of(x, names) for x in batch.column(ids).to_pylist()]
            column = pa.array(found, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "decoded"])

    return docs.mapInArrow(run, schema)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def digests(docs: DataFrame, file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): a round trip through `encode` and `decode`."""
    there = encode(docs.select(F.col(key), F.col(text).alias("text")), file).drop("text")
    back = decode(there, file)
    return back.select(
        key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
