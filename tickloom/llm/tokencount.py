"""Token counts under a unigram model, with the forward scores of distinct pre-tokens shared along a trie.

The vocabulary is a public one, given as ranks; a token of rank r has the probability that Zipf's law gives it,
proportional to 1 / (r + 1). A pre-token is cut so that the product of its tokens' probabilities is largest and, of equal
ones, the number of tokens least. A task keeps one trie of the distinct pre-tokens it has met: a node's forward score depends
on its prefix alone and is computed when the node is made, and a pre-token's end holds its count.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame

from .common import per_text

#: Scores are whole numbers, so that equal ones are seen; the count is carried below them.
SCALE, SHIFT = 1000, 32
#: Nodes of a trie, after which a new one is begun: bounds a task's memory and changes no count.
NODES = 800_000
#: Bytes of a pre-token that have nodes; the scores of what follows stand on a path that goes with the pre-token.
DEEPEST = 64
#: Scores of such a path that are held before its beginning is let go.
PATH = 1 << 14


class Unigram:
    """Counts of pre-tokens and tokens. `children` maps (node, byte), as node * 256 + byte, to a node; `best` has the nodes' scores."""

    def __init__(self, path: str, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte isn't in the vocabulary")
        total = math.log(sum(1 / (r + 1) for r in ranks.values()))
        self.value = {t: (round(-SCALE * (math.log(r + 1) + total)) << SHIFT) - 1 for t, r in ranks.items()}
        self.longest: dict[bytes, int] = {}  # by the last two bytes
        for t in ranks:
            self.longest[t[-2:]] = max(self.longest.get(t[-2:], 1), len(t))
        self.window = max(self.longest.values())
        self.split = regex.compile(pattern).findall
        self.begin()

    def begin(self) -> None:
        """An empty trie: the root, whose score is nothing."""
        self.children: dict[int, int] = {}
        self.best, self.ends = [0], {}

    def forward(self, token: bytes, end: int, scores: list[int], first: int) -> int:
        """The score of token[:end], scores being those of its prefixes of `first` bytes and more."""
        value = self.value
        found = scores[end - 1 - first] + value[token[end - 1 : end]]
        for j in range(max(0, end - self.longest.get(token[end - 2 : end], 1)), end - 1):
            if (piece := token[j:end]) in value and (s := scores[j - first] + value[piece]) > found:
                found = s
        return found

    def insert(self, token: bytes) -> int:
        """The number of tokens of a pre-token, whose prefixes get the nodes they lack."""
        children, best, node, scores = self.children, self.best, 0, [0]
        for end, byte in enumerate(token[:DEEPEST], 1):
            edge = node << 8 | byte
            if (node := children.get(edge)) is None:
                node = children[edge] = len(best)
                best.append(self.forward(token, end, scores, 0))
            scores.append(best[node])
        first = 0
        for end in range(DEEPEST + 1, len(token) + 1):
            if len(scores) > PATH + self.window:
                first += len(scores) - self.window
                del scores[: -self.window]
            scores.append(self.forward(token, end, scores, first))
        return -scores[-1] & ((1 << SHIFT) - 1)

    def added(self, part: str) -> int:
        """insert() of a pre-token that the trie hasn't got; its end is remembered unless it lies too deep."""
        if len(self.best) > NODES:
            self.begin()
        n = self.insert(part.encode())
        if len(part) <= DEEPEST:
            self.ends[part] = n
        return n

    def counts(self, text: bytes | None) -> tuple[int, int]:
        """(pre-tokens, tokens) of a whole text."""
        if not text:
            return 0, 0
        parts = self.split(text.decode())
        found = {p: self.ends.get(p) or self.added(p) for p in set(parts)}
        return len(parts), sum(map(found.__getitem__, parts))


_loaded: dict[tuple[str, str], Unigram] = {}


def counted(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for each row of docs (doc_id, text). Null and empty texts have none. Other columns
    are ignored, repeated rows stay, ties between cuts go to the fewest tokens. No documents: no rows. Texts share the trie of
    their Python worker; no pre-token is shuffled."""

    def counts() -> Callable[[bytes | None], tuple[int, int]]:
        model = _loaded.get((path, pattern)) or _loaded.setdefault((path, pattern), Unigram(path, pattern))
        return model.counts

    return per_text(docs.select("doc_id", "text"), "n_pretokens bigint, n_tokens bigint", counts)
