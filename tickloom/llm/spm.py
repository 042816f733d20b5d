"""Exact BPE encoding as the sentencepiece library does it, by a table of each prefix's last token, and decoding.

A BPE encoding is determined by its neighbours: a sequence of tokens is the encoding of its text if and only if each
token encodes to itself and each neighbouring pair encodes to that pair. So every prefix of a word has one last token.
An automaton over the vocabulary gives the tokens that end at a position; of these, the one is stored that is compatible
with the last token of the prefix before it. Ids are then recovered backwards from the word's end.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import ahocorasick
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from .common import held, per_text

SPACE = "▁"
#: Entries of each memory; the older half is forgotten when it is full.
REMEMBERED = 400_000
#: How many characters shorter a known word is looked for.
SHARED = 4


class Memory:
    """A dictionary of bounded size in two halves: what is used again moves to the younger one."""

    def __init__(self, most: int = REMEMBERED):
        self.young, self.old, self.half = {}, {}, most // 2

    def get(self, key):
        if (x := self.young.get(key)) is None and (x := self.old.get(key)) is not None:
            self.put(key, x)
        return x

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Bpe:
    """Encoder and decoder of a sentencepiece BPE model with byte fallback, no normalisation rules and a space put before a text."""

    def __init__(self, path: str):
        self.library = sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.pieces = [sp.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.byte = {int(self.pieces[i][1:-1], 16): i for i in ids if sp.is_byte(i)}
        if sp.normalize(" a  b ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}" or len(self.byte) != 256 or "AÅﬁ" not in sp.normalize("AÅﬁ"):
            raise ValueError("the model isn't one of byte fallback that keeps texts as they are")
        # words: a text can be cut before a space mark if no token has one after another character, and at characters that no token has
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("tokens run over the start of a word")
        self.characters = {c for p in self.ids for c in p}
        self.by_line = "\n" not in self.characters
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if self.merges(p) == [p]:  # others are never the result of merges
                # with each token, whether it may follow another one, as far as that is known
                self.automaton.add_word(p, (p, len(p), {}))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ids))
        self.words, self.told = Memory(), 0
        self.shown = [str(i) for i in ids]

    def merges(self, text: str) -> list[str]:
        """BPE by definition, for texts of two tokens at most: of the mergeable neighbours, those of the best score merge, leftmost first."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str, known: dict[str, bool]) -> bool:
        """Whether b follows a in an encoding. known: b's own verdicts; all are forgotten when there are REMEMBERED."""
        if self.told >= REMEMBERED:
            self.told = 0
            for _, _, x in self.automaton.values():
                x.clear()
        known[a] = out = self.merges(a + b) == [a, b]
        self.told += 1
        return out

    def last_tokens(self, word: str, before: tuple[str, ...] = ()) -> list[str]:
        """The last token of each prefix of a word whose spaces are space marks; a character that no token has is one by
        itself. before: the table of a prefix, which the word's begins with."""
        last, n = list(before), len(before)
        for end, (token, length, known) in self.automaton.iter(word, max(0, n - self.longest)):
            if end < n:
                continue  # that prefix has its token
            if end > n:
                last += word[n:end]
                n = end
            if length <= n:
                a = last[n - length]
                if (ok := known.get(a)) is None:
                    ok = self.compatible(a, token, known)
                if not ok:
                    continue
            last.append(token)
            n += 1
        return last + list(word[n:])

    def tokens(self, last: list[str]) -> list[str]:
        """A word's encoding, read backwards from the last token of each of its prefixes."""
        out, i = [], len(last) - 1
        while i >= 0:
            out.append(last[i])
            i -= len(last[i])
        out.reverse()
        return out

    def encode_word(self, word: str) -> list[int]:
        return self.ids_of(self.tokens(self.last_tokens(word)))

    def parts(self, text: str) -> list[str]:
        """The words of a text, each with the spaces before it, as the text that begins with one more space."""
        return re.findall(r" +[^ \n]*|\n[^ \n]*|[^ \n]+" if self.by_line else r" +[^ ]*|[^ ]+", " " + text) if text else []

    def ids_of(self, tokens: list[str]) -> list[int]:
        """Ids of tokens; a character that is none has those of its bytes."""
        out: list[int] = []
        for t in tokens:
            i = self.ids.get(t)
            out += [self.byte[b] for b in t.encode()] if i is None else [i]
        return out

    def part(self, key: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
        """The ids of a part of a text: a word after a space, or one that begins with a line end or with its spaces. With its
        table, which goes on from that of a known word if all but a few characters agree."""
        if (x := self.words.get(key)) is None:
            before: tuple[str, ...] = ()
            for k in range(1, min(SHARED, len(key) - 1) + 1):
                if known := self.words.young.get(key[:-k]):
                    before = known[1]
                    break
            last = self.last_tokens(key.replace(" ", SPACE) if key[:1] in (" ", "\n") else SPACE + key, before)
            # tuples of plain values, which the garbage collector doesn't go through again and again
            x = (tuple(self.ids_of(self.tokens(last))), tuple(last))
            if len(key) <= 64:
                self.words.put(key, x)
        return x

    def encode(self, text: str) -> list[int]:
        return [i for p in self.parts(text.replace(SPACE, " ")) for i in self.encode_word(p.replace(" ", SPACE))]

    def decode(self, ids: list[int]) -> str:
        """What the library makes of ids."""
        return self.library.decode(ids)

    def digests(self, text: bytes | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of what the library decodes them to."""
        told = (text or b"").decode("utf-8", "replace").replace(SPACE, " ")
        keys = told.replace("\n", " \n").split(" ") if self.by_line else [""]
        if "" in keys:  # several spaces together, or none at the start
            keys = self.parts(told)
        got = list(map(self.words.young.get, keys))
        if None in got:
            got = [x or self.part(k) for x, k in zip(got, keys)]
        ids = list(chain.from_iterable([x[0] for x in got]))
        return len(ids), hashlib.sha256(",".join(map(self.shown.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


def loaded(path: str) -> Bpe:
    """The model at path, read once in each Python worker, and again after another operator's texts."""
    return held(("bpe", path), lambda: Bpe(path))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (doc_id, text). Null and empty texts have no ids and
    decode to an empty text. Texts are encoded whole, however long; equal ones alike. Other columns are ignored, repeated rows
    stay. No rows: no rows."""
    return per_text(docs.select("doc_id", "text"), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", lambda: loaded(path).digests)


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids. Null and empty texts have an empty list; other columns are ignored, repeated rows stay."""
    return per_text(docs.select("doc_id", "text"), "ids array<int>", lambda: (lambda encode: lambda t: (encode((t or b"").decode("utf-8", "replace")),))(loaded(path).encode))


def texts(ids: DataFrame, path: str) -> DataFrame:
    """ids (doc_id, ids) -> doc_id, text: decoding. Null ids: an empty text."""
    from pyspark.sql import functions as F

    out = per_text(ids.select("doc_id", "ids", F.lit("").alias("text")), "decoded string", lambda: (lambda decode: lambda _, i: (decode(i or []),))(loaded(path).decode), also="ids")
    return out.withColumnRenamed("decoded", "text")
