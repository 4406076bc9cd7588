"""Token counts by finite-state transducers.

The vocabulary is compiled, state by state as texts need them, into a deterministic transducer
over bytes. A state holds what a prefix of a pre-token leaves open: for every place where a
token could still have begun, the trie node reached since, the token before that place and how
many tokens were counted since. A transition carries the change of the count, which may be
negative when a longer token replaces several. Two tokens may stand side by side in an encoding
exactly if encoding their joined bytes gives back those two; of the tokens that could end at a
byte exactly one satisfies that, so states need no search.

Texts are cut into chunks. A chunk's state map is its undecided head (up to the first place
where white space follows something else), the count of its decided middle, and its undecided
tail, which stands for the state it ends in. Maps compose associatively, so they may be made on
any machine in any order and combined by a prefix scan; a chunk without such a place is all head.

NULL counts as an empty text, which has no tokens. Special strings in a text count as one token,
as the library does by default. Repeated rows give repeated results, an empty table an empty
one, and other columns of the input are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import public_tokenizers
import regex
from pyspark.sql import DataFrame

from syndica.llm.common import map_batches, pick
from syndica.llm.pieces import Memo, spaced_pieces, split_pieces, sync_points

VOCABULARY = "byte_bpe_50k.json"
CHUNK = 1 << 16  # characters
MAX_STATES = 200_000


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of bytes in vocabulary files: printable Latin-1 stands for itself,
    the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class Vocabulary:
    tokens: dict[bytes, int]
    merges: dict[tuple[int, int], tuple[int, int]]  # pair -> (rank, merged token)
    special: tuple[str, ...]


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    symbols = byte_symbols()
    special = tuple(t["content"] for t in data.get("added_tokens", ()))
    named = {t: i for t, i in data["model"]["vocab"].items() if t not in special}
    merges = {}
    for rank, merge in enumerate(data["model"]["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        merges[named[a], named[b]] = (rank, named[a + b])
    return Vocabulary({bytes(symbols[c] for c in t): i for t, i in named.items()}, merges, special)


class Transducer:
    """Lazily determinised counter of the tokens of one pre-token."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens, self.merges = vocabulary.tokens, vocabulary.merges
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        for text, token in self.tokens.items():
            node = 0
            for byte in text:
                down = self.trie[node].get(byte)
                if down is None:
                    down = self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(None)
                node = down
            self.ends[node] = token
        self.texts = {i: t for t, i in self.tokens.items()}
        self.pairs: dict[tuple[int | None, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        # a state is a tuple of (trie node, token before, tokens counted since)
        self.states = [((0, None, 0),)]
        self.numbers = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Plain merging of a few tokens, for the pair test."""
        while len(parts) > 1:
            best = min(((self.merges.get(p, (1 << 60, 0))[0], i)
                        for i, p in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i:i + 2] = [self.merges[parts[i], parts[i + 1]][1]]
        return parts

    def allowed(self, before: int | None, token: int) -> bool:
        """Whether ``token`` stands after ``before`` (or at the start) in some encoding."""
        known = self.pairs.get((before, token))
        if known is None:
            text = self.texts[token] if before is None else self.texts[before] + self.texts[token]
            wanted = [token] if before is None else [before, token]
            known = self.merge([self.tokens[text[i:i + 1]] for i in range(len(text))]) == wanted
            if len(self.pairs) > 4 * MAX_STATES:
                self.pairs.clear()
            self.pairs[before, token] = known
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of ``state`` on ``byte``: next state and change of the count."""
        open_, last, gain = [], None, None
        for node, before, since in self.states[state]:
            down = self.trie[node].get(byte)
            if down is None:
                continue
            token = self.ends[down]
            if gain is None and token is not None and self.allowed(before, token):
                last, gain = token, 1 - since
            if self.trie[down]:
                open_.append((down, before, since))
        if gain is None:
            raise ValueError("the vocabulary's merges do not give a unique encoding")
        made = (*((node, before, since + gain) for node, before, since in open_), (0, last, 0))
        number = self.numbers.get(made)
        if number is None:
            number = self.numbers[made] = len(self.states)
            self.states.append(made)
        move = self.moves[state << 8 | byte] = number, gain
        return move

    def count(self, word: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self.reset()  # compiled anew as needed
        state = total = 0
        known = self.moves.get
        for byte in word:
            move = known(state << 8 | byte)
            if move is None:
                move = self.compile(state, byte)
            state, gain = move
            total += gain
        return total


@dataclass(frozen=True)
class StateMap:
    """What a chunk does to a count; ``tail`` is None if the chunk is all head."""

    head: str
    middle: int = 0
    tail: str | None = None


class Counter:
    """Token counts of texts, chunk by chunk."""

    def __init__(self, path: str, pattern: str):
        vocabulary = load_vocabulary(path)
        self.transducer = Transducer(vocabulary)
        self.special = vocabulary.special
        self.cut_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)").split
        self.split = regex.compile(pattern).findall
        self.words = Memo(lambda w: self.transducer.count(w.encode("utf-8")))
        self.pieces = Memo(self._piece)

    def _plain(self, text: str) -> int:
        words = self.words
        return sum([words[w] for w in self.split(text)])

    def _piece(self, piece: str) -> int:
        if not any(s in piece for s in self.special):
            return self._plain(piece)
        parts = self.cut_special(piece)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def decided(self, text: str) -> int:
        """Tokens of text that stands between two places where nothing looks across."""
        known, parts = self.pieces, spaced_pieces(text)
        if parts is None:
            return sum([known[p] for p in split_pieces(text)])
        parts[1:] = [" " + p for p in parts[1:]]
        return sum([known[p] for p in parts])

    def state_map(self, chunk: str) -> StateMap:
        found = sync_points(chunk)
        if found is None:
            return StateMap(chunk)
        first, last = found
        return StateMap(chunk[:first], self.decided(chunk[first:last]), chunk[last:])

    def compose(self, left: StateMap, right: StateMap) -> StateMap:
        if left.tail is None:
            return StateMap(left.head + right.head, right.middle, right.tail)
        if right.tail is None:
            return StateMap(left.head, left.middle, left.tail + right.head)
        # the seam may hold further places to cut, but neither end is open any more
        seam = self.decided(left.tail + right.head)
        return StateMap(left.head, left.middle + seam + right.middle, right.tail)

    def finish(self, whole: StateMap) -> int:
        return self.decided(whole.head) + whole.middle + self.decided(whole.tail or "")

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if len(text) <= chunk:
            return self.decided(text)
        maps = (self.state_map(text[i:i + chunk]) for i in range(0, len(text), chunk))
        *_, whole = accumulate(maps, self.compose)
        return self.finish(whole)


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


def count_tokens(docs: DataFrame, limit: int = 1024, path: str | None = None,
                 chunk: int = CHUNK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every whole text."""
    path = path or public_tokenizers.path(VOCABULARY)
    pattern = public_tokenizers.PATTERN

    def run(batch):
        known: Callable[[str, int], int] = counter(path, pattern).count
        texts = [t or "" for t in batch["text"]]
        counts = [known(t, chunk) for t in texts]
        return {"doc_id": batch["doc_id"], "n_bytes": [len(t.encode("utf-8")) for t in texts],
                "n_tokens": counts, "over_limit": [n > limit for n in counts]}

    docs = pick(docs, doc_id=doc_id, text=text)
    return map_batches(
        docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, "
        "n_tokens bigint, over_limit boolean")
