"""Secrets in texts: three patterns, and strings that a tokenizer cannot shorten.

The patterns find assignments to telling names, access keys and long hexadecimal runs. The
token-efficiency test adds the rest: ordinary words and names are in a tokenizer's vocabulary in
large parts, random strings are not, so few characters per token under a general vocabulary give
them away. It looks at runs of at least ``min_chars`` key characters; a run is cut at spans of the patterns, and what remains of it is tested by itself. Known digests (hexadecimal runs of a digest's length, UUIDs)
and identifiers are left out: all digits, or letter groups and numbers joined by ``-``, ``_``, ``/`` and
the like, where every letter group of more than ``SHORT_WORD`` letters passes the test by itself.

Positions are code points, ends exclusive. NULL counts as an empty text, which has no spans.
Whole texts are searched whatever their length. Repeated rows give repeated results, an empty
table an empty one, and other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syndica.llm.common import map_batches, pick, sliced_udf

VOCABULARY = "byte_bpe_50k.tiktoken"
BASE_KINDS = ("assign", "access", "hex")
RANDOM = "random"
MIN_CHARS = 16
MAX_CHARS_PER_TOKEN = 2.0
SHORT_WORD = 3  # letters; such groups tell nothing about a run
_LONGEST = 4096  # bytes tokenized at a time; ratios of longer runs are taken over all their parts

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # runs are maximal, so their length may be asked here
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}"
                     r"|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\Z")
_JOINED = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[-_/+=]+(?:[A-Za-z]+|[0-9]+))*[-_/+=]*\Z")

_LETTERS = re.compile(r"[A-Za-z]+")

Span = tuple[str, int, int]


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("efficiency", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


@lru_cache(maxsize=8)
def _runs(min_chars: int) -> re.Pattern:
    return re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{min_chars},}}")


def base_spans(text: str) -> list[Span]:
    """Matches of the three patterns, leftmost and without overlap within a kind."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def characters_per_token(run: str, encoding) -> float:
    parts = (run[i:i + _LONGEST] for i in range(0, len(run), _LONGEST))
    return len(run) / sum(len(encoding.encode_ordinary(p)) for p in parts)


def is_known(run: str, path: str, max_ratio: float = MAX_CHARS_PER_TOKEN) -> bool:
    """Whether a run is a digest or an identifier."""
    if _DIGEST.match(run):
        return True
    return bool(_JOINED.match(run)) and all(
        len(g) <= SHORT_WORD or characters_per_token(g, tokenizer(path)) > max_ratio for g in _LETTERS.findall(run))


def random_spans(text: str, taken: list[Span], path: str, min_chars: int = MIN_CHARS,
                 max_ratio: float = MAX_CHARS_PER_TOKEN) -> list[Span]:
    """Runs, or what ``taken`` leaves of them, that fail the token-efficiency test."""
    found, borders, at = [], sorted((s, e) for _, s, e in taken), 0
    furthest = -1  # end of the spans that start before the run
    for m in _runs(min_chars).finditer(text):
        run = m.group()
        start = m.start()
        if is_known(run, path, max_ratio):
            continue
        end = start + len(run.rstrip("-_/+"))
        if end - start < min_chars:
            continue
        left, pieces = max(start, furthest), []
        while at < len(borders) and borders[at][0] < end:
            if borders[at][0] > left:
                pieces.append((left, borders[at][0]))
            furthest = max(furthest, borders[at][1])
            left = max(left, furthest)
            at += 1
        if left < end:
            pieces.append((left, end))
        for a, b in pieces:
            if (a, b) != (start, end):
                piece = text[a:b]
                if a > start:
                    a = b - len(piece.lstrip("-_/+="))
                if b < end:
                    b -= len(piece) - len(piece.rstrip("-_/+="))
                piece = text[a:b]
                if b - a < min_chars or is_known(piece, path, max_ratio):
                    continue
            if characters_per_token(text[a:b], tokenizer(path)) <= max_ratio:
                found.append((RANDOM, a, b))
    return found


def in_order(spans: list[Span]) -> list[Span]:
    """By start, then by kind as listed."""
    order = {k: i for i, k in enumerate((*BASE_KINDS, RANDOM))}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


def redact(text: str, spans: list[Span], mark: str) -> str:
    """``text`` with ``mark`` in place of every span; overlapping spans become one mark."""
    out, at = [], 0
    for _, start, end in in_order(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(text: Column, mark: str, min_chars: int = MIN_CHARS, max_ratio: float = MAX_CHARS_PER_TOKEN,
             path: str | None = None) -> Column:
    """A text column with ``mark`` in place of every span; NULL stays NULL."""
    path = path or public_tokenizers.path(VOCABULARY)

    def clean(texts: list) -> list:
        out = []
        for t in texts:
            if t:
                found = base_spans(t)
                found += random_spans(t, found, path, min_chars, max_ratio)
                t = redact(t, found, mark) if found else t
            out.append(t)
        return out

    return sliced_udf(clean, "string")(text)


def find_secrets(docs: DataFrame, min_chars: int = MIN_CHARS, max_ratio: float = MAX_CHARS_PER_TOKEN,
                 path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, spans array<struct<kind, start, end>>)`` in order."""
    path = path or public_tokenizers.path(VOCABULARY)
    docs = pick(docs, doc_id=doc_id, text=text)
    schema = (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
              "spans array<struct<kind:string,start:int,end:int>>")

    def run(batch):
        spans = []
        for t in batch["text"]:
            found = base_spans(t) if t else []
            found = in_order(found + random_spans(t, found, path, min_chars, max_ratio)) if t else []
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
        return {"doc_id": batch["doc_id"], "spans": spans}

    return map_batches(docs, run, schema)


def span_digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the patterns' spans, and all spans as text."""
    def joined(spans):
        return F.array_join(F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"] != RANDOM)
    return found.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
