"""Language identification of whole texts and of the spans of mixed ones.

Words are runs of letters. Each letter scores with the letters beside it under every language
learned (smoothed counts of hashed letter triples, so the model has a fixed size per language),
and a word scores the sum. The script of a word, by code point ranges, narrows the languages to
those that were learned with that script. Viterbi decoding over the words with a penalty for each
switch labels spans; the language with most letters is the text's, and its share of the letters
the score. Texts of a batch are decoded side by side, a word of each at a time.

A text without letters, or a NULL text, is ``und`` with score 0, and so is everything if nothing
could be learned. Ties go to the language first in alphabetical order. Words in a script that was
never learned may be of any language. Rows whose language or text is NULL teach nothing. Repeated
rows give repeated results, an empty table an empty one, and other columns of the input are not
looked at.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syndica.llm.common import map_batches, pick, sliced

UNKNOWN = "und"
BUCKETS = 1 << 16
SMOOTHING = 0.5
SWITCH = 8.0  # log-likelihood that a change of language costs
SCRIPT_SHARE = 0.002  # of a language's letters, from which a script counts as its own
LETTERS_AT_ONCE = 1 << 20
N_SCRIPTS = 32

# First and last code points by script.
SCRIPT_RANGES = [
    (0x41, 0x24F, 1), (0x250, 0x2AF, 1), (0x1E00, 0x1EFF, 1), (0x2C60, 0x2C7F, 1), (0xA720, 0xA7FF, 1),
    (0x370, 0x3FF, 2), (0x1F00, 0x1FFF, 2), (0x400, 0x52F, 3), (0x1C80, 0x1C8F, 3), (0x2DE0, 0x2DFF, 3),
    (0xA640, 0xA69F, 3), (0x530, 0x58F, 4), (0x590, 0x5FF, 5), (0x600, 0x6FF, 6), (0x750, 0x77F, 6),
    (0x8A0, 0x8FF, 6), (0xFB50, 0xFDFF, 6), (0xFE70, 0xFEFF, 6), (0x700, 0x74F, 7), (0x900, 0x97F, 8),
    (0x980, 0x9FF, 9), (0xA00, 0xA7F, 10), (0xA80, 0xAFF, 11), (0xB00, 0xB7F, 12), (0xB80, 0xBFF, 13),
    (0xC00, 0xC7F, 14), (0xC80, 0xCFF, 15), (0xD00, 0xD7F, 16), (0xD80, 0xDFF, 17), (0xE00, 0xE7F, 18),
    (0xE80, 0xEFF, 19), (0xF00, 0xFFF, 20), (0x1000, 0x109F, 21), (0x10A0, 0x10FF, 22), (0x1100, 0x11FF, 23),
    (0x3130, 0x318F, 23), (0xAC00, 0xD7AF, 23), (0x1200, 0x139F, 24), (0x1780, 0x17FF, 25),
    (0x3040, 0x30FF, 26), (0x31F0, 0x31FF, 26), (0x3400, 0x4DBF, 27), (0x4E00, 0x9FFF, 27),
    (0xF900, 0xFAFF, 27), (0x20000, 0x3FFFF, 27),
]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower-case form (0 if it is no letter), and its script."""
    lower = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            small = char.lower()
            lower[code] = ord(small) if len(small) == 1 else code
    script = np.zeros(0x110000, np.uint8)
    for first, last, number in SCRIPT_RANGES:
        script[first:last + 1] = number
    return lower, script


class Words:
    """Letters and words of some texts, in one row of arrays."""

    def __init__(self, texts: list[str]):
        lower, script = _tables()
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        letters = lower[codes]
        around = np.concatenate(([0], letters, [0])).astype(np.uint64)
        at = np.nonzero(letters)[0]
        mixed = (around[at] * np.uint64(0x9E3779B97F4A7C15) ^ around[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F)
                 ^ around[at + 2] * np.uint64(0x165667B19E3779F9))
        mixed ^= mixed >> np.uint64(29)
        self.grams = (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)  # 16 bits
        begins = np.nonzero(around[at] == 0)[0]  # first letters of words
        self.begins, self.starts = begins, at[begins]
        self.sizes = np.diff(np.append(begins, len(at)))
        self.ends = self.starts + self.sizes
        self.letter_scripts = script[codes[at]]
        self.scripts = self.letter_scripts[begins]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.text_starts = np.concatenate(([0], ends[:-1]))
        self.bounds = np.searchsorted(self.starts, np.concatenate(([0], ends)))  # words of each text


def _in_groups(texts: list[str]) -> list[list[int]]:
    """Indexes of texts, longest first, in groups of bounded size (a long text is its own)."""
    groups, size = [[]], 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        if groups[-1] and size + len(texts[i]) > LETTERS_AT_ONCE:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += len(texts[i])
    return groups


class Model:
    """Log-likelihoods of letter triples and the scripts of each language."""

    def __init__(self, languages: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        total = grams.sum(1, keepdims=True)
        self.logs = np.log((grams + SMOOTHING) / (total + SMOOTHING * BUCKETS)).astype(np.float32)
        own = scripts >= np.maximum(SCRIPT_SHARE * scripts.sum(1, keepdims=True), 1)
        own[:, ~own.any(0)] = True  # scripts never learned
        self.barred = np.where(own, 0.0, -1e6).T  # by script and language

    def word_scores(self, words: Words) -> np.ndarray:
        by_language = [np.add.reduceat(row[words.grams], words.begins) for row in self.logs]
        return np.column_stack(by_language) + self.barred[words.scripts]

    def decode(self, words: Words, switch: float) -> np.ndarray:
        """Language of every word: the best path of each text, all texts in step. Texts must come
        longest first in words, which is how the step's texts stay a prefix."""
        if not len(words.begins):
            return np.zeros(0, np.int64)
        scores = self.word_scores(words)
        counts = np.diff(words.bounds)
        order = np.argsort(-counts, kind="stable")
        first, counts = words.bounds[:-1][order], counts[order]
        active = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), side="right")
        n = len(self.languages)
        back = np.zeros((len(scores), n), np.int16)
        value = np.zeros((len(counts), n))
        own = np.arange(n, dtype=np.int16)[None, :]
        for t, k in enumerate(active):
            at = first[:k] + t
            now = value[:k]
            if t:
                best = now.argmax(1)
                moved = now[np.arange(k), best] - switch
                back[at] = np.where(now >= moved[:, None], own, best[:, None])
                now = np.maximum(now, moved[:, None])
            value[:k] = now + scores[at]
        labels = np.zeros(len(scores), np.int64)
        state = value.argmax(1)
        for t in range(len(active) - 1, -1, -1):
            k = active[t]
            at = first[:k] + t
            labels[at] = state[:k]
            if t:
                state[:k] = back[at, state[:k]]
        return labels


def learn(docs: DataFrame, rows: Column, language: str = "lang", doc_id: str = "doc_id",
          text: str = "text") -> Model | None:
    """The model of the rows for which ``rows`` (an expression over ``doc_id``) holds.

    Every task counts the triples of its rows; the sums by language and bucket, which have a
    fixed number per language, are added up and read.
    """
    known = pick(docs, doc_id=doc_id, text=text, lang=language).where(rows).where(
        "lang is not null and text is not null")

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for group in _in_groups(texts):
                by_language: dict[str, list[str]] = {}
                for i in group:
                    by_language.setdefault(langs[i], []).append(texts[i])
                for lang, own in by_language.items():
                    words = Words(own)
                    total = totals.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                    total[:BUCKETS] += np.bincount(words.grams, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(words.letter_scripts, minlength=N_SCRIPTS)
        for lang, total in totals.items():
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                names=["lang", "bucket", "n"])

    counts = known.select("text", F.col("lang").cast("string")).mapInArrow(
        count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    languages = sorted(found["lang"].unique())
    if not languages:
        return None
    table = np.zeros((len(languages), BUCKETS + N_SCRIPTS))
    table[found["lang"].map({x: i for i, x in enumerate(languages)}), found["bucket"]] = found["n"]
    return Model(languages, table[:, :BUCKETS], table[:, BUCKETS:])


def identify(docs: DataFrame, model: Model | None, switch: float = SWITCH, spans: bool = False,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row, and ``spans array<struct<start, end, lang>>``
    (code points, end exclusive; words of one language in a row) if asked for."""
    docs = pick(docs, doc_id=doc_id, text=text)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    schema += ", spans array<struct<start:int,end:int,lang:string>>" if spans else ""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size per language

    def run(batch):
        model = shared.value
        texts = [t or "" for t in batch["text"]]
        out = {"doc_id": batch["doc_id"], "lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts),
               "spans": [[] for _ in texts]}
        for group in _in_groups(texts) if model and texts else []:
            words = Words([texts[i] for i in group])
            labels = model.decode(words, switch)
            letters = np.zeros((len(group), len(model.languages)))
            owner = np.repeat(np.arange(len(group)), np.diff(words.bounds))
            np.add.at(letters, (owner, labels), words.sizes)
            best, total = letters.argmax(1), letters.sum(1)
            for k, i in enumerate(group):
                if total[k]:
                    out["lang_pred"][i] = model.languages[best[k]]
                    out["score"][i] = float(letters[k, best[k]] / total[k])
                    if spans:
                        out["spans"][i] = _spans(words, labels, k, model.languages)
        return out

    return map_batches(docs, run, schema)


def _spans(words: Words, labels: np.ndarray, k: int, languages: list[str]) -> list[dict]:
    a, b = words.bounds[k], words.bounds[k + 1]
    own, offset = labels[a:b], words.text_starts[k]
    cuts = np.concatenate(([0], np.nonzero(np.diff(own))[0] + 1, [b - a]))
    return [{"start": int(words.starts[a + i] - offset), "end": int(words.ends[a + j - 1] - offset),
             "lang": languages[own[i]]} for i, j in zip(cuts[:-1], cuts[1:])]
