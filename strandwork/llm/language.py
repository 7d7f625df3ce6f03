"""Language identification of mixed-language texts.

A word's script narrows the languages it can be of to those that the labelled texts show in that
script. The sums of its character n-grams' log probabilities score those languages, and the Viterbi
path over a text's words, with a penalty for each switch, labels spans. A text is of the language
that has most of its letters.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, shingles

#: A model is fitted on about so many labelled texts of each language at most, those with the smallest hashes of doc_id; they are read whole.
FIT_ROWS = 8_000
SIZES, BUCKETS, SMOOTH = (2, 3, 4), 1 << 16, 0.5
#: Weight of a word's score, the cost of a switch, the least share of a language's letters in a script that counts.
WEIGHT, SWITCH, LEAST_SHARE = 0.5, 6.0, 0.001
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Distinct words that are scored at once, times languages.
CELLS = 80_000
#: The first code points of Unicode ranges of scripts.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0x20000, "Han"),
]
NAMES = sorted({name for _, name in SCRIPTS})
_firsts = np.array([first for first, _ in SCRIPTS])
_kinds = np.array([NAMES.index(name) for _, name in SCRIPTS])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word between marks, how many each word has, and the script of each word's first letter."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(sizes) - sizes
    script = _kinds[np.searchsorted(_firsts, points[starts + 1], "right") - 1]
    values, parts, counts = shingles.mixed(points.astype(np.uint64)), [], []
    for k in SIZES:
        found, n = shingles.rolled(values, sizes, k)
        parts.append(found % np.uint64(BUCKETS))
        counts.append(n)
    word = np.concatenate([np.repeat(np.arange(len(words)), n) for n in counts])
    order = np.argsort(word, kind="stable")
    return np.concatenate(parts).astype(np.int64)[order], np.sum(counts, axis=0), script


@dataclass
class Model:
    languages: list[str]
    #: Log probabilities of buckets by language, which languages each script allows (all, if no text showed it), and whether a text showed it.
    table: np.ndarray
    allowed: np.ndarray
    shown: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from fitting: crc32 of the id as text, modulo 4, is 2; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model of the labelled texts of ``docs`` (doc_id, text, lang) that aren't held out: FIT_ROWS of each language, chosen by hash. The driver holds a row for each language."""
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = labelled.groupBy("lang").count().collect()
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, rows / r["count"])) for r in sizes], "lang string, rate double")
    some = labelled.join(F.broadcast(rates), "lang").filter(F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 <= F.col("rate"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        for lang, found in words.items():
            if not found:
                continue
            bucket, n, script = features(list(found))
            times, letters = np.array(list(found.values()), float), np.array([len(w) for w in found])
            sums = np.concatenate([np.bincount(bucket, np.repeat(times, n), BUCKETS), np.bincount(script, times * letters, len(NAMES))])
            full = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(full), "place": pa.array(full), "n": pa.array(sums[full])})

    counts = some.select("text", "lang").mapInArrow(count, "lang string, place long, n double").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    found = counts.toArrow().to_pydict()
    languages = sorted(set(found["lang"]))
    sums = np.zeros((BUCKETS + len(NAMES), len(languages)))
    index = {x: i for i, x in enumerate(languages)}
    sums[found["place"], [index[x] for x in found["lang"]]] = found["n"]
    grams, scripts = sums[:BUCKETS] + SMOOTH, sums[BUCKETS:]
    table = np.log(grams / grams.sum(axis=0)) if languages else grams
    allowed = (scripts > 0) & (scripts >= LEAST_SHARE * scripts.sum(axis=0))
    shown = allowed.any(axis=1)
    return Model(languages, table.astype(np.float32), allowed | ~shown[:, None], shown)


class Scores(dict):
    """A word's row of ``rows`` by the word: its weighted score in each language, far down where its script forbids."""

    MOST, FAR = 150_000, np.float32(-1e4)

    def __init__(self, model: Model) -> None:
        self.model, self.rows = model, np.zeros((0, len(model.languages)), np.float32)
        self.known, self.letters = np.zeros(0, bool), np.zeros(0, np.int64)

    def codes(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self) > self.MOST:
            self.clear()
            self.__init__(self.model)
        new = list(set().union(*texts).difference(self))
        step = max(1, CELLS // max(1, len(self.model.languages)))
        for words in (new[i : i + step] for i in range(0, len(new), step)):
            bucket, n, script = features(words)
            sums = np.add.reduceat(self.model.table[bucket], np.cumsum(n) - n, axis=0) * np.float32(WEIGHT)
            ok = self.model.allowed[script]
            sums = np.where(ok, sums - sums.max(axis=1, where=ok, initial=-1e9, keepdims=True), self.FAR)
            # numerals such as ² stand in words, too; a word of them alone has no letter and counts for nothing
            letters = np.fromiter((sum(map(str.isalpha, w)) for w in words), np.int64, len(words))
            self.letters = np.concatenate([self.letters, letters])
            self.known = np.concatenate([self.known, self.model.shown[script] & (letters > 0)])
            self.update(zip(words, range(len(self.rows), len(self.rows) + len(words)), strict=True))
            self.rows = np.concatenate([self.rows, sums])
        return [np.fromiter(map(self.__getitem__, own), np.int64, len(own)) for own in texts]


def scores_of(model: Model) -> Scores:
    return common.worker_table(("language", model.key), lambda: Scores(model))


def viterbi(score: np.ndarray, sizes: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The likeliest language of each word, texts one after another: all texts take a step at once, the longest first."""
    n, kinds = score.shape
    order = np.argsort(-sizes, kind="stable")
    starts, left = (np.cumsum(sizes) - sizes)[order], sizes[order]
    active = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), "right")
    from_, path = np.zeros((n, kinds), np.int16), np.zeros(n, np.int16)
    best = np.zeros((len(sizes), kinds), np.float32)
    stay = np.arange(kinds, dtype=np.int16)
    for t, k in enumerate(active.tolist()):
        at, now = starts[:k] + t, best[:k]
        if t:
            top = now.argmax(axis=1)
            switched = now[np.arange(k), top] - np.float32(penalty)
            moves = now < switched[:, None]
            from_[at] = np.where(moves, top[:, None], stay)
            now = np.where(moves, switched[:, None], now)
        now = now + score[at]
        best[:k] = now - now.max(axis=1, keepdims=True) if kinds else now
    last = best.argmax(axis=1).astype(np.int16) if kinds else np.zeros(len(sizes), np.int16)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        path[at] = last[:k]
        last[:k] = from_[at, last[:k]]
    return path


def judged(model: Model, raw: list[str | None], places: list[list[tuple[int, int]]] | None = None) -> tuple:
    """Each text's language and score, and for all their words the path and whether a script allows any language.

    ``places``: the words' places, if they are wanted; lower-casing may change a text's length.
    """
    table, raw = scores_of(model), [x or "" for x in raw]
    texts = [[x[a:b].lower() for a, b in own] for x, own in zip(raw, places, strict=True)] if places is not None else [WORD.findall(x.lower()) for x in raw]
    codes = table.codes(texts)
    sizes, kinds = np.array(list(map(len, codes)), np.int64), len(model.languages)
    code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    path = viterbi(table.rows[code], sizes)
    known = table.known[code] if len(code) else np.zeros(0, bool)
    letters = table.letters[code] if len(code) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    weigh = lambda which, w: np.bincount(doc[which] * max(1, kinds) + path[which], w, len(texts) * max(1, kinds)).reshape(len(texts), -1)
    sums = weigh(known, letters[known])
    total, most = np.bincount(doc, letters, len(texts)), sums.max(axis=1)
    # only a text without a letter in any script that was learned is judged by its other letters, and gets no score
    win = np.where(most > 0, sums.argmax(axis=1), weigh(~known, letters[~known]).argmax(axis=1))
    names = np.array([*model.languages, UNKNOWN], object)
    return names[np.where((total > 0) & (kinds > 0), win, kinds)], most / np.maximum(total, 1), path, known


def label(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """``docs``'s doc_id and text's language: (doc_id, lang_pred, score), with ``spans`` also the labelled spans.

    ``score`` is the share of the text's letters in spans of that language. Null texts and texts without
    letters are ``und`` with score 0; so is every text if no language was learned. Words in a script
    that no labelled text showed may be of any language and give no score: their span's lang is
    ``und``, but a text of such words alone gets the language that its letters are likest to. Of equal
    shares, the first language by name wins. A span is (lang, begin, end) in code points. A batch of
    texts is worked on some millions of characters at a time; a single longer text as a whole, for
    about 6 bytes for each word and language.
    """
    shape = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang:string,begin:int,end:int>>" * spans

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column("text").to_pylist()
        places = [[(m.start(), m.end()) for m in WORD.finditer(x or "")] for x in raw] if spans else None
        names, score, path, known = judged(model, raw, places)
        out = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)]
        if spans:
            found, done = [], 0
            for own in places:
                runs: list[dict] = []
                for k, (a, b) in enumerate(own, done):
                    lang = model.languages[path[k]] if known[k] else UNKNOWN
                    if runs and runs[-1]["lang"] == lang:
                        runs[-1]["end"] = b
                    else:
                        runs.append({"lang": lang, "begin": a, "end": b})
                done += len(own)
                found.append(runs)
            out.append(pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))))
        return pa.RecordBatch.from_arrays(out, names=["doc_id", "lang_pred", "score", "spans"][: len(out)])

    return common.map_texts(docs, [F.col("doc_id").cast("long").alias("doc_id"), "text"], "text", run, shape)


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model of those that aren't held out."""
    found = label(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def filter_docs(docs: DataFrame, least: float) -> DataFrame:
    """The documents with a learned language that has a share of ``least`` of their letters, with all their columns.

    Null texts and those without letters go. Each row is judged by its own text, so rows that repeat an
    id may fare differently. Texts are worked on some millions of characters at a time.
    """
    model = fit(docs)
    languages = frozenset(model.languages)

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        found = []
        for part in common.slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            names, share = judged(model, part.column("text").to_pylist())[:2]
            found += [n in languages and s >= least for n, s in zip(names, share, strict=True)]
        return pa.array(found, pa.bool_())

    return docs.filter(known("text"))
