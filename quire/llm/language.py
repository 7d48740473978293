"""Languages of documents and of stretches within them.

Prediction by partial matching: each language has a context tree over the bytes
of words (contexts of up to four bytes, within the word and the blank before
it).  Frozen counts with escape probabilities give the exact code length of
each word in each language; a stretch belongs to the language that codes it
shortest.  The code length of a word doesn't depend on its neighbours, so each
distinct word is coded once per worker and sentences are sums of table rows.

The trees are trained here on at most ``sample`` paragraphs whose document names
exactly one language, as many of each language, chosen by hash; as labels may
be wrong, sentences are then assigned by the first trees and the trees trained anew.

Null, empty and letterless texts have no language.  Rows delivered twice count
once.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexicon import COMMON_WORDS, LANGUAGE_NAMES, LANGUAGES
from .textform import slices

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SENTENCE_END = re.compile(r"(?:(?<=[.!?…])|(?<=[.!?…][\"»”’“)]))[ \t]+(?=[\"«„“‘(¿¡]?[^\W_a-zà-öø-ÿа-яё]|[^\w\s])|\s*\n\s*")
COMPLETE = re.compile(r"^[\"«„“‘(¿¡]*(?:[^\W_a-zà-öø-ÿа-яё]).*[.!?…][\"»”’“)]*$", re.DOTALL)
SEGMENTS = "doc_id bigint, element_id string, segment_no bigint, start bigint, length bigint, lang string, confidence double, complete boolean"


class ContextTree:
    """Frozen code lengths in bits of bytes in their contexts, with escapes to shorter contexts."""

    def __init__(self, words: Counter, order: int = 4) -> None:
        counts: dict[bytes, Counter] = defaultdict(Counter)
        for word, n in words.items():
            w = b" " + word.encode() + b" "
            for i in range(1, len(w)):
                for k in range(min(order, i) + 1):
                    counts[w[i - k : i]][w[i]] += n
        self.order = order
        self.nodes: dict[bytes, tuple[dict[int, float], float]] = {}
        for context, seen in counts.items():
            total, kinds = sum(seen.values()), len(seen)
            self.nodes[context] = ({b: log2((total + kinds) / n) for b, n in seen.items()}, log2((total + kinds) / kinds))

    def bits(self, word: str) -> float:
        w, nodes, total = b" " + word.encode("utf-8", "replace") + b" ", self.nodes, 0.0
        for i in range(1, len(w)):
            for k in range(min(self.order, i), -1, -1):
                node = nodes.get(w[i - k : i])
                if node is None:
                    continue
                coded = node[0].get(w[i])
                if coded is not None:
                    total += coded
                    break
                total += node[1]
            else:
                total += 8.0
        return total


class Model:
    """One tree per language; words are looked up before they are coded."""

    def __init__(self, trees: dict[str, ContextTree], memory: int = 400_000) -> None:
        self.trees, self.memory, self.coded = trees, memory, {}
        self.languages = [x for x in LANGUAGES if x in trees]
        self.common = [frozenset(COMMON_WORDS[x]) for x in self.languages]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"coded": {}}

    def code(self, word: str) -> tuple[list[float], list[bool]]:
        row = self.coded.get(word)
        if row is None:
            if len(self.coded) >= self.memory:
                self.coded.clear()
            row = self.coded[word] = ([self.trees[x].bits(word) for x in self.languages], [word in c for c in self.common])
        return row

    def sentences(self, sentences: list[str]) -> tuple[np.ndarray, ...]:
        """Of each sentence: bits by language, common words by language, words, letters, distinct words."""
        found = [WORD.findall(s.lower()) for s in sentences]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = [w for ws in found for w in ws]
        k = len(self.languages)
        if not flat:
            zero = np.zeros((len(sentences), k))
            return zero, zero.copy(), size, np.zeros(len(sentences), np.int64), size
        codes, distinct = pd.factorize(np.array(flat, dtype=object))
        rows = [self.code(w) for w in distinct]
        bits, common = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        letters = np.fromiter((len(w) for w in distinct), np.int64, len(distinct))
        starts = np.r_[0, np.cumsum(size)[:-1]]
        full = size > 0
        out = []
        for table in (bits, common, letters[:, None]):
            total = np.zeros((len(sentences), table.shape[1]))
            total[full] = np.add.reduceat(table[codes], starts[full], axis=0)
            out.append(total)
        kinds = np.fromiter((len(set(ws)) for ws in found), np.int64, len(found))
        return out[0], out[1], size, out[2][:, 0].astype(np.int64), kinds


def named_languages(doc_ir: DataFrame) -> DataFrame:
    """The languages that the metadata of each document names, in any spelling: (doc_id, lang)."""
    table = F.create_map(*[F.lit(x) for lang, names in LANGUAGE_NAMES.items() for name in names for x in (name, lang)])
    entries = doc_ir.where("metadata is not null").select("doc_id", F.explode("metadata").alias("k", "v"))
    values = entries.where("lower(trim(k)) rlike '(^|[^a-z])lang(uages?)?$' or lower(trim(k)) in ('sprache', 'langue', 'idioma', 'taal', 'язык')")
    part = F.explode(F.split(F.lower("v"), r"[;,/|+&\s]+"))
    return values.select("doc_id", part.alias("part")).select("doc_id", F.element_at(table, F.regexp_replace("part", "[-_].*$", "")).alias("lang")).where("lang is not null").distinct()


def training_shares(documents: dict[str, int], all_documents: int, paragraphs: int, sample: int) -> dict[str, float]:
    """The share of paragraphs to take of each language: its equal part of the sample, as documents have about as many paragraphs in all languages."""
    each = paragraphs / max(all_documents, 1)
    return {lang: min(1.0, sample / len(LANGUAGES) / max(n * each, 1.0)) for lang, n in documents.items()}


def training_rows(paragraphs: DataFrame, named: DataFrame, sample: int) -> pd.DataFrame:
    """At most about ``sample`` paragraphs of documents that name exactly one language, as many of each, chosen by hash."""
    one = named.groupBy("doc_id").agg(F.count("lang").alias("n"), F.min("lang").alias("lang")).where("n = 1").select("doc_id", "lang")
    documents = {r["lang"]: r["n"] for r in one.groupBy("lang").agg(F.count("doc_id").alias("n")).collect()}  # seven rows at most
    counted = paragraphs.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc_id").alias("docs")).first()
    shares = training_shares(documents, counted["docs"], counted["n"], sample)
    if not shares:
        return pd.DataFrame({"text": [], "lang": []})
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "element_id"), 11) / float(2**53)
    table = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    maybe = paragraphs.where((chance < max(shares.values())) & (F.length("text") > 0))
    return maybe.join(one, "doc_id").where(chance < F.element_at(table, F.col("lang"))).select("text", "lang").toPandas()


def split_sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences and lines of a text."""
    spans, at = [], 0
    for m in SENTENCE_END.finditer(text):
        if m.start() > at:
            spans.append((at, m.start()))
        at = m.end()
    if at < len(text):
        spans.append((at, len(text)))
    return spans


def train(rows: pd.DataFrame, rounds: int = 2, order: int = 4) -> Model:
    """Trees from labelled paragraphs; later rounds use the labels that the trees before them give."""
    sentences, labels = [], []
    for text, lang in zip(rows["text"], rows["lang"]):
        for s, e in split_sentences(text):
            if COMPLETE.match(text[s:e]) and text[s:e].count(" ") >= 3:
                sentences.append(text[s:e])
                labels.append(lang)
    model = None
    for _ in range(rounds):
        if model is not None and sentences:
            bits, common, *_ = model.sentences(sentences)
            labels = [model.languages[i] if common[j].max() >= 1 else "" for j, i in enumerate((bits - 6 * common).argmin(axis=1))]
        words: dict[str, Counter] = {x: Counter({w: 1 for w in COMMON_WORDS[x]}) for x in LANGUAGES}
        for s, lang in zip(sentences, labels):
            if lang in words:
                words[lang].update(WORD.findall(s.lower()))
        model = Model({x: ContextTree(c, order) for x, c in words.items()})
    return model


def language_model(paragraphs: DataFrame, doc_ir: DataFrame, *, sample: int = 20_000) -> Model:
    return train(training_rows(paragraphs, named_languages(doc_ir), sample))


def classify(model: Model, sentences: list[str], *, least_words: int = 4, least_common: float = 0.04, least_distinct: float = 0.4, most_bits: float = 4.5) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Language (None without letters), confidence, and whether it is a complete sentence of the language."""
    bits, common, words, letters, distinct = model.sentences(sentences)
    best = bits.argmin(axis=1)
    pick = np.arange(len(sentences))
    gap = bits - bits[pick, best][:, None]
    confidence = 1.0 / np.exp2(-np.minimum(gap, 400) * 0.3).sum(axis=1)
    share = common[pick, best] / np.maximum(words, 1)
    shaped = np.fromiter((bool(COMPLETE.match(s)) for s in sentences), bool, len(sentences))
    natural = bits[pick, best] / np.maximum(letters + words, 1) <= most_bits
    # Russian does without articles: a sentence may have no function word at all
    articled = np.array([x != "ru" for x in model.languages])[best]
    spoken = np.where(articled, (share >= least_common) & (common[pick, best] >= 1), True)
    complete = shaped & (words >= least_words) & spoken & (distinct >= least_distinct * words) & natural & (confidence >= 0.9)
    return [model.languages[i] if w else None for i, w in zip(best, words)], np.where(words > 0, confidence, 0.0), complete


def segments(paragraphs: DataFrame, model: Model) -> DataFrame:
    """Stretches of one language in each paragraph, in order: start and length in characters, confidence, and whether they hold a complete sentence."""
    shared = paragraphs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in slices(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            doc = batch.column(batch.schema.get_field_index("doc_id"))
            element = batch.column(batch.schema.get_field_index("element_id"))
            sentences, where, row = [], [], []
            for r, text in enumerate(texts):
                for s, e in split_sentences(text or ""):
                    sentences.append(text[s:e])
                    where.append((s, e))
                    row.append(r)
            if not sentences:
                continue
            langs, confidence, complete = classify(model, sentences)
            out: list[list] = []  # row, number, start, end, lang, weighted confidence, weight, complete
            for r, (s, e), lang, c, done in zip(row, where, langs, confidence.tolist(), complete.tolist()):
                last = out[-1] if out and out[-1][0] == r else None
                if last is not None and (lang == last[4] or lang is None or last[4] is None) and (done == last[7] or lang is None):
                    last[3], last[4] = e, last[4] or lang
                    last[5] += c * (e - s)
                    last[6] += e - s
                    last[7] |= done
                else:
                    out.append([r, last[1] + 1 if last is not None else 0, s, e, lang, c * (e - s), e - s, done])
            at = pa.array([o[0] for o in out])
            yield pa.RecordBatch.from_arrays(
                [doc.take(at), element.take(at), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] - o[2] for o in out], pa.int64()),
                 pa.array([o[4] for o in out], pa.string()), pa.array([o[5] / o[6] for o in out], pa.float64()), pa.array([o[7] for o in out], pa.bool_())],
                names=["doc_id", "element_id", "segment_no", "start", "length", "lang", "confidence", "complete"],
            )

    return paragraphs.select(F.col("doc_id").cast("bigint"), "element_id", "text").where("length(text) > 0").mapInArrow(run, SEGMENTS)


def unnamed_languages(paragraphs: DataFrame, doc_ir: DataFrame, model: Model) -> DataFrame:
    """Paragraphs with a complete sentence in a language that their document's metadata doesn't name: (doc_id, element_id, lang)."""
    held = segments(paragraphs, model).where("complete").select("doc_id", "element_id", "lang").distinct()
    return held.join(named_languages(doc_ir), ["doc_id", "lang"], "left_anti").select("doc_id", "element_id", "lang")


def _with_document_language(parts: DataFrame) -> DataFrame:
    """Add what speaks for a stretch's language in its document, and the language for which most does.

    That is the number of characters in complete sentences; other text counts a hundredth.
    """
    weight = F.col("length") * F.when(F.col("complete"), 1.0).otherwise(0.01)
    alike, doc = Window.partitionBy("doc_id", "lang"), Window.partitionBy("doc_id")
    weighed = parts.withColumn("w", F.sum(weight).over(alike))
    return weighed.withColumn("main", F.min(F.struct(-F.col("w"), F.col("lang"))).over(doc))


def document_languages(paragraphs: DataFrame, model: Model) -> DataFrame:
    """The language of each document with most characters in complete sentences (any text where there are none), and its confidence."""
    parts = segments(paragraphs, model).where("lang is not null").dropDuplicates(["doc_id", "element_id", "segment_no"])
    weight = F.col("length") * F.when(F.col("complete"), 1.0).otherwise(0.01)
    by = parts.groupBy("doc_id", "lang").agg(F.sum(weight).alias("w"), F.sum(weight * F.col("confidence")).alias("c"))
    docs = by.groupBy("doc_id").agg(F.min(F.struct(-F.col("w"), F.col("lang"), F.col("c"))).alias("main"), F.sum("w").alias("t"))
    return docs.select("doc_id", "main.lang", F.round(F.col("main.c") / F.col("t"), 6).alias("confidence"))


def foreign_segments(paragraphs: DataFrame, model: Model) -> DataFrame:
    """Every stretch with a complete sentence in another language than its document's; paragraphs are read and cut once."""
    parts = segments(paragraphs, model).where("lang is not null").dropDuplicates(["doc_id", "element_id", "segment_no"])
    told = _with_document_language(parts).withColumn("document_lang", F.col("main")["lang"]).where("complete and lang <> document_lang")
    return told.select("doc_id", "element_id", "segment_no", "start", "length", "lang", F.round("confidence", 6).alias("confidence"), "document_lang")
