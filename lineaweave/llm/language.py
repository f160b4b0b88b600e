"""Language identification by words first, then by shorter character n-grams.

A word that training knows scores its log frequency in each language; an
unseen one scores the mean log frequency of its longest character n-grams of
which any is known. A text's language is that of the largest sum.

Training counts the words of a bounded sample of labelled texts for each
language on Spark, and the n-grams of these words; all of them are in the model.
It holds a 64-bit hash and one float for each language of a word or n-gram, so
its size follows the sample alone, not the corpus, and it is broadcast.
Prediction is a map over the texts without a shuffle: the distinct tokens
between white space of a batch are scored once, in arrays."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, slices, stored

#: Distinct labelled texts of a language that are counted at most, those with the smallest hashes.
MAX_DOCS = 5_000
#: Lengths of character n-grams, longest first, with ^ and $ at a word's ends.
NGRAMS = (4, 3, 2, 1)
#: Added to each count.
SMOOTH = 0.5
UNKNOWN = "und"

_WORD = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*+")
#: Words that a task counts before it passes them on.
_KEEP = 200_000

Table = tuple[np.ndarray, np.ndarray]


def words_of(text: str) -> list[str]:
    """Runs of letters and marks that have a letter, lower-cased. Digits in any script, fractions and numerals are none."""
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _key(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def _keys(strings: list[str]) -> np.ndarray:
    return np.fromiter(map(_key, strings), np.int64, len(strings))


def _found(table: Table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys a table has, and their rows in it."""
    if not len(table[0]):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return table[0][at] == keys, at


@dataclass
class LanguageModel:
    """Log frequencies: ``words`` and ``ngrams[n]`` are sorted hashes and, for each, a value for each of ``languages``."""

    languages: list[str]
    words: Table
    ngrams: dict[int, Table] = field(default_factory=dict)

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores for each word, and whether training knows it."""
        known, at = _found(self.words, _keys(words))
        out = np.zeros((len(words), len(self.languages)))
        out[known] = self.words[1][at[known]]
        left = np.flatnonzero(~known)
        for n in NGRAMS:
            if not len(left):
                break
            own = [grams(words[k], n) for k in left.tolist()]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in own])
            has, at = _found(self.ngrams[n], _keys([g for gs in own for g in gs]))
            owner, rows = owner[has], self.ngrams[n][1][at[has]]
            hits = np.bincount(owner, minlength=len(left))
            for k in range(len(self.languages)):
                out[left, k] = np.bincount(owner, rows[:, k], len(left)) / np.maximum(hits, 1)
            left = left[hits == 0]
        return out, known

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text: its language, that language's share of the likelihood, and the share of its words that training
        knows; ``und``, 0 and 0 without a letter or without a model."""
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words = [words_of(t) for t in coded.dictionary.to_pylist()]
        sizes = np.array([len(w) for w in words], np.int64)
        n_lang = len(self.languages)
        owner = np.repeat(np.arange(len(words)), sizes)
        scores, known = self.word_scores([w for ws in words for w in ws])
        columns = [np.bincount(owner, scores[:, k], len(words)) for k in range(n_lang)]
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

        def by_text(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values[code], dtype=np.float64)])
            return sums[ends[1:]] - sums[ends[:-1]]
        n_words = by_text(sizes)
        share = by_text(np.bincount(owner, known, len(words))) / np.maximum(n_words, 1)
        if not n_lang:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        # sums of the texts one by one, so that a text's total does not depend on its neighbours
        total = np.stack([np.add.reduceat(np.append(c[code], 0.0), ends[:-1]) for c in columns], 1) if len(texts) else np.zeros((0, n_lang))
        best = np.argmax(total, 1)
        top = total[np.arange(len(total)), best]
        score = 1 / np.exp(np.maximum(total - top[:, None], -700)).sum(1)
        none = n_words == 0
        return ([UNKNOWN if z else self.languages[k] for z, k in zip(none.tolist(), best.tolist(), strict=True)],
                np.where(none, 0.0, score), np.where(none, 0.0, share))


def _logs(language: np.ndarray, keys: np.ndarray, counts: np.ndarray, languages: int) -> Table:
    """Log frequencies of (language, key, count) rows, each pair once."""
    distinct, at = np.unique(keys, return_inverse=True)
    own = np.zeros((len(distinct), languages))
    own[at, language] = counts
    norm = np.log(own.sum(0) + SMOOTH * (len(distinct) + 1))
    return distinct, (np.log(own + SMOOTH) - norm).astype(np.float32)


def model_of(counts: dict[str, Counter]) -> LanguageModel:
    """Model of word counts by language."""
    languages = sorted(counts)
    rows = [row for k, language in enumerate(languages) for row in _pieces(k, counts[language].items())]
    return _model(languages, rows)


def _pieces(language: int, words) -> Iterator[tuple[int, int, int, int]]:
    """(length of the piece, 0 for the word itself; language; hash; count) of words and all their n-grams, summed."""
    found: Counter = Counter()
    for word, c in words:
        found[0, _key(word)] += c
        for n in NGRAMS:
            for g in grams(word, n):
                found[n, _key(g)] += c
    for (n, key), c in found.items():
        yield n, language, key, c


def _model(languages: list[str], rows: list[tuple[int, int, int, int]]) -> LanguageModel:
    length, language, key, count = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ([], [], [], [])))
    return _model_of_arrays(languages, length, language, key, count)


def _model_of_arrays(languages: list[str], length: np.ndarray, language: np.ndarray, key: np.ndarray, count: np.ndarray) -> LanguageModel:
    tables = {}
    for n in (0, *NGRAMS):
        own = length == n
        tables[n] = _logs(language[own], key[own], count[own], len(languages))
    return LanguageModel(languages, tables[0], {n: tables[n] for n in NGRAMS})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flushed():
        for language, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(c), pa.string()), pa.array(list(c), pa.string()),
                                              pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in slices(batches):
        for language, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            counts[language].update(words_of(text))
        if sum(map(len, counts.values())) > _KEEP:
            yield from flushed()
            counts.clear()
    yield from flushed()


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list] = defaultdict(list)
        for language, word, n in zip(batch["lang"].to_pylist(), batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
            by[language].append((word, n))
        for language, words in by.items():
            length, _, key, count = zip(*_pieces(0, words), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(key), pa.string()), pa.array(length, pa.int32()), pa.array(key, pa.int64()),
                                              pa.array(count, pa.int64())], names=["lang", "length", "key", "n"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> LanguageModel:
    """Learn from the rows with a text and a language: at most ``max_docs`` distinct texts of each language, all of a
    smaller one. A language without a word is not learnt. No rows give a model without languages. Equal texts of a language count once."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL")
    sample = bounded_sample(rows, "text", max_docs, by="lang")
    words = sample.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    pieces = words.mapInArrow(_spell, "lang string, length int, key long, n long").groupBy("lang", "length", "key").agg(F.sum("n").alias("n"))
    got = stored(pieces, "lang-pieces").toArrow()
    coded = got["lang"].combine_chunks().dictionary_encode()
    languages = sorted(coded.dictionary.to_pylist())
    place = np.array([languages.index(x) for x in coded.dictionary.to_pylist()], np.int64)
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return _model_of_arrays(languages, got["length"].to_numpy(), place[code] if len(code) else code, got["key"].to_numpy(), got["n"].to_numpy())


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs``, or its ``columns``, with ``lang_pred``, ``score`` (0 to 1) and ``known`` (share of the text's words that
    training knows), which replace columns of these names.

    A null text or one without a letter is ``und`` with score 0, as is every
    text if the model knows no language. Equal sums go to the first language
    by name. Only the text is read for a prediction."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.drop(*PREDICTED)
    names = given.columns if columns is None else columns
    schema = given.select(names).schema.add("lang_pred", "string").add("score", "double").add("known", "double")

    def run(batches):
        for batch in slices(batches, text_col):
            language, score, known = held.value.predict(batch[text_col])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(language, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(known, pa.float64())], names=[*names, *PREDICTED])
    return given.mapInArrow(run, schema)


#: Columns that ``predict`` adds.
PREDICTED = ("lang_pred", "score", "known")
