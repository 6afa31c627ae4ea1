"""Language identification by words first, character n-grams for the rest (operator 4).

``train`` counts, with Spark, lower-cased words per language over labelled rows and keeps the most frequent ones;
character n-grams (words padded by one blank) are counted from the same word counts. ``predict`` scores each whole
text: a known word adds its per-language log frequency; an unseen word falls back to its longest known n-grams,
each level shorter when a gram is unknown. A run of more than ``LONG`` letters, as in scripts without blanks, is no
word: all its positions are walked by their n-grams, and each ``LONG`` letters say as much as a word. Its n-grams are
learned as well, from runs of any length (counted by Spark in words of more than 40 letters). The score is the posterior probability of the language after the
evidence is tempered per word, so that it lies between 0 and 1.

Bounds (all documented parameters) hold per language, so that every label with a text that has a letter is in the
model, however rare: about ``sample_rows`` labelled rows (those of smallest hash), ``max_words`` words and ``max_grams``
n-grams are shared out evenly, but a language gets ``lang_rows``, ``lang_words`` and ``lang_grams`` at least, the most
frequent ones; room that is left goes by total frequency. The model grows with the number of languages, not with the
rows; only this model is collected and broadcast. Frequencies are smoothed by the same share in every language, so
that a language with few rows doesn't attract what is unknown.

Defined results: null text, empty text or text without a letter -> ``und`` with score 0.0; an empty training table
-> every text ``und``; ties go to the alphabetically first language; repeated rows count as often as they occur;
rows with null label or text are no training rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.common import holding, letters, slices, trimmed, written

UNDETERMINED = "und"
#: What splits words: anything but letters and marks, so digits and punctuation say nothing.
_NOT_WORD = r"[^\p{L}\p{M}]+"
#: Fixed value: letters in a row beyond which they are no word of a vocabulary.
LONG = 64
#: Fixed value: hashes are taken modulo this.
_HASHES = 1 << 40


class BackoffModel:
    """Per-language log frequencies of words and of character n-grams: an index and a matrix for each."""

    def __init__(self, langs: list[str], words: dict[str, int], word_rows: np.ndarray, grams: dict[str, int], gram_rows: np.ndarray, max_n: int):
        self.langs, self.words, self.word_rows, self.grams, self.gram_rows, self.max_n = langs, words, word_rows, grams, gram_rows, max_n

    @classmethod
    def from_counts(cls, counts: list[tuple[str, str, int]], max_words: int, max_grams: int, max_n: int, more: list[tuple[str, str, int]] = (), lang_words: int = 10_000, lang_grams: int = 25_000) -> "BackoffModel":
        """counts: (word, language, n), more: (n-gram, language, n); bounded, as ``train`` collects them."""
        langs = sorted({lang for _, lang, _ in [*counts, *more]})
        at = {lang: k for k, lang in enumerate(langs)}
        words: dict[str, int] = {}
        grams: dict[str, int] = {}
        of_word = np.array([words.setdefault(w, len(words)) for w, _, _ in counts], int)
        word_n = np.zeros((len(words), len(langs)))
        np.add.at(word_n, (of_word, np.array([at[lang] for _, lang, _ in counts], int)), [n for _, _, n in counts])
        gram_at, word_at = [], []
        for word, k in words.items():
            padded = f" {word} "
            found = [grams.setdefault(padded[i : i + size], len(grams)) for size in range(1, max_n + 1) for i in range(len(padded) - size + 1)]
            gram_at += found
            word_at += [k] * len(found)
        of_gram = np.array([grams.setdefault(g, len(grams)) for g, _, _ in more], int)
        gram_n = np.zeros((len(grams), len(langs)))
        np.add.at(gram_n, np.array(gram_at, int), word_n[np.array(word_at, int)])
        np.add.at(gram_n, (of_gram, np.array([at[lang] for _, lang, _ in more], int)), [n for _, _, n in more])

        def logs(index: dict[str, int], n: np.ndarray, most: int, least: int) -> tuple[dict[str, int], np.ndarray]:
            names, own = list(index), set()
            for column in n.T:
                own.update(sorted(np.flatnonzero(column).tolist(), key=lambda k: (-column[k], names[k]))[: max(most // len(langs), least)])  # noqa: B023
            order = sorted(range(len(names)), key=lambda k, total=n.sum(axis=1).tolist(): (k not in own, -total[k], names[k]))[: max(most, len(own))]
            n = n[order]
            all_n = n.sum(axis=0)
            unseen = 0.5 / all_n[all_n > 0].mean() if len(order) else 1.0
            return {names[k]: i for i, k in enumerate(order)}, np.log((n / np.maximum(all_n, 1) + unseen) / (1 + unseen * len(order)))

        return cls(langs, *logs(words, word_n, max_words, lang_words), *logs(grams, gram_n, max_grams, lang_grams), max_n)

    def of_word(self, word: str) -> np.ndarray:
        """Log frequencies of a known word, else the mean over positions of the longest known n-gram's."""
        known = self.words.get(word)
        if known is not None:
            return self.word_rows[known]
        total, n = self._walked(f" {word} ")
        return total / n if n else np.zeros(len(self.langs))

    def of_run(self, run: str) -> tuple[np.ndarray, float]:
        """For a run of more than ``LONG`` letters: the mean over its positions, counted as so many words, and their number."""
        total, n = self._walked(f" {run} ")
        weight = len(run) / LONG
        return (total * (weight / n) if n else np.zeros(len(self.langs))), weight

    def _walked(self, padded: str, block: int = 4096) -> tuple[np.ndarray, int]:
        """Sum over positions of the longest known n-gram's row, and the number of positions with one."""
        total, n = np.zeros(len(self.langs)), 0
        for start in range(0, len(padded), block):
            found = []
            for i in range(start, min(start + block, len(padded))):
                for size in range(min(self.max_n, len(padded) - i), 0, -1):
                    row = self.grams.get(padded[i : i + size])
                    if row is not None:
                        found.append(row)
                        break
            if found:
                total += self.gram_rows[found].sum(axis=0)
                n += len(found)
        return total, n


class _Scores(dict):
    """word -> row of ``self.rows``, filled on demand; emptied beyond ``limit`` words, so memory is bounded."""

    def __init__(self, model: BackoffModel, limit: int = 250_000):
        super().__init__()
        limit = min(limit, max(60_000, 4_000_000 // max(1, len(model.langs))))  # a row is as wide as there are languages
        self.model, self.limit = model, limit
        self.rows = np.zeros((limit, len(model.langs)))

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.rows[at] = self.model.of_word(word)
        return at


    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, weights) of different words; those without a letter (empty ones) are to be left out by the caller."""
        rows, weights = np.zeros((len(words), len(self.model.langs))), np.ones(len(words))
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        for i in range(0, len(short), self.limit // 2):
            part = short[i : i + self.limit // 2]
            if len(self) + len(part) > self.limit:
                self.clear()
            rows[part] = self.rows[[self[words[k]] for k in part]]
        for k, w in enumerate(words):
            if len(w) > LONG:  # not cached: they may be as long as a text
                rows[k], weights[k] = self.model.of_run(w)
        return rows, weights


def score_texts(cache: _Scores, lowered: pa.Array, temper: float = 8.0) -> tuple[list[str], np.ndarray]:
    """(languages, posteriors) of whole lower-case texts, the different words of all of them looked up once."""
    langs = cache.model.langs
    split = pc.split_pattern_regex(lowered.fill_null(""), _NOT_WORD)
    numbered = split.flatten().dictionary_encode()
    worded = pc.match_substring_regex(numbered.dictionary, r"\p{L}").to_numpy(zero_copy_only=False)
    rows, weights = np.zeros((len(worded), len(langs))), np.zeros(len(worded))
    if langs and worded.any():
        rows[worded], weights[worded] = cache.of_words(numbered.dictionary.filter(pa.array(worded)).to_pylist())
    which, starts = numbered.indices.to_numpy(), split.offsets.to_numpy()
    starts = (starts - starts[0])[:-1]  # every text has a piece, if only an empty one
    n = np.add.reduceat(weights[which], starts) if len(starts) else np.zeros(0)
    if not langs or not len(starts):
        return [UNDETERMINED] * len(starts), np.zeros(len(starts))
    total = np.stack([np.add.reduceat(column[which], starts) for column in np.ascontiguousarray(rows.T)], axis=1)
    # the mean log ratio per word, counted as ``temper`` words at most: long texts don't all get exactly 1.0
    some = n > 0
    p = np.exp((total - total.max(axis=1, keepdims=True)) * (np.minimum(n, temper) / np.where(some, n, 1))[:, None])
    best = p.argmax(axis=1)
    score = np.where(some, p[np.arange(len(best)), best] / p.sum(axis=1), 0.0)
    return [langs[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), some.tolist())], score


def score_text(cache: _Scores, text: str | None) -> tuple[str, float]:
    """(language, posterior) of one whole text."""
    found, score = score_texts(cache, pa.array([text.lower() if text else ""], pa.string()))
    return found[0], float(score[0])


def _long_grams(runs: DataFrame, max_n: int) -> DataFrame:
    """w, l, n: how often each n-gram is in the words ``w`` of language ``l``; words are read in pieces of 64 letters."""
    pieces = F.regexp_extract_all(F.concat(F.lit(" "), "w", F.lit(" ")), F.lit(rf"(?s)(?=(.{{1,{63 + max_n}}})).{{1,64}}"), F.lit(1))
    sized = lambda size: F.when(F.length("p") >= size, F.transform(F.sequence(F.lit(1), F.least(F.lit(64), F.length("p") - size + 1)), lambda i: F.substring("p", i, size)))
    grams = F.flatten(F.filter(F.array(*[sized(size) for size in range(1, max_n + 1)]), lambda x: x.isNotNull()))
    return runs.select("l", F.explode(pieces).alias("p")).select("l", F.explode(grams).alias("w")).groupBy("w", "l").agg(F.count("*").alias("n"))


def _most_frequent(counts: DataFrame, name: str, most: int, least: int) -> list[tuple[str, str, int]]:
    """(w, l, n) of about the max(most / languages, least) most frequent w of each language l; ties by hash.

    The numbers of w by l and n, a short table, give the bounds, so that nothing is sorted or gathered by language.
    """
    counts = written(counts, name)
    levels: dict[str, list[tuple[int, int]]] = {}
    for r in counts.groupBy("l", "n").agg(F.count("*").alias("c")).collect():
        levels.setdefault(r["l"], []).append((r["n"], r["c"]))
    bounds = []
    for lang, found in levels.items():
        left, bound = max(most // len(levels), least), (0, 0)
        for n, c in sorted(found, reverse=True):
            if c > left:
                bound = (n, _HASHES * left // c)
                break
            left -= c
        bounds.append((lang, *bound))
    if not bounds:
        return []
    schema = T.StructType([counts.schema["l"], T.StructField("low", T.LongType()), T.StructField("tie", T.LongType())])
    kept = counts.join(F.broadcast(counts.sparkSession.createDataFrame(bounds, schema)), "l")
    kept = kept.where((F.col("n") > F.col("low")) | ((F.col("n") == F.col("low")) & (F.pmod(F.xxhash64("w", F.lit(19)), F.lit(_HASHES)) < F.col("tie"))))
    return sorted((r["w"], r["l"], r["n"]) for r in kept.select("w", "l", "n").collect())


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = 20_000, max_words: int = 40_000, max_grams: int = 100_000, max_n: int = 4,
    lang_rows: int = 5_000, lang_words: int = 10_000, lang_grams: int = 25_000,
) -> BackoffModel:
    """Fit on labelled rows. Bounded per language: rows, then twice its share of (word, language) and of n-gram pairs."""
    rows = docs.where(letters(F.col(text)) & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit(17)), F.lit(_HASHES)).alias("h"))
    # a threshold on the hash per language keeps about its share without a sort or a gathering task, one row at least
    stats = rows.groupBy("l").agg(F.count("*").alias("n"), F.min("h").alias("first")).collect()
    share = max(sample_rows // max(1, len(stats)), lang_rows)
    if any(r["n"] > share for r in stats):
        bounds = [(r["l"], max(r["first"], _HASHES * share // r["n"])) for r in stats]
        schema = T.StructType([rows.schema["l"], T.StructField("bound", T.LongType())])
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(bounds, schema)), "l").where(F.col("h") <= F.col("bound"))
    words = rows.select("l", F.explode(F.split(F.lower("t"), _NOT_WORD)).alias("w")).where(letters(F.col("w")))
    counts = words.where("length(w) <= 40").groupBy("w", "l").agg(F.count("*").alias("n"))
    top = _most_frequent(counts, "words", 2 * max_words, 2 * lang_words)
    more = _most_frequent(_long_grams(words.where("length(w) > 40"), max_n), "grams", 2 * max_grams, 2 * lang_grams)
    return BackoffModel.from_counts(top, max_words, max_grams, max_n, more, lang_words, lang_grams)


def predict(docs: DataFrame, model: BackoffModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all), then lang_pred string and score double. No shuffle; one pass over the texts.

    An input column named lang_pred or score is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.lower(F.col(text)).alias("_qf_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        holding("language", lambda: own.__dict__.pop("cache", None))
        if not hasattr(own, "cache"):  # the broadcast value lives as long as the Python worker
            own.cache = _Scores(own)
        cache = own.cache
        for batch in batches:
            trimmed()
            for part in slices(batch, [batch.num_columns - 1], size=2 << 20):
                found, score = score_texts(cache, part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = T.StructType([*source.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """crc32 of the key as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the rows that aren't held out, predict all: key, held_out, lang_pred, score."""
    model = train(docs.where(~held_out(key)), text, lang, key)
    rows = docs.select(F.col(key), held_out(key).alias("held_out"), F.col(text))
    return predict(rows, model, text, [key, "held_out"])
