"""Language identification, words first.

A known word scores by its log frequency in each language. An unseen word backs off to its
character n-grams, the longest first: the first length at which at least half of its n-grams
are known decides. A document's score per language is the mean over its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from discweave.llm.common import text_or_empty
from discweave.llm.words import row_groups, tidy, whole
from discweave.llm.words import words_of as spelled_words

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: The longest n-gram of the back-off; a word is padded by one mark on either side.
LONGEST = 5
#: How far one word can speak against a language, in natural logarithms.
FLOOR = -7.0
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return [w for w in WORD.findall(text.lower()) if w.isalpha()]


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


@dataclass
class Model:
    """Per known word and n-gram a row of log frequencies, one column a language."""

    languages: list[str]
    words: dict[str, int] = field(default_factory=dict)
    grams: list[dict[str, int]] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    hashed: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def word(self, word: str) -> np.ndarray:
        at = self.words.get(word)
        if at is not None:
            return self.table[at]
        for n in range(LONGEST, 0, -1):
            parts = grams(word, n)
            known = [k for g in parts if (k := self.grams[n].get(g)) is not None]
            if known and 2 * len(known) >= len(parts):
                return self.table[known].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)

    def _hashes(self, codes: np.ndarray, n: int) -> np.ndarray:
        """64-bit hashes of every ``n`` code points in a row."""
        size = max(0, len(codes) - n + 1)
        out = np.full(size, n, np.uint64)
        for k in range(n):
            out = (out ^ codes[k : size + k]) * MIX
            out ^= out >> np.uint64(29)
        return out

    def rows_of(self, words: list[str]) -> np.ndarray:
        """What :meth:`word` gives for each of many words, their n-grams looked up together by hash."""
        if not self.hashed:
            for n, known in enumerate(self.grams):
                codes = np.frombuffer("".join(known).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                found = self._hashes(codes, n)[::n] if n and known else np.zeros(0, np.uint64)
                order = np.argsort(found)
                self.hashed.append((found[order], np.fromiter(known.values(), np.int64, len(known))[order]))
        out = np.zeros((len(words), len(self.languages)), np.float32)
        at = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        out[at >= 0] = self.table[at[at >= 0]]
        rest = np.flatnonzero(at < 0)
        for n in range(LONGEST, 0, -1):
            if not len(rest):
                break
            pad = int(n > 1)
            codes = np.frombuffer("".join([f"^{words[k]}$" if pad else words[k] for k in rest.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            sizes = np.fromiter((len(words[k]) + 2 * pad for k in rest.tolist()), np.int64, len(rest))
            ends = np.cumsum(sizes)
            of = np.repeat(np.arange(len(rest)), sizes)[: max(0, len(codes) - n + 1)]
            whole = np.arange(len(of)) + n <= ends[of]
            known, rows = self.hashed[n]
            hashes = self._hashes(codes, n)
            place = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
            hit = np.flatnonzero(whole & (known[place] == hashes)) if len(known) else np.zeros(0, np.int64)
            count = np.bincount(of[hit], minlength=len(rest))
            done = (count > 0) & (2 * count >= sizes - n + 1)
            hit = hit[done[of[hit]]]
            values = self.table[rows[place[hit]]]
            for language in range(len(self.languages)):
                out[rest, language] = np.bincount(of[hit], weights=values[:, language], minlength=len(rest)) / np.maximum(count, 1)
            rest = rest[~done]
        return out


def fit(counts: dict[str, dict[str, int]], least: int = 2) -> Model:
    """``counts``: per language the number of times of each word. Words and n-grams seen fewer
    than ``least`` times in all are unseen."""
    languages = sorted(counts)
    rows: list[np.ndarray] = []

    def table(per_language: list[Counter]) -> dict[str, int]:
        total = Counter()
        for c in per_language:
            total.update(c)
        known = [g for g, c in total.items() if c >= least]
        sums = np.array([sum(c.values()) for c in per_language], float)
        freq = np.array([[c[g] for c in per_language] for g in known], float).reshape(len(known), len(languages))
        # relative to the best language, so that rare and common words weigh alike
        logs = np.log(freq + 0.1) - np.log(sums + 0.1 * max(1, len(known)))
        logs = np.maximum(logs - logs.max(axis=1, keepdims=True, initial=-math.inf), FLOOR) if len(known) else logs
        start = sum(map(len, rows))
        rows.append(logs.astype(np.float32))
        return {g: start + i for i, g in enumerate(known)}

    per_word = [Counter(counts[lang]) for lang in languages]
    model = Model(languages, words=table(per_word), grams=[{}])
    for n in range(1, LONGEST + 1):
        per = []
        for c in per_word:
            out: Counter = Counter()
            for word, k in c.items():
                for g in grams(word, n):
                    out[g] += k
            per.append(out)
        model.grams.append(table(per))
    model.table = np.concatenate(rows) if languages else np.zeros((0, 0), np.float32)
    return model


def learn(docs: DataFrame, rows: F.Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 600, least: int = 2) -> Model:
    """Fit on a bounded sample: of the rows that ``rows`` admits, about ``per_language`` documents
    of each language, those whose hashed id is lowest. Whole texts are counted."""
    known = docs.where(F.coalesce(rows, F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)).alias("at"))
    totals = known.groupBy("lang").count().collect()
    share = None
    for row in totals:
        most = math.ceil((1 << 20) * min(1.0, per_language / row["count"]))
        share = (F.when if share is None else share.when)(F.col("lang") == row["lang"], F.lit(most))
    if share is None:
        return fit({})

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])
            seen = batch = None
            tidy()

    sample = known.where(F.col("at") < share).select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    counted = sample.groupBy("word", "lang").agg(F.sum("n").alias("n"))
    kept = counted.join(counted.groupBy("word").agg(F.sum("n").alias("all")).where(F.col("all") >= least), "word")
    counts: dict[str, dict[str, int]] = {row["lang"]: {} for row in totals}
    for lang, word, n in kept.select("lang", "word", "n").toArrow().to_pandas().itertuples(index=False):
        counts[lang][word] = n
    model = fit(counts, least)
    del counts
    tidy()
    return model


class Scorer:
    """Sums the rows of the words of whole texts.

    The chunks between ASCII white space are scored once for each spelling in a group of texts
    and remembered, up to ``remembered`` of them.
    """

    def __init__(self, model: Model, remembered: int = 150_000):
        self.model, self.limit = model, remembered
        self.rows = np.zeros((remembered, len(model.languages) + 1), np.float32)
        self.at: dict[str, int] = {}

    def _rows(self, chunks: list[str]) -> np.ndarray:
        """For each chunk the summed rows of its words, and their number."""
        out = np.zeros((len(chunks), self.rows.shape[1]), np.float32)
        known = np.array([self.at.get(c, -1) for c in chunks], np.int64)
        out[known >= 0] = self.rows[known[known >= 0]]
        new = np.flatnonzero(known < 0)
        words = [words_of(chunks[k]) for k in new.tolist()]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        full = np.flatnonzero(counts)
        if len(full):
            found = self.model.rows_of([w for part in words for w in part])
            starts = (np.cumsum(counts) - counts)[full]
            out[new[full], :-1] = np.add.reduceat(found, starts, axis=0)
            out[new, -1] = counts
        for k in new.tolist():
            if len(self.at) >= self.limit:
                self.at.clear()
            if len(chunks[k]) <= 200:
                self.rows[len(self.at)] = out[k]
                self.at[chunks[k]] = len(self.at)
        return out

    def __call__(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Languages and scores of texts, none null."""
        words = spelled_words(texts)
        total = np.zeros((len(texts), len(self.model.languages) + 1))
        full = np.flatnonzero(words.ends > words.starts)
        if len(full):
            total[full] = np.add.reduceat(self._rows(words.spelled)[words.codes], words.starts[full], axis=0, dtype=np.float64)
        n = total[:, -1]
        if not self.model.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        mean = total[:, :-1] / np.maximum(n, 1)[:, None]
        best = mean.argmax(axis=1)
        odds = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.clip(n, 1, 12)[:, None])
        scores = 1 / odds.sum(axis=1)
        names = [self.model.languages[b] for b in best.tolist()]
        for k in np.flatnonzero(n == 0).tolist():
            if not any(map(str.isalpha, texts[k].as_py())):
                names[k], scores[k] = UNDETERMINED, 0.0
        return names, scores.tolist()


def identify(docs: DataFrame, model: Model, *keep: F.Column, text_col: str = "text") -> DataFrame:
    """lang_pred and score of every whole text, beside the columns ``keep``.

    ``und`` with score 0 where the text is null or has no letter (or no language was learned).
    The score is the share of the best language among the likelihoods of all, taken from the
    mean over the words times at most twelve of them, so a long text is not surer than it
    should be. Ties go to the first language in alphabetical order; letters that no language
    knows tie all of them. Repeated rows and ids give a row each. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*keep, text_or_empty(text_col).alias("_text_of_row"))
    kinds = inner.drop("_text_of_row").schema

    def run(batches):
        score = Scorer(sent.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in row_groups(texts):
                names, scores = score(texts[a:b])
                columns = [*(c[a:b] for c in batch.columns[:-1]), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kinds.names, "lang_pred", "score"])
            batch = texts = columns = None
            tidy()

    return inner.mapInArrow(run, type(kinds)(kinds.fields).add("lang_pred", StringType()).add("score", DoubleType()))


def crc_class(id_col: str, of: int) -> F.Column:
    """crc32 of the identifier as text, modulo ``of``; null where the identifier is."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of))


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Learns from the documents whose identifier is not in the held-out class (crc32 modulo 4 is
    2). A document without identifier is never learned from; held_out is false for it.
    """
    held_out = F.coalesce(crc_class(id_col, 4) == 2, F.lit(False))
    model = learn(docs, crc_class(id_col, 4) != 2, text_col, lang_col, id_col, per_language)
    return identify(docs, model, F.col(id_col).alias("doc_id"), held_out.alias("held_out"), text_col=text_col)


@F.arrow_udf(BooleanType())
def has_letter(texts: pa.Array) -> pa.Array:
    return pa.array([any(map(str.isalpha, t)) for t in texts.to_pylist()], pa.bool_())


def keep_identified(docs: DataFrame, least: float = 0.35, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a letter and a language that
    scores ``least`` or more.

    Where no language could be learned (``lang_col`` null throughout or known of held-out rows
    only) every row whose text has a letter stays. A text whose words are equally known in three
    or more languages scores 1/3 at most and goes, which befalls short ones.
    """
    model = learn(docs, crc_class(id_col, 4) != 2, text_col, lang_col, id_col)
    if not model.languages:
        return docs.where(has_letter(text_or_empty(text_col)))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        score = Scorer(sent.value)
        for batch in batches:
            texts = whole(batch.column(at))
            for a, b in row_groups(texts):
                names, scores = score(texts[a:b])
                yield batch.slice(a, b - a).filter(pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))
            batch = texts = None
            tidy()

    return docs.mapInArrow(run, docs.schema)
