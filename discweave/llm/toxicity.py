"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, look-alike letters of other scripts and digits to the
letters they stand for, invisible characters away, everything else to spaces. One Aho-Corasick
automaton then finds lexicon words, lexicon word beginnings and exception phrases in a single
pass over the whole text; a hit inside an exception phrase does not count. The summed weights,
plain and per word of the text, give the score through a logistic curve.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discweave.llm.common import materialize, text_or_empty
from discweave.llm.language import crc_class
from discweave.llm.minhash import near_duplicates

#: Letters that look like plain Latin ones (lower case, as texts are lowered first):
#: Cyrillic, Greek, Armenian, small capitals, phonetic letters; and digits that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ь": "b",
    "ё": "e", "ӏ": "l", "ү": "y", "ѵ": "v", "ѡ": "w", "ҫ": "c", "қ": "k", "ң": "h", "ҳ": "x", "ԍ": "g", "ӓ": "a", "ӧ": "o", "ӱ": "y", "є": "e", "ӡ": "e",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "γ": "y", "ϲ": "c", "ϳ": "j", "ά": "a", "έ": "e", "ή": "n", "ί": "i", "ό": "o", "ύ": "u", "ώ": "w", "ϊ": "i", "ϋ": "u",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ք": "p", "յ": "j", "լ": "l",
    "ᴀ": "a", "ʙ": "b", "ᴄ": "c", "ᴅ": "d", "ᴇ": "e", "ꜰ": "f", "ɢ": "g", "ʜ": "h", "ɪ": "i", "ᴊ": "j", "ᴋ": "k", "ʟ": "l", "ᴍ": "m", "ɴ": "n", "ᴏ": "o", "ᴘ": "p", "ʀ": "r", "ꜱ": "s", "ᴛ": "t", "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ʏ": "y", "ᴢ": "z",
    "ı": "i", "ɑ": "a", "ɓ": "b", "ƅ": "b", "ƈ": "c", "ɗ": "d", "ɛ": "e", "ƒ": "f", "ɡ": "g", "ɦ": "h", "ɨ": "i", "ɩ": "i", "ʝ": "j", "ƙ": "k", "ɭ": "l", "ɱ": "m", "ɲ": "n", "ɵ": "o", "ƥ": "p", "ɾ": "r", "ʂ": "s", "ƭ": "t", "ʉ": "u", "ʋ": "v", "ʍ": "w", "ƴ": "y", "ʐ": "z",
}
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l"}
#: Set phrases in which a word of abuse is harmless.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash truck", "trash day", "garbage can", "garbage bin", "garbage bag", "garbage truck", "garbage collection", "garbage collector", "garbage in garbage out",
    "idiot proof", "fool proof", "fools gold", "april fools", "stupid simple", "keep it simple stupid", "dumb bell", "dumb bells", "dumb waiter", "dumb terminal", "dummy variable", "crash test dummy",
    "clown fish", "clown car", "circus clown", "class clown", "killer whale", "killer app", "kill switch", "skill set", "mad cow disease", "mad hatter", "crazy golf", "crazy quilt", "sick leave", "sick day", "sick pay",
    "ugly duckling", "booby trap", "booby prize", "blue footed booby", "shuttle cock", "weather cock", "cock pit", "guinea pig", "pig iron", "piggy bank", "lab rat", "rat race", "snake oil", "pond scum", "loser bracket", "losers bracket",
    "freak accident", "freak wave", "lame duck", "lazy evaluation", "lazy susan", "moby dick", "spotted dick", "bird brain teaser", "hate speech policy", "vacuum suction", "dirty laundry", "dirty bit", "bloody mary", "hell or high water",
)
TRAILING = re.compile(r"[@$!|€£]+(?![^\W_])")


def folding() -> dict[int, str | None]:
    """What each character becomes; letters that are nobody's look-alike stay."""
    table: dict[int, str | None] = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        kind = unicodedata.category(c)
        if c in LOOKALIKES or c in DIGITS or c in SIGNS:
            continue
        if kind == "Cf" or kind == "Mn":
            table[ord(c)] = None
        elif kind[0] in "PSZC" and kind not in ("Cs", "Co", "Cn"):
            table[ord(c)] = " "
        elif kind[0] == "L" and ord(c) >= 0x2100 and (plain := unicodedata.normalize("NFKC", c).lower()) != c and plain.isascii() and plain.isalpha():
            table[ord(c)] = plain  # full-width, mathematical and enclosed letters
    for letters in (LOOKALIKES, DIGITS, SIGNS):
        table |= {ord(k): v for k, v in letters.items()}
    return table


_folding: dict[int, str | None] = {}


def fold(text: str) -> str:
    """The folded text, with a space at either end."""
    if not _folding:
        _folding.update(folding())
    text = text.lower()
    if any(s in text for s in SIGNS):
        text = TRAILING.sub(" ", text)
    return f" {text.translate(_folding)} "


def features(text: str) -> set[str]:
    """Whole words and word beginnings of 4 to 8 letters of a folded text, each after a space."""
    out = set()
    for w in set(text.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in range(4, min(len(w), 9)))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)

    def __post_init__(self):
        self.search = None

    def compile(self) -> None:
        self.search = ahocorasick.Automaton()
        for phrase, weight in self.weights.items():
            self.search.add_word(phrase, (len(phrase), weight))
        for phrase in self.exceptions:
            self.search.add_word(fold(phrase), (len(fold(phrase)), 0.0))
        self.search.make_automaton()

    def evidence(self, text: str) -> tuple[float, float]:
        """Logarithms of one plus the summed weights and of one plus those per 100 words."""
        if self.search is None:
            self.compile()
        folded = fold(text)
        if not len(self.search):
            return 0.0, 0.0
        found = [(end - size + 1, end, weight) for end, (size, weight) in self.search.iter(folded)]
        if not found:
            return 0.0, 0.0
        best: dict[int, float] = {}
        reach = -1  # how far the exceptions go that begin at or before the hit
        for a, _, b, weight in sorted((a, weight > 0, b, weight) for a, b, weight in found):
            if not weight:
                reach = max(reach, b)
            elif b > reach:  # else inside an exception; a word counts once, however many entries it matches
                best[a] = max(best.get(a, 0.0), weight)
        total = sum(best.values())
        return math.log1p(total), math.log1p(100 * total / max(20, folded.count(" ")))

    def score(self, text: str) -> float:
        a, b = self.evidence(text)
        c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, c[0] + c[1] * a + c[2] * b))))


def select(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least: float = 18.0) -> dict[str, float]:
    """Lexicon entries: features that occur in toxic documents far more often than chance allows
    (a likelihood ratio of ``least`` or more) and are rare in clean ones, weighted by log odds.
    A word beginning is left out where one whole word accounts for it, and any entry where a
    kept shorter beginning is as good."""
    share = n_toxic / max(1, n_toxic + n_clean)
    good: dict[str, float] = {}
    for f, t in toxic.items():
        c, p = clean.get(f, 0), t / (t + clean.get(f, 0))
        ratio = 2 * (t * math.log(p / share) + (c * math.log((1 - p) / (1 - share)) if c else 0)) if p > share else 0
        if ratio >= least and t / max(1, n_toxic) > 4 * c / max(1, n_clean):
            good[f] = math.log(((t + 0.5) / (n_toxic + 1)) / ((c + 0.5) / (n_clean + 1)))
    kept: dict[str, float] = {}
    for f in sorted((f for f in good if not f.endswith(" ")), key=len):
        if not any(kept.get(f[:n], 0.0) >= good[f] - 0.3 for n in range(5, len(f))):
            kept[f] = good[f]
    words = {f for f in good if f.endswith(" ")}
    alone = {f for f in kept if any(w.startswith(f) and toxic[w] >= 0.9 * toxic[f] for w in words)}
    kept = {f: w for f, w in kept.items() if f not in alone}
    return kept | {w: good[w] for w in words if not any(kept.get(w[:n], 0.0) >= good[w] - 0.3 for n in range(5, len(w)))}


def fit_curve(points: np.ndarray, labels: np.ndarray, penalty: float = 0.5, rounds: int = 60) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; both classes weigh by their number."""
    x = np.column_stack([np.ones(len(points)), points])
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + penalty * w * [0, 1, 1]
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, penalty, penalty])
        w = w - np.linalg.solve(bend, slope)
    return float(w[0]), float(w[1]), float(w[2])


def learn(docs: DataFrame, labels: DataFrame, rows: F.Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 3000, most_clean: int = 9000) -> Lexicon:
    """Fit on a bounded sample of the labelled rows that ``rows`` (over the labels' ``doc_id``)
    admits: about ``most_toxic`` and ``most_clean`` documents, those whose hashed id is lowest.
    A document that has both labels counts as toxic; near copies of one
    label within the sample (those that ``minhash.near_duplicates`` connects) count once."""
    known = labels.where(F.coalesce(rows, F.lit(False)) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) >= 1).cast("int").alias("label"))
    known = known.withColumn("at", F.pmod(F.xxhash64("id"), F.lit(1 << 20)))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    limit = F.when(F.col("label") == 1, math.ceil((1 << 20) * min(1.0, most_toxic / max(1, totals.get(1, 0))))).otherwise(math.ceil((1 << 20) * min(1.0, most_clean / max(1, totals.get(0, 0)))))
    sample = known.where(F.col("at") < limit).select("id", "label")
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(sample), "id")

    def folding(batches):
        for batch in batches:
            folded = [fold(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(folded, pa.string())], names=["row", "label", "text"])

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((f, label) for f in features(text))
                seen["", label] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["feature", "label", "n"])

    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "label", "text")
    folded = materialize(numbered.mapInArrow(folding, "row long, label int, text string"), "toxicity-folded")
    groups = near_duplicates(folded, "row", "text").select(F.col("doc_id").alias("row"), "component_id")
    apart = folded.join(groups, "row").groupBy("label", "component_id").agg(F.min("text").alias("text")).select("label", "text")
    apart = materialize(apart, "toxicity-sample")
    counted = apart.mapInArrow(count, "feature string, label int, n long").groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("c"))
    rows_of = counted.where((F.col("feature") == "") | (F.col("t") >= 4) & (F.col("t") * 2 > F.col("c"))).toArrow().to_pylist()
    n = next(((r["t"], r["c"]) for r in rows_of if not r["feature"]), (0, 0))
    weights = select({r["feature"]: r["t"] for r in rows_of if r["feature"]}, {r["feature"]: r["c"] for r in rows_of if r["feature"]}, *n) if n[0] else {}
    lexicon = Lexicon(weights)

    def weigh(batches):
        for batch in batches:
            made = [lexicon.evidence(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.float64())], names=["label", "a", "b"])

    if weights:
        points = apart.mapInArrow(weigh, "label int, a double, b double").toArrow()
        xy = np.column_stack([points.column(c).to_numpy() for c in ("a", "b", "label")])
        lexicon = Lexicon(weights, curve=fit_curve(xy[:, :2], xy[:, 2]))
    return lexicon


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every whole text.

    Learns from labels of identifiers outside the held-out class (crc32 modulo 3 is 1) only; a
    document without identifier is not held out and never learned from. A null or empty text
    scores like one without hits. Without any toxic label to learn from nothing is predicted
    toxic. Repeated rows give a row each; other columns are not read. No shuffle of the texts.
    """
    lexicon = learn(docs, labels, crc_class(id_col, 3) != 1, id_col, text_col, label_col)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(crc_class(id_col, 3) == 1, F.lit(False)).alias("held_out"), text_or_empty(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches):
        score = sent.value.score
        for batch in batches:
            made = [score(t.as_py()) for t in batch.column(2)]
            predicted = [int(s >= threshold) for s in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.float64()), pa.array(predicted, pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return own.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
