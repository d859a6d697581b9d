"""Reading level of documents: a familiar-word formula fitted to readers' labels.

Familiar words of a language are those that occur in at least a given share of
its documents; the frequencies are counted over the whole corpus. A document's
difficulty is a linear formula of the shares of its words outside the lists for
several such cuts, of the logarithm of its average sentence length, and of their
products. The weights are fitted to labelled documents (about MAX_LABELS at most,
the only bounded sample here) with a ridge penalty that lets languages differ.

Only prose counts: headings, list items, tables, code, lines without a sentence
end and comma enumerations are set aside, and so are words with digits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.storage import materialize

#: Shares of a language's documents that a familiar word occurs in.
CUTS = (0.01, 0.05, 0.08, 0.1, 0.15, 0.18, 0.2, 0.22, 0.24, 0.26, 0.3, 0.35, 0.4, 0.5)
#: Words that occur in fewer of a language's documents are in no list; they do not tell languages apart either.
LEAST_SHARE = 0.0025
LEVELS = 5
#: Labelled documents that the formula is fitted to, about: those with the least hashes.
MAX_LABELS = 20_000
#: Languages with at least this share of the labelled-language documents have lists of their own; so there are at most 1 / LEAST_LANGUAGE.
LEAST_LANGUAGE = 0.002
FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
ITEM = re.compile(r"\s*(?:[#|>*+•]|[-–]\s|\d+[.)]\s|https?://|\Z)")
END = re.compile(r"[.!?。…]['\")»”]*\s*\Z")
SPEAKER = re.compile(r"\A\s*[A-ZÀ-Þ][\w-]{0,14}:\s+")
SENTENCE = re.compile(r"[.!?。…]+(?=\s|['\")»”]|\Z)")
WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:['’-][^\W\d_]+)*(?!\w)")


def prose_lines(text: str) -> list[str]:
    """Lines of running text; all lines if none is."""
    if "```" in text:
        text = FENCE.sub("\n", text)
    lines = text.splitlines()
    return [SPEAKER.sub("", x) for x in lines if END.search(x) and not ITEM.match(x)] or lines


def _words(line: str) -> list[str]:
    return WORD.findall(line)


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence that is no enumeration; of all sentences if all are."""
    found, plain = [], []
    for line in prose_lines(text):
        for part in SENTENCE.split(line.lower()):
            words = _words(part)
            if words:
                found.append(words)
                if part.count(",") <= max(2, len(words) // 4):
                    plain.append(words)
    return plain or found


@dataclass
class Lists:
    """The words that reach LEAST_SHARE in a language, for each of them the languages and shares (rows from[i] to from[i + 1])."""

    languages: list[str]
    docs: np.ndarray
    index: dict[str, int]
    starts: np.ndarray
    lang: np.ndarray
    share: np.ndarray
    # made when first used, on each executor
    gain: np.ndarray | None = None
    absent: np.ndarray | None = None
    sizes: np.ndarray | None = None

    def shares_of(self, lang: int) -> np.ndarray:
        """Share of the language's documents that hold each word; a last 0 for all other words."""
        out = np.zeros(len(self.index) + 1, dtype=np.float32)
        mine = self.lang == lang
        out[np.repeat(np.arange(len(self.index)), np.diff(self.starts))[mine]] = self.share[mine]
        return out

    def spoken(self, words: np.ndarray) -> int:
        """The language whose documents hold the most of these words (log shares, smoothed)."""
        if len(self.languages) == 1:
            return 0
        if self.gain is None:
            self.absent = np.log(0.5 / (self.docs + 1))
            self.gain = np.log((self.share * self.docs[self.lang] + 0.5) / (self.docs[self.lang] + 1)) - self.absent[self.lang]
            self.sizes = np.append(np.diff(self.starts), 0)  # the last is that of words in no list
        sizes = self.sizes[words]
        ends = np.cumsum(sizes)
        rows = np.repeat(self.starts[words] - (ends - sizes), sizes) + np.arange(ends[-1])
        return int(np.argmax(len(words) * self.absent + np.bincount(self.lang[rows], self.gain[rows], len(self.languages))))


def familiar_words(docs: DataFrame) -> Lists:
    """docs: text, lang. Word lists by language from document frequencies over all documents.

    The shares of a language's words sum to the mean number of distinct words of
    its documents, so at most that number / LEAST_SHARE words are listed, however
    many documents there are; none of those is left out.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                counter = by.setdefault(lang, Counter())
                counter.update({w for line in prose_lines(text) for w in _words(line.lower())})
                counter[""] += 1
            if sum(map(len, by.values())) > 1_000_000:
                for lang, counter in by.items():
                    yield pd.DataFrame({"lang": lang, "word": list(counter), "df": list(counter.values())})
                by = {}
        for lang, counter in by.items():
            yield pd.DataFrame({"lang": lang, "word": list(counter), "df": list(counter.values())})

    lang = F.coalesce(F.regexp_extract(F.lower(F.trim("lang")), "^(\\p{L}{2})(?!\\p{L})", 1), F.lit(""))
    counts = docs.select("text", lang.alias("lang")).mapInPandas(count, "lang string, word string, df long")
    counts = materialize(counts.groupBy("lang", "word").agg(F.sum("df").alias("df")), "level-words")
    sizes = counts.where("word = ''").select("lang", F.col("df").alias("docs"))
    named = sizes.where("lang <> ''")
    total = named.agg(F.sum("docs")).first()[0]
    if total:
        chosen = {r["lang"]: r["docs"] for r in named.where(F.col("docs") >= LEAST_LANGUAGE * total).collect()}
        words = counts.where(F.col("lang").isin(list(chosen)))
    else:  # no document says its language
        chosen = {"": sizes.agg(F.sum("docs")).first()[0] or 0}
        words = counts
    limits = counts.sparkSession.createDataFrame([(k, int(v)) for k, v in chosen.items()], "lang string, docs long")
    words = words.where("word <> ''").join(F.broadcast(limits), "lang").where(F.col("df") >= LEAST_SHARE * F.col("docs"))
    rows = materialize(words.select("word", "lang", (F.col("df") / F.col("docs")).cast("float").alias("share")), "level-lists").toPandas().sort_values(["word", "lang"])
    languages = sorted(chosen)
    names, sizes = np.unique(rows["word"].to_numpy(str), return_counts=True)
    return Lists(
        languages, np.array([max(1, chosen[x]) for x in languages], dtype=float), {w: i for i, w in enumerate(names.tolist())},
        np.concatenate(([0], np.cumsum(sizes))), np.searchsorted(languages, rows["lang"].to_numpy(str)), rows["share"].to_numpy(float),
    )


def measured(docs: DataFrame, lists: Lists, id: str) -> DataFrame:
    """id, lang, words, sentence_length, outside array<double> (share of words outside the list of each cut)."""
    known = docs.sparkSession.sparkContext.broadcast(lists)
    types = dict(docs.dtypes)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, share, cuts = known.value, {}, np.array(CUTS)
        unknown = len(x.index)
        for batch in batches:
            rows = []
            for key, text in zip(batch[id], batch["text"]):
                said = sentences(text)
                ids = np.array([x.index.get(w, unknown) for s in said for w in s], dtype=np.int64)
                if len(ids):
                    lang = x.spoken(np.unique(ids))
                    if lang not in share:
                        share[lang] = x.shares_of(lang)
                    rows.append((key, x.languages[lang], len(ids), len(ids) / len(said), (share[lang][ids][:, None] < cuts).mean(axis=0)))
            yield pd.DataFrame(rows, columns=[id, "lang", "words", "sentence_length", "outside"])

    return docs.select(id, "text").mapInPandas(measure, f"`{id}` {types[id]}, lang string, words long, sentence_length double, outside array<double>")


@dataclass
class Formula:
    languages: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: Difficulties from which on a document has level 2, 3, ...
    bounds: np.ndarray
    #: Which of CUTS the formula uses.
    cuts: list[int]

    def design(self, lang: np.ndarray, length: np.ndarray, outside: np.ndarray) -> np.ndarray:
        z = (np.column_stack((outside[:, self.cuts], np.log(length))) - self.mean) / self.scale
        z = np.column_stack((z, z * z[:, -1:], np.ones(len(z))))
        return np.concatenate([z] + [z * (lang == x)[:, None] * 0.5 for x in self.languages], axis=1)

    def level(self, lang: np.ndarray, length: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hard = self.design(lang, length, outside) @ self.weights
        return hard, 1 + (hard[:, None] >= self.bounds).sum(axis=1)


def fit(labelled: pd.DataFrame, languages: list[str], penalty: float = 2.0, cuts: tuple[float, ...] = CUTS) -> Formula | None:
    """labelled: lang, sentence_length, outside, level (mean of the readers). cuts: some of CUTS. None without labels."""
    use = [CUTS.index(c) for c in cuts]
    if not len(labelled):
        return None
    lang, length = labelled["lang"].to_numpy(), labelled["sentence_length"].to_numpy(float)
    outside, y = np.stack(labelled["outside"].to_numpy()), labelled["level"].to_numpy(float)
    x = np.column_stack((outside[:, use], np.log(length)))
    f = Formula(languages, x.mean(axis=0), x.std(axis=0) + 1e-9, np.zeros(0), np.arange(LEVELS - 1) + 1.5, use)
    a = f.design(lang, length, outside)
    f.weights = np.linalg.solve(a.T @ a + penalty * np.eye(a.shape[1]), a.T @ (y))
    if len(y) >= 200:
        hard = a @ f.weights
        for k in range(LEVELS - 1):
            tried = k + 1.5 + np.arange(-10, 11) * 0.05
            right = np.array([((hard >= t) == (y >= k + 1.5)).mean() for t in tried])
            f.bounds[k] = tried[right == right.max()].mean()
        f.bounds = np.maximum.accumulate(f.bounds)
    return f


def reading_levels(docs: DataFrame, labels: DataFrame, id: str = "doc_id") -> DataFrame:
    """id, lang (as the words tell), words, sentence_length, unfamiliar (share outside the 0.1 list), difficulty, level 1..5.

    docs: id, text, lang. labels: id, rater, reading_level.
    Defined cases: documents without a word (null, empty, only digits or code
    signs) have no row; a document that is all lists is read from its lists; null
    and out of range levels are left out and repeated labels count once; repeated
    rows give one row; without any label the level is null; a missing language is
    told from the words; other columns are ignored.
    """
    docs = docs.select(id, "text", F.col("lang")).where(F.col(id).isNotNull() & (F.col("text") != ""))
    lists = familiar_words(docs)
    found = materialize(measured(docs, lists, id).dropDuplicates([id]), "level-measures")
    formula = fit(labelled_rows(found, labels, id).toPandas().sort_values(id), lists.languages)
    return scored(found, formula, id)


def labelled_rows(found: DataFrame, labels: DataFrame, id: str) -> DataFrame:
    """About MAX_LABELS measured documents, or all if there are no more, with the mean of their readers' levels."""
    said = labels.select(id, "rater", F.col("reading_level").cast("double").alias("level")).where(
        F.col(id).isNotNull() & F.col("level").between(1, LEVELS)
    )
    said = said.distinct().groupBy(id).agg(F.avg("level").alias("level"))
    both = materialize(found.join(said, id).select(id, "lang", "sentence_length", "outside", "level"), "level-labelled")
    within = min(1.0, MAX_LABELS / max(1, both.count()))
    return both.where(F.pmod(F.xxhash64(id), F.lit(1 << 30)) < int(within * (1 << 30)) + 1)


def scored(found: DataFrame, formula: Formula | None, id: str) -> DataFrame:
    types = dict(found.dtypes)
    at = CUTS.index(0.1)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[id, "lang", "words", "sentence_length"]].assign(unfamiliar=[float(o[at]) for o in batch["outside"]])
            if formula is None or not len(batch):
                out["difficulty"], out["level"] = np.nan, None
            else:
                hard, level = formula.level(batch["lang"].to_numpy(), batch["sentence_length"].to_numpy(float), np.stack(batch["outside"].to_numpy()))
                out["difficulty"], out["level"] = hard, level
            yield out

    return found.mapInPandas(score, f"`{id}` {types[id]}, lang string, words long, sentence_length double, unfamiliar double, difficulty double, level int")
