"""Language identification by cross-parsing.

Per language, a suffix automaton of labelled words finds the longest match from
any place of a word. Parsing a text greedily into longest matches gives phrases.
A phrase names a place of what was learnt, so it costs the logarithm of the learnt
length, and the language with the least cost per letter wins: one that was learnt
from little text is not put off by its longer parses alone. Phrases end with a
word, so each word is parsed once and remembered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import train_rows

#: Learnt from: about so many documents per language, chosen by a hash of their key, and so many of their words.
SAMPLE_DOCS = 1500
SAMPLE_WORDS = 4000
#: A word is left to languages where it is at least this fraction as frequent as where it is most frequent, unless a
#: language would be left without words.
SHARED = 0.2
#: Longer words are learnt as pieces of so many characters, each of which overlaps the next by half.
PIECE = 40

WORD = regex.compile(r"\p{L}+")
_CHAR_BITS = 21
_KEPT: dict = {}


def suffix_automaton(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the automaton of all substrings of `words`: (state << 21 | character) and next state; 0 is the start."""
    links, lengths, edges = [-1], [0], [{}]

    def clone(p: int, q: int, c: str) -> int:
        links.append(links[q])
        lengths.append(lengths[p] + 1)
        edges.append(dict(edges[q]))
        made = len(links) - 1
        links[q] = made
        while p >= 0 and edges[p].get(c) == q:
            edges[p][c] = made
            p = links[p]
        return made

    for word in words:
        last = 0
        for c in word:
            q = edges[last].get(c)
            if q is not None:
                last = q if lengths[q] == lengths[last] + 1 else clone(last, q, c)
                continue
            links.append(0)
            lengths.append(lengths[last] + 1)
            edges.append({})
            new, p = len(links) - 1, last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = new
                p = links[p]
            if p >= 0:
                q = edges[p][c]
                links[new] = q if lengths[q] == lengths[p] + 1 else clone(p, q, c)
            last = new
    keys = [(s << _CHAR_BITS | ord(c), to) for s, out in enumerate(edges) for c, to in out.items()]
    return np.array([k for k, _ in keys], dtype=np.int64), np.array([to for _, to in keys], dtype=np.int32)


@dataclass(frozen=True)
class CrossParser:
    """languages, and per language the edges of its automaton and what a phrase costs."""

    languages: tuple[str, ...]
    automata: tuple[tuple[np.ndarray, np.ndarray], ...]
    costs: tuple[float, ...] = ()


def phrases(edges: dict[int, int], word: str) -> int:
    """Longest matches that make up the word; a letter never seen is a phrase of its own."""
    count = state = 0
    for c in map(ord, word):
        state = edges.get(state << _CHAR_BITS | c, 0) if state else 0
        if not state:
            count += 1
            state = edges.get(c, 0)
    return count


class _Parsed(dict):
    """Row number of a word in `counts`, its phrases by language; made on demand."""

    LIMIT = 400_000

    def __init__(self, parser: CrossParser):
        super().__init__()
        self.edges = [dict(zip(k.tolist(), v.tolist())) for k, v in parser.automata]
        self.counts = np.zeros((1024, len(self.edges)), dtype=np.int32)

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.counts[row] = [phrases(e, f"^{word}$") for e in self.edges]
        self[word] = row
        return row

    def total(self, words: list[str]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        rows = list(map(self.__getitem__, words))
        return self.counts[rows].sum(axis=0, dtype=np.int64)


def _pieces(word: Column) -> Column:
    """The word between its end marks, or its pieces; only the first and the last of them have a mark."""
    marked = F.concat(F.lit("^"), word, F.lit("$"))
    starts = F.sequence(F.lit(1), F.length(marked) - PIECE // 2, F.lit(PIECE // 2))
    cut = F.transform(starts, lambda i: F.substring(marked, i, F.lit(PIECE)))
    return F.when(F.length(word) <= PIECE, F.array(marked)).otherwise(cut)


def fit_parser(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS,
    sample_words: int = SAMPLE_WORDS,
) -> CrossParser:
    """Automata from labelled documents that may be learnt from. Rows without text, language or key are left out."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter(
        train_rows(F.col("k")) & F.col("l").isNotNull())
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return CrossParser((), ())
    share = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, sample_docs / n)))])
    drawn = F.pmod(F.xxhash64("k"), F.lit(1_000_003)) / 1_000_003 < F.element_at(share, F.col("l"))
    runs = F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), F.lit(0)))
    words = rows.filter(drawn & F.col("t").isNotNull()).select(
        "l", F.explode(F.array_distinct(F.flatten(F.transform(runs, _pieces)))).alias("w"))
    seen = words.groupBy("l", "w").agg(F.count("*").alias("n"))
    first = Window.partitionBy("l").orderBy(F.desc("n"), "w")
    top = seen.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= 3 * sample_words).select("l", "w", "n").toPandas()
    drawn_docs = {name: min(n, sample_docs) for name, n in sizes.items()}
    top["rate"] = top.n / top.l.map(drawn_docs)
    top = top.sort_values(["l", "n", "w"], ascending=[True, False, True])
    own = top[top.rate >= SHARED * top.groupby("w").rate.transform("max")]
    chosen = {name: group.w.head(sample_words).tolist() for name, group in (*top.groupby("l"), *own.groupby("l"))}
    names = tuple(sorted(chosen))
    costs = tuple(math.log2(1 + sum(map(len, chosen[name]))) for name in names)
    return CrossParser(names, tuple(suffix_automaton(chosen[name]) for name in names), costs)


def predict_language(
    docs: DataFrame, parser: CrossParser, *, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    A text that is null or has no letter is `und` with score 0, as is every text if
    nothing could be learnt. Equal costs go to the language that sorts first. score
    weighs the languages by the fourth power of their inverse costs. A null key is not held out. Repeated rows get a row each; other columns
    are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = shared.value
        mark = (parser.languages, tuple(int(k.sum()) for k, _ in parser.automata))
        if mark not in _KEPT:
            _KEPT.clear()
            _KEPT[mark] = _Parsed(parser)
        known, costs = _KEPT[mark], np.array(parser.costs)
        for texts in batches:
            rows = []
            for t in texts:
                words = WORD.findall(t.lower()) if t and parser.languages else []
                if not words:
                    rows.append(("und", 0.0))
                    continue
                need = known.total(words) * costs
                best = int(need.argmin())
                rows.append((parser.languages[best], float(1 / ((need[best] / need) ** 4).sum())))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    held = F.coalesce(~train_rows(F.col(key)), F.lit(False))
    return docs.select(F.col(key).alias("doc_id"), held.alias("held_out"), predicted(F.col(text)).alias("p")).select("doc_id", "held_out", "p.*")
