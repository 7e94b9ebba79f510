"""Which words of a dictionary of any size are in which texts, by automata that walk every text once.

A dictionary is measured, and dealt into parts by a hash of its words, so that
a part's automaton fits a worker.  A part is sent to the workers as words (its
size is bounded by ``PART_CHARS``) and built there, once a worker.  Texts stay
where they are: what leaves a task is a row for each word that a text has.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mulberry.functions.slices import slices
from mulberry.operators.lineage import cut

#: Letters of the words of a part, about.  Automata that a worker keeps.
PART_CHARS, KEPT = 2_000_000, 2

_built: OrderedDict[str, ahocorasick.Automaton] = OrderedDict()


def _automaton(name: str, words: dict[str, list[str]]) -> ahocorasick.Automaton:
    """The automaton of a part, from those that this worker has built."""
    if name not in _built:
        a = ahocorasick.Automaton()
        for w in words:
            a.add_word(w, w)
        a.make_automaton()
        _built[name] = a
        while len(_built) > KEPT:
            _built.popitem(last=False)
    _built.move_to_end(name)
    return _built[name]


def parts(words: DataFrame) -> list[DataFrame]:
    """(word, genres): the distinct words in parts of about PART_CHARS letters, with what lists them (column genre, where there is one); null and empty words are left out."""
    genre = F.col("genre") if "genre" in words.columns else F.lit(None).cast("string")
    w = words.filter(F.length("word") > 0).select("word", genre.alias("genre")).groupBy("word").agg(F.sort_array(F.collect_set("genre")).alias("genres"))
    letters = w.agg(F.sum(F.length("word") + 1)).first()[0]
    if not letters:
        return []
    n = -(-letters // PART_CHARS)
    if n == 1:
        return [w]
    w = cut(w)
    return [w.filter(F.pmod(F.xxhash64("word"), F.lit(n)) == i) for i in range(n)]


def _walker(part: DataFrame, kind: str, each: Callable[[ahocorasick.Automaton, dict[str, list], str], list]) -> Column:
    """A function of texts that calls ``each`` with a part's automaton and words and every text that isn't null."""
    context = part.sparkSession.sparkContext
    sent = context.broadcast({r["word"]: r["genres"] for r in part.collect()})
    name = uuid.uuid4().hex

    @F.pandas_udf(kind)
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            a = _automaton(name, sent.value)
            for some in slices(texts):
                yield pd.Series([None if t is None else each(a, sent.value, t) for t in some], dtype=object)

    return walk


def _words_in(a: ahocorasick.Automaton, _: dict[str, list[str]], text: str) -> list[str]:
    return sorted({w for _, w in a.iter(text)})


def _outermost_in(a: ahocorasick.Automaton, genres: dict[str, list[str]], text: str) -> list[tuple[str, str]]:
    """(genre, word) of a text, without words within other words of the text and the same genre."""
    found = {w for _, w in a.iter(text)}
    covered: set[tuple[str, str]] = set()
    for w in found:
        for _, inner in a.iter(w):
            if inner != w:
                covered.update((g, inner) for g in genres[w])
    return sorted({(g, w) for w in found for g in genres[w]} - covered)


def walked(words: DataFrame, kind: str, each: Callable[[ahocorasick.Automaton, dict[str, list], str], list]) -> list[Callable[[Column], Column]]:
    """Functions from a text to what ``each`` makes of an automaton, of what column genre lists for each of its words, and of the text: one for each part of the dictionary; null texts have null."""
    return [_walker(part, kind, each) for part in parts(words)]


def contained(texts: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word): which of ``words`` (column word, any number of them) a text contains; ``key`` tells the texts apart.

    Null and empty texts and words have no rows.
    """
    slim = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") > 0)
    out = None
    for part in parts(words.select("word")):
        found = slim.select("k", F.explode(_walker(part, "array<string>", _words_in)(F.col("t"))).alias("word"))
        out = found if out is None else out.unionByName(found)
    out = slim.select("k", F.lit("").alias("word")).limit(0) if out is None else out
    return out.withColumnRenamed("k", key)


def outermost(texts: DataFrame, words: DataFrame, key: str, text: str) -> DataFrame:
    """(key, genre, word): the words (columns word, genre) that a text contains, without those within other words of the same text and genre."""
    found = parts(words)
    slim = texts.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") > 0)
    if len(found) == 1:
        pairs = _walker(found[0], "array<struct<genre:string,word:string>>", _outermost_in)(F.col("t"))
        return slim.select("k", F.explode(pairs).alias("p")).select(F.col("k").alias(key), "p.genre", "p.word")
    # words of one genre can be in different parts: what is within what comes of the dictionary itself
    listed = words.filter(F.length("word") > 0).select("genre", "word").distinct()
    met = cut(contained(slim, words, "k", "t").distinct().join(listed, "word"))
    inner = contained(listed.select("word").distinct().withColumnRenamed("word", "outer"), words, "outer", "outer").filter("outer <> word")
    inside = inner.join(listed.withColumnRenamed("word", "outer"), "outer").join(listed, ["genre", "word"]).select("genre", "outer", "word")
    covered = met.withColumnRenamed("word", "outer").join(inside, ["genre", "outer"]).select("k", "genre", "word")
    kept = met.alias("m").join(covered.distinct().alias("c"), F.expr("m.k <=> c.k and m.genre = c.genre and m.word = c.word"), "left_anti")
    return kept.select(F.col("k").alias(key), "genre", "word")
