"""Keyword scoring of texts against a dictionary that is a parameter: (genre_pos, genre, pos, keyword, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mulberry.functions import vocab as V
from mulberry.operators.dictionary import contained, outermost

#: Keywords up to which a dictionary is one array literal beside every text; larger ones are automata, which walk a text once.
ARRAY_KEYWORDS = 64


def literal_array(table: DataFrame, columns: list[str]) -> Column:
    """A dictionary of at most ARRAY_KEYWORDS rows as one constant array of structs, in the order of the columns."""
    rows = table.select(*columns).limit(ARRAY_KEYWORDS + 1).collect()
    if len(rows) > ARRAY_KEYWORDS:
        raise ValueError(f"more than {ARRAY_KEYWORDS} rows are no constant")
    kind = table.select(*columns).schema.simpleString()
    rows = sorted(rows, key=lambda r: tuple((v is None, v) for v in r))
    return F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, r, strict=True)]) for r in rows]).cast(f"array<{kind}>")


def _few(table: DataFrame) -> bool:
    return len(table.limit(ARRAY_KEYWORDS + 1).select(F.lit(1)).collect()) <= ARRAY_KEYWORDS


def keyword_matches(texts: DataFrame, keywords: DataFrame, key: str, text: str, shortest: int = 2) -> DataFrame:
    """(key, genre, keyword, weight): keywords of two letters or more that a text contains, without those within longer ones of the same genre.

    A few keywords are one constant array; of a larger dictionary every text is
    walked once by an automaton and stays where it is.
    """
    rows = keywords.filter(F.length("keyword") >= shortest).select("genre_pos", "genre", "pos", F.lower("keyword").alias("keyword"), "weight")
    low = texts.select(key, F.lower(text).alias("_low"))
    if not _few(rows):
        found = outermost(low, rows.withColumnRenamed("keyword", "word"), key, "_low").withColumnRenamed("word", "keyword")
        return found.join(rows.distinct(), ["genre", "keyword"]).select(key, "genre_pos", "genre", "keyword", "weight")
    table = literal_array(rows, ["genre_pos", "genre", "pos", "keyword", "weight"])
    per = low.select(key, F.filter(table, lambda k: F.col("_low").contains(k["keyword"])).alias("m")).filter(F.size("m") > 0)
    m = F.col("m")
    kept = F.filter(m, lambda a: ~F.exists(m, lambda b: (b["genre"] == a["genre"]) & (b["keyword"] != a["keyword"]) & b["keyword"].contains(a["keyword"])))
    return per.select(key, F.explode(F.array_distinct(kept)).alias("k")).select(key, "k.genre_pos", "k.genre", "k.keyword", "k.weight")


def genre_scores(matches: DataFrame, keywords: DataFrame, key: str, pairs: DataFrame | None = None) -> DataFrame:
    """(key, genre_pos, genre, raw, score): sums of weights, and 8 for every compound pair, over the root of the genre's number of keywords."""
    size = keywords.groupBy("genre").agg(F.count("*").alias("n"))
    raw = matches.groupBy(key, "genre_pos", "genre").agg(F.sum("weight").cast("double").alias("raw"))
    if pairs is not None:
        raw = raw.join(pairs, [key, "genre"], "left").withColumn("raw", F.col("raw") + 8 * F.coalesce("n_pairs", F.lit(0))).drop("n_pairs")
    return raw.join(F.broadcast(size), "genre").select(key, "genre_pos", "genre", "raw", (F.col("raw") / F.sqrt("n")).alias("score"))


def compound_pairs(texts: DataFrame, compounds: DataFrame, key: str, text: str) -> DataFrame:
    """(key, genre, n_pairs): how many pairs of keywords a text has both of."""
    pairs = compounds.select("genre", F.lower("kw1").alias("a"), F.lower("kw2").alias("b"))
    low = texts.select(key, F.lower(text).alias("_t"))
    if _few(pairs):
        table = literal_array(pairs, ["genre", "a", "b"])
        hits = low.select(key, F.explode(F.filter(table, lambda p: F.col("_t").contains(p["a"]) & F.col("_t").contains(p["b"]))).alias("p")).select(key, "p.genre")
    else:
        found = contained(low, pairs.select(F.col("a").alias("word")).union(pairs.select("b")), key, "_t")
        one = found.withColumnRenamed("word", "a").join(pairs, "a")
        hits = one.join(found.withColumnRenamed("word", "b"), [key, "b"]).select(key, "genre")
    return hits.groupBy(key, "genre").agg(F.count("*").alias("n_pairs"))


def top_genres(scores: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The n best genres of positive score, ties by the dictionary's order, with their rank."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "genre_pos")
    return scores.filter("score > 0").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def best_with_confidence(scores: DataFrame, key: str) -> DataFrame:
    """(key, genre, score, gap, confidence): the best genre; its share of all scores and the relative lead over the next (0.3 at most)."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "genre_pos")
    every = Window.partitionBy(key)
    s = scores.filter("score > 0").withColumns({"rank": F.row_number().over(w), "next": F.lead("score").over(w), "total": F.sum("score").over(every)})
    gap = F.col("score") - F.coalesce("next", F.lit(0.0))
    confidence = F.when(F.col("next").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("score") / F.col("total") + F.least(gap / F.col("score"), F.lit(0.3))))
    return s.filter("rank = 1").select(key, "genre", F.round("score", 6).alias("score"), F.round(gap, 6).alias("gap"), F.round(confidence, 6).alias("confidence"))


def specificity(keywords: DataFrame) -> DataFrame:
    """(keyword, n_genres, specificity): the fewer genres a keyword has, the more it says."""
    n = F.col("n_genres")
    return keywords.groupBy("keyword").agg(F.countDistinct("genre").alias("n_genres")).withColumn("specificity", F.when(n == 1, 5).when(n == 2, 3).when(n == 3, 2).otherwise(1))


def list_scores(texts: DataFrame, keywords: DataFrame, key: str, text: str) -> DataFrame:
    """(key, genre, score): one for each listing of a contained keyword; a keyword listed twice counts twice."""
    listed = keywords.select("genre", F.lower("keyword").alias("keyword"))
    low = texts.select(key, F.lower(text).alias("_t"))
    if _few(listed):
        table = literal_array(listed, ["genre", "keyword"])
        hits = low.select(key, F.explode(F.filter(table, lambda k: F.col("_t").contains(k["keyword"]))).alias("k")).select(key, "k.genre")
    else:
        hits = contained(low, listed.select(F.col("keyword").alias("word")), key, "_t").join(listed.withColumnRenamed("keyword", "word"), "word").select(key, "genre")
    return hits.groupBy(key, "genre").agg(F.count("*").alias("score"))


def title_keyword_confidence(best: Column) -> Column:
    return F.least(F.lit(0.6), best / 20)


def special_title(title: Column, specials: list[tuple[str, str]]) -> Column:
    """Genre of the first special title contained, in the list's order."""
    out = F
    for name, genre in specials:
        out = out.when(title.contains(name), genre)
    return out.otherwise(None) if specials else F.lit(None).cast("string")


def title_keywords(titles: DataFrame, keywords: DataFrame, key: str, title: str, specific: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, genre, confidence, matched_keywords, reason): what the words of a title say.

    Particular words (``specific``, of either case) decide by the order of their
    genres.  Else the genre of the greatest sum of weights of ``keywords``
    (genre_pos, genre, pos, keyword, weight; of a title's own case) does, of
    equal sums the first, less sure.  Null and empty titles and titles without
    such words have no genre.
    """
    table = V.SPECIFIC_KEYWORDS if specific is None else specific
    t = titles.select(key, F.coalesce(F.col(title), F.lit("")).alias("_t"))
    low = F.lower("_t")
    sure = F
    for genre, words in table.items():
        # an empty list of words decides nothing
        met = F.filter(F.array(*map(F.lit, words)).cast("array<string>"), lambda w: F.contains(F.col("_t"), w) | F.contains(low, F.lower(w)))
        sure = sure.when(F.size(met) > 0, F.struct(F.lit(genre).alias("genre"), F.lit(0.9).alias("confidence"), met.alias("matched_keywords"), F.lit(f"제목에 구체적인 {genre} 키워드 포함").alias("reason")))
    kind = "struct<genre:string,confidence:double,matched_keywords:array<string>,reason:string>"
    t = t.withColumn("_s", sure.otherwise(F.lit(None).cast(kind)) if table else F.lit(None).cast(kind))
    rows = keywords.filter(F.length("keyword") > 0).select("genre_pos", "genre", "pos", "keyword", "weight")
    open_ = t.filter("_s is null")
    found = contained(open_, rows.select(F.col("keyword").alias("word")), key, "_t").distinct().join(rows.withColumnRenamed("keyword", "word"), "word")
    sums = found.groupBy(key, "genre_pos", "genre").agg(F.sum("weight").cast("double").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w")).filter("n > 0")
    best = sums.groupBy(key).agg(F.max_by(F.struct("genre", "n", "w"), F.struct("n", -F.col("genre_pos"))).alias("_b"))
    less = F.struct(F.col("_b.genre").alias("genre"), title_keyword_confidence(F.col("_b.n")).alias("confidence"), F.col("_b.w.word").alias("matched_keywords"), F.concat(F.lit("제목에 "), F.col("_b.genre"), F.lit(" 키워드 포함 (낮은 신뢰도)")).alias("reason"))
    none = F.struct(F.lit(None).cast("string").alias("genre"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("matched_keywords"), F.lit("매칭되는 키워드 없음").alias("reason"))
    out = t.join(best, key, "left").withColumn("_r", F.coalesce("_s", F.when(F.col("_b").isNotNull(), less), none))
    return out.select(key, "_r.*")


def author_genre(df: DataFrame, authors: DataFrame, author: str = "author") -> DataFrame:
    """Add author_genre: of the same name without spaces, else of the first name that contains it or is contained.

    ``authors`` is (pos, author, genre), of any size; of a name listed twice the
    later genre counts, at the first place.
    """
    w = Window.partitionBy("name")
    table = authors.withColumn("name", F.replace(F.col("author"), F.lit(" "), F.lit("")))
    table = table.withColumns({"at": F.min("pos").over(w), "g": F.max_by("genre", "pos").over(w)}).select("name", "at", "g").distinct()
    bare = F.replace(F.coalesce(F.col(author), F.lit("")), F.lit(" "), F.lit(""))
    d = df.withColumn("_b", bare)
    if _few(table):
        one = literal_array(table, ["at", "name", "g"])
        same = F.filter(one, lambda a: a["name"] == F.col("_b"))
        near = F.filter(one, lambda a: a["name"].contains(F.col("_b")) | F.col("_b").contains(a["name"]))
        found = F.coalesce(F.get(same, F.lit(0))["g"], F.get(near, F.lit(0))["g"])
        return d.withColumn("author_genre", F.when(F.col("_b") != "", found)).drop("_b")
    # each different credit is looked for among the names and each name among the credits
    asked, names = d.select(F.col("_b").alias("b")).filter("b <> ''").distinct(), table.select("name")
    has = contained(asked, names.withColumnRenamed("name", "word"), "b", "b").select("b", F.col("word").alias("name"))
    within = contained(names, asked.withColumnRenamed("b", "word"), "name", "name").select(F.col("word").alias("b"), "name")
    near = has.unionByName(within).join(table, "name")
    if blank := table.filter("name = ''").first():  # an empty name is in every credit, as no automaton tells
        near = near.unionByName(asked.select("b", F.lit("").alias("name"), F.lit(blank["at"]).alias("at"), F.lit(blank["g"]).alias("g")))
    best = near.groupBy("b").agg(F.min_by("g", F.struct(F.col("name") != F.col("b"), "at")).alias("author_genre"))
    return d.join(best.withColumnRenamed("b", "_b"), "_b", "left").select(*df.columns, "author_genre")
