"""The second classifier: search results, looked at again where a platform is too general, then special titles, pairs of words, authors, words of titles, and what keywords say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mulberry.functions import vocab as V
from mulberry.functions.normalize import plain_title
from mulberry.operators.genres import merge_results
from mulberry.operators.keywords import special_title
from mulberry.operators.review import valid_remap

#: Confidence from which a search result counts by itself (less for titles of hits), that an author's genre has, and below which nothing is classified.
STRONG, STRONG_TITLES, AUTHOR, LEAST = 0.80, 0.60, 0.85, 0.40
#: Genres that a platform's plain fantasy may turn out to be, and the keywords' confidence that each needs.
FINER = {"퓨판": 0.60, "판타지": 0.50, "겜판": 0.70, "역사": 0.70}


def _result(genre: Column, confidence: Column, method: Column | str) -> Column:
    return F.struct(genre.alias("genre"), F.round(confidence, 6).alias("confidence"), (F.lit(method) if isinstance(method, str) else method).alias("method"))


def _look_again(words: dict[str, list[str]]) -> Column:
    """The result of a platform's general genre after the keywords were asked; null where the platform's stands."""
    title, sg, sc, source, kg, kc = map(F.col, ("title", "search_genre", "search_confidence", "search_source", "keyword_genre", "keyword_confidence"))
    general = source.contains("naver_series") | source.contains("kakao")
    ridi = source.contains("ridibooks") & ~general
    name = F.replace(source, F.lit("_"), F.lit(""))
    both = F.least(sc, kc)
    sports = F.when((general | ridi) & (sg == "현판") & (kg == "스포츠") & (kc >= 0.70), _result(F.lit("스포츠"), F.least(sc, kc + 0.1), F.concat(name, F.lit("_sports_refined"))))
    # what keywords call modern fantasy is a blend here
    finer = F.when(kg == "현판", "퓨판").otherwise(kg)
    other = F.when(~finer.isin(list(FINER)) & (kc >= 0.60), _result(F.lit("퓨판"), both, F.concat(name, F.lit("_fusion_refined"))))
    needed = F
    for genre, least in FINER.items():
        needed = needed.when(finer == genre, least)
    holds = (kc >= needed) & ((kg == "현판") | valid_remap(title, finer, kc, words))
    fantasy = F.when(general & (sg == "판타지"), F.coalesce(other, F.when(holds, _result(finer, both, F.concat(name, F.lit("_keyword_refined"))))))
    blend = F.when(ridi & (sg == "퓨판") & kg.isin("겜판", "역사") & (kc >= 0.70) & valid_remap(title, kg, kc, words), _result(kg, both, F.when(kg == "겜판", "ridibooks_game_refined").otherwise("ridibooks_history_refined")))
    return F.coalesce(sports, fantasy, blend)


def hybrid(df: DataFrame, specials: list[tuple[str, str]], compounds: list[tuple[str, str, str, float]], words: dict[str, list[str]], searched: bool = True) -> DataFrame:
    """Add genre, confidence, method.

    ``df`` has title, search_genre, search_confidence, search_source (null if
    nothing was found), keyword_genre, keyword_confidence, n_keywords,
    author_genre, title_genre and title_confidence (null if there is none).
    ``specials`` are titles with their genre, ``compounds`` pairs of words with
    genre and confidence, ``words`` what a second look needs of a title by
    genre; all are dictionaries of bounded size.  The first step that says
    something counts.  Columns of the results' names are replaced.
    """
    title, sg, sc, kg, kc = map(F.col, ("title", "search_genre", "search_confidence", "keyword_genre", "keyword_confidence"))
    found = (F.coalesce(sg, F.lit("")) != "") & F.lit(searched)
    strong = found & (sc >= F.when(F.col("search_source") == "search_titles", STRONG_TITLES).otherwise(STRONG))
    special = special_title(title, specials)
    low = F.lower(title)
    pairs = [F.when(low.contains(a) & low.contains(b), _result(F.lit(genre), F.lit(confidence), "compound_pattern")) for a, b, genre, confidence in compounds]
    author, said = F.col("author_genre"), F.col("title_genre")
    missing = ~found & F.lit(searched)
    merged = merge_results(kg, kc, F.col("n_keywords"), F.when(found, sg), F.when(found, sc))
    last = F.when(merged["confidence"] >= LEAST, merged).when(author.isNotNull() & (merged["genre"] == V.UNCLASSIFIED), _result(author, F.lit(AUTHOR), "author_genre_db_fallback")).otherwise(_result(F.lit(V.UNCLASSIFIED), merged["confidence"], F.concat(merged["method"], F.lit("_low_confidence"))))
    steps = [
        F.when(strong, F.coalesce(_look_again(words), _result(sg, sc, F.concat(F.lit("naver_"), F.col("search_source"), F.lit("_priority"))))),
        F.when(special.isNotNull(), _result(special, F.lit(0.95), "special_case")),
        *pairs,
        F.when(missing & author.isNotNull(), _result(author, F.lit(AUTHOR), "author_genre_db")),
        F.when(missing & said.isNotNull() & (F.col("title_confidence") >= 0.8), _result(said, F.col("title_confidence"), "title_keyword_analysis")),
        last,
    ]
    return df.withColumn("_r", F.coalesce(*steps)).select(*[c for c in df.columns if c not in ("genre", "confidence", "method")], "_r.genre", "_r.confidence", "_r.method")


def classify_files(files: DataFrame, name: str, specials: list[tuple[str, str]], compounds: list[tuple[str, str, str, float]], words: dict[str, list[str]], searched: bool = True) -> DataFrame:
    """The same for file names: the title is taken from the name; names without a title are unclassified."""
    titled = files.withColumn("title", plain_title(F.col(name)))
    done = hybrid(titled, specials, compounds, words, searched)
    empty = F.coalesce("title", F.lit("")) == ""
    return done.withColumns({"genre": F.when(empty, V.UNCLASSIFIED).otherwise(F.col("genre")), "confidence": F.when(empty, 0.0).otherwise(F.col("confidence")), "method": F.when(empty, "no_title").otherwise(F.col("method"))})
