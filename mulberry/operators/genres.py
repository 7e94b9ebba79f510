"""Genre decisions as columns: mapping, evidence, fusion of platforms, remapping by title, the cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mulberry.functions import vocab as V
from mulberry.functions.normalize import cache_key, first_key, let, literal_table

_MAP = {name: genre for genre, names in V.GENRE_MAP.items() for name in names}


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def map_genre(c: Column) -> Column:
    """Standard genre of a platform's genre: exact, else the longest contained name; unclassified otherwise."""
    names = literal_table(_MAP)
    longest = literal_table({k: _MAP[k] for k in sorted(_MAP, key=len, reverse=True)})

    def found(name: Column) -> Column:
        exact = F.get(F.filter(names, lambda k: k["k"] == name), F.lit(0))
        inside = F.get(F.filter(longest, lambda k: F.contains(name, k["k"])), F.lit(0))
        return F.coalesce(exact["g"], inside["g"], F.lit(V.UNCLASSIFIED))

    mapped = let(F.trim(F.coalesce(c, F.lit(""))), found)
    return let(mapped, lambda g: F.when(g.isin(V.MAPPED_GENRES), g).otherwise(V.UNCLASSIFIED))


def specificity(genre: Column) -> Column:
    """1 to 4; 2 for genres that aren't listed."""
    out = F
    for n, genres in V.SPECIFICITY.items():
        out = out.when(genre.isin(genres), n)
    return out.otherwise(2)


def remap_by_title(genre: Column, title: Column) -> Column:
    """The first rule whose words the title has often enough moves the genre."""
    low = F.lower(title)
    bare = F.replace(low, F.lit(" "), F.lit(""))
    out = F
    for target, (origins, least, words, forbidden) in V.TITLE_REMAP.items():
        hits = F.size(F.filter(F.array(*[F.lit(w.lower()) for w in words]), lambda w: low.contains(w) | bare.contains(w)))
        free = ~F.exists(F.array(*[F.lit(w.lower()) for w in forbidden]).cast("array<string>"), lambda w: low.contains(w))
        out = out.when(genre.isin(origins) & free & (hits >= least), target)
    return F.when((F.coalesce(genre, F.lit("")) == "") | (F.coalesce(title, F.lit("")) == ""), genre).otherwise(out.otherwise(genre))


def remapped_confidence(before: Column, after: Column, confidence: Column) -> Column:
    return F.when(before == after, confidence).otherwise(F.greatest(F.lit(0.85), confidence - 0.03))


def text_evidence(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, genre, pos): the genres whose patterns a text has, each once."""
    hits = [F.when(F.col(text).rlike("(?i)" + "|".join(pats)), F.struct(F.lit(g).alias("genre"), F.lit(i).alias("pos"))) for i, (g, (_, pats)) in enumerate(V.EVIDENCE.items())]
    return df.select(key, F.explode(F.array_compact(F.array(*hits))).alias("e")).select(key, "e.genre", "e.pos")


def resolve_evidence(evidence: DataFrame, key: str) -> DataFrame:
    """(key, genre, score, confidence): the genre of the highest rank, then of the most texts, then met first.

    A single text is too little, but for general genres.  ``evidence`` has
    (key, genre, pos); pos orders what was met.
    """
    counts = evidence.groupBy(key, "genre").agg(F.count("*").alias("score"), F.min("pos").alias("pos"))
    rank = F
    for genre, (n, _) in V.EVIDENCE.items():
        rank = rank.when(F.col("genre") == genre, n)
    rank = rank.when(F.col("genre") == "소설", 10).otherwise(0)
    w = Window.partitionBy(key).orderBy(F.desc("rank"), F.desc("score"), "pos")
    best = counts.withColumn("rank", rank).withColumn("n", F.row_number().over(w)).filter("n = 1")
    best = best.filter((F.col("score") > 1) | F.col("genre").isin(V.GENERIC_EVIDENCE))
    return best.select(key, "genre", "score", evidence_confidence(F.col("score")).alias("confidence"))


def evidence_confidence(score: Column) -> Column:
    return F.least(F.lit(0.95), 0.6 + F.least(score, F.lit(5)) * 0.07)


def should_scrape(url: Column, genres: Column) -> Column:
    """Nothing found yet, or nothing but general genres on a site that says more."""
    rich = F.exists(F.array(*map(F.lit, V.RICH_SITES)), lambda s: url.contains(s))
    general = F.forall(genres, lambda g: g.isin(V.GENERIC_GENRES))
    return (F.size(genres) == 0) | (rich & general)


def fuse_platforms(evidence: DataFrame, key: str = "query_id", title: str = "title") -> DataFrame:
    """One genre per query of the platforms' results, by a fold in the platforms' order.

    ``evidence`` has (key, title, platform, genre, confidence,
    needs_sports_check, needs_fantasy_refinement).  A fold over at most a dozen
    platforms: general results are held back for more specific ones after them.
    """
    order = F
    for p, (rank, place, _) in V.PLATFORMS.items():
        order = order.when(F.col("platform") == p, rank * 100 + place)
    row = F.struct(order.otherwise(9999).alias("at"), "platform", "genre", F.col("confidence").cast("double").alias("confidence"), F.coalesce("needs_sports_check", F.lit(False)).alias("sports"), F.coalesce("needs_fantasy_refinement", F.lit(False)).alias("fantasy"))
    per = evidence.filter(F.coalesce("genre", F.lit("")) != "").groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("rows"), F.first(title).alias("_title"))
    kind = "struct<platform:string,genre:string,confidence:double>"
    empty = F.lit(None).cast(kind)
    ridi_and_munpia = F.exists("rows", lambda r: r["platform"] == "리디북스") & F.exists("rows", lambda r: r["platform"] == "문피아")
    # what a title makes of a result is worked out once a result, before the fold
    after = F.transform("rows", lambda r: r.withField("after", remap_by_title(r["genre"], F.col("_title"))))
    per = per.withColumn("_two", ridi_and_munpia).withColumn("rows", after)
    start = F.struct(F.lit(False).alias("done"), *[empty.alias(n) for n in ("out", "ridi", "modern", "fantasy", "novel")])

    def held(r: Column, genre: Column | None = None, confidence: Column | None = None) -> Column:
        return F.struct(r["platform"].alias("platform"), (r["genre"] if genre is None else genre).alias("genre"), (r["confidence"] if confidence is None else confidence).alias("confidence"))

    def step(a: Column, r: Column) -> Column:
        def state(**new: Column) -> Column:
            return F.struct(*[new.get(n, a[n]).alias(n) for n in ("done", "out", "ridi", "modern", "fantasy", "novel")])

        def stop(x: Column) -> Column:
            return state(done=F.lit(True), out=x)

        g, two = r["genre"], F.col("_two")
        better = F.when(a["ridi"].isNull() | (specificity(g) > specificity(a["ridi"]["genre"])), held(r)).otherwise(a["ridi"])
        after = r["after"]
        mine = held(r, after, remapped_confidence(g, after, r["confidence"]))
        takes_modern = a["modern"].isNotNull() & after.isin("스포츠", "역사")
        takes_fantasy = a["fantasy"].isNotNull() & after.isin("역사", "겜판", "퓨판", "스포츠")
        return (
            F.when(a["done"], a)
            .when(two & (r["platform"] == "리디북스"), state(ridi=held(r)))
            .when(two & (r["platform"] == "문피아"), stop(better))
            .when(r["sports"] & (g == "현판"), state(modern=held(r)))
            .when(r["fantasy"] & (g == "판타지"), state(fantasy=held(r)))
            .when(a["modern"].isNotNull() & g.isin("스포츠", "역사"), stop(held(r)))
            .when(a["fantasy"].isNotNull() & g.isin("역사", "겜판", "퓨판", "스포츠"), stop(held(r)))
            .when(a["fantasy"].isNotNull() & (g == "판타지"), a)
            .when(a["ridi"].isNotNull() & (a["ridi"]["genre"] != "소설") & (specificity(a["ridi"]["genre"]) >= specificity(g)), a)
            .when(takes_modern | takes_fantasy, stop(mine))
            .when(after == "소설", state(novel=F.coalesce(a["novel"], mine)))
            .otherwise(stop(mine))
        )

    folded = per.withColumn("a", F.aggregate("rows", start, step))
    out = folded.withColumn("o", F.coalesce("a.out", "a.ridi", "a.modern", "a.fantasy", "a.novel"))
    return out.select(key, "o.platform", "o.genre", F.round("o.confidence", 6).alias("confidence"))


def merge_results(keyword_genre: Column, keyword_confidence: Column, n_keywords: Column, search_genre: Column, search_confidence: Column) -> Column:
    """struct(genre, confidence, method) of a keyword and a search result."""

    def out(genre: Column, confidence: Column, method: str) -> Column:
        return F.struct(genre.alias("genre"), F.round(confidence, 6).alias("confidence"), F.lit(method).alias("method"))

    k = F.when(n_keywords <= 1, F.least(keyword_confidence, F.lit(0.60))).when(n_keywords == 2, F.least(keyword_confidence, F.lit(0.75))).otherwise(keyword_confidence)
    agree = F.least(F.lit(0.95), 1 - (1 - keyword_confidence) * (1 - search_confidence))
    return (
        F.when(F.coalesce(search_genre, F.lit("")) == "", out(keyword_genre, keyword_confidence, "keyword_only"))
        .when(keyword_genre == V.UNCLASSIFIED, out(search_genre, search_confidence, "naver_only"))
        .when(keyword_genre == search_genre, out(keyword_genre, agree, "both_agree"))
        .when(search_confidence >= 0.80, out(search_genre, search_confidence, "naver_high_confidence"))
        .when(k >= search_confidence + 0.20, out(keyword_genre, k, "keyword_high_confidence"))
        .when(search_confidence > k, out(search_genre, search_confidence * 0.9, "naver_higher_confidence"))
        .otherwise(out(keyword_genre, k * 0.9, "keyword_higher_confidence"))
    )


def classify(tasks: DataFrame, cache: DataFrame, search: DataFrame, keywords: DataFrame) -> DataFrame:
    """The cascade: nothing to go by, own genre, leading tag, cache, search, keywords, unclassified.

    ``tasks`` has task_id, raw_name, title, genre; ``cache`` key, genre,
    confidence, source; ``search`` and ``keywords`` task_id, genre (and source).
    Each step is a candidate; the first one that isn't null counts.  Of several
    hits of a task the first with a genre counts (by ``pos``, if there is one,
    then by genre), and of several entries of a cache key the least.
    """

    def one(df: DataFrame, key: str, *columns: str) -> DataFrame:
        order = [F.coalesce("genre", F.lit("")) == "", *([F.col("pos")] if "pos" in df.columns else []), F.col("genre"), *map(F.col, columns)]
        first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct("genre", *columns).alias("x"))).alias("m")
        return df.groupBy(key).agg(first).select(key, "m.x.*")

    cache, search, keywords = one(cache, "key", "confidence", "source"), one(search, "task_id", "source"), one(keywords, "task_id")
    t = tasks.withColumn("_key", cache_key(F.when(F.col("title") != "", F.col("title")).otherwise(F.col("raw_name"))))
    t = t.join(cache.select(F.col("key").alias("_key"), F.col("genre").alias("_cg"), F.col("confidence").alias("_cc"), F.col("source").alias("_cs")), "_key", "left")
    t = t.join(search.select("task_id", F.col("genre").alias("_sg"), F.col("source").alias("_ss")), "task_id", "left")
    t = t.join(keywords.select("task_id", F.col("genre").alias("_kg")), "task_id", "left")
    tag = F.regexp_extract("raw_name", r"^\s*\[([^\]]+)\]", 1)

    def hit(genre: Column, confidence: str | Column, source: str | Column) -> Column:
        return F.struct(genre.alias("genre"), (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence"), (F.lit(source) if isinstance(source, str) else source).alias("source"))

    kg = map_genre(F.col("_kg"))
    steps = [
        F.when((F.col("raw_name") == "") & (F.col("title") == ""), hit(F.lit(V.UNCLASSIFIED), "low", "-")),
        F.when(F.col("genre") != "", hit(map_genre(F.col("genre")), "high", "tag")),
        F.when(tag != "", hit(map_genre(tag), "high", "tag")),
        F.when(F.col("_cg").isNotNull(), hit(F.col("_cg"), F.col("_cc"), F.col("_cs"))),
        F.when(F.coalesce("_sg", F.lit("")) != "", hit(map_genre(F.col("_sg")), "high", F.coalesce("_ss", F.lit("-")))),
        F.when(F.col("_kg").isNotNull() & (kg != V.UNCLASSIFIED), hit(kg, "medium", "keyword")),
        hit(F.lit(V.UNCLASSIFIED), "low", "-"),
    ]
    return t.withColumn("_r", F.coalesce(*steps)).select(*[c for c in tasks.columns if c not in ("genre", "confidence", "source")], "_r.genre", "_r.confidence", "_r.source")


def apply_overrides(tasks: DataFrame, overrides: DataFrame, every: bool = False) -> DataFrame:
    """Answers to rows of medium confidence (or to every row): a genre is taken, a null skips the row.

    ``overrides`` has (task_id, selected_genre), one row per answer; rows
    without an answer pass.
    """
    o = overrides.select("task_id", "selected_genre", F.lit(True).alias("_asked"))
    asked = F.coalesce("_asked", F.lit(False)) & (F.lit(True) if every else F.col("confidence") == "medium")
    t = tasks.join(o, "task_id", "left").withColumn("_a", asked)
    yes = F.col("_a") & F.col("selected_genre").isNotNull()
    return t.withColumns({"genre": F.when(yes, F.col("selected_genre")).otherwise(F.col("genre")), "confidence": F.when(yes, "high").otherwise(F.col("confidence")), "source": F.when(yes, "사용자").otherwise(F.col("source")), "status": F.when(F.col("_a") & F.col("selected_genre").isNull(), "skipped").otherwise(F.col("status"))}).select(*tasks.columns)
