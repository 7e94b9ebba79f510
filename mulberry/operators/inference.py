"""Genre from a name alone: an ordered table of rules, first match wins, then keyword counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.operators.first_rule import fixed_rule
from mulberry.operators.keywords import list_scores

_SPORTS = ["야구", "축구", "농구", "배구", "선수", "팀", "리그", "골프", "수영", "육상", "레슬링"]

# Rules in order. Each group of words needs one of them in the name; (groups, words that forbid it, genre, confidence).
RULES: list[tuple[list[list[str]], list[str], str | None, str]] = [
    ([["갓겜"]], [], "겜판", "high"),
    ([["게임 속", "게임속"]], [], "겜판", "high"),
    ([["게임"], ["현실"]], [], "겜판", "high"),
    ([["게임 개발", "게임개발"], ["제국"]], [], "퓨판", "high"),
    ([["게임 마인드", "게임마인드"], ["중세"]], [], "역사", "high"),
    ([["pd"], ["마법"]], [], "퓨판", "high"),
    ([["재벌"], ["검사"]], [], "현판", "high"),
    ([["/(19[89][0-9]|20[0-9]{2})"], ["대한민국", "한국", "독립", "전쟁", "대전", "어촌", "돌아가다", "귀향"]], [], "현판", "high"),
    ([["조선"]], ["유조선"], "역사", "high"),
    ([["대한제국", "구한말"]], [], "역사", "high"),
    ([["온라인"]], [], "겜판", "medium"),
    ([["혈"], ["21세기", "20세기", "19세기", "2024", "2025", "2030", "현대"]], [], "현판", "high"),
    ([["천마"], ["유산", "계승"]], [], "퓨판", "high"),
    ([["감전"], ["엔지니어"]], [], "현판", "high"),
    ([["주식"], ["퇴사"]], [], "현판", "high"),
    ([["천마"], ["방송", "중화요리사", "요리사"]], [], "현판", "high"),
    ([["배우", "아이돌"], ["팬", "연예계", "회사", "작곡"]], [], "현판", "high"),
    ([["공학자"], ["영지"]], [], "퓨판", "high"),
    ([["마공학자"]], [], "퓨판", "high"),
    ([["용병"], ["방송"]], [], "현판", "high"),
    ([["파티셰"]], [], "현판", "high"),
    ([["아이돌"], ["그룹", "이야기", "생활", "일상", "데뷔", "활동"]], [], "현판", "high"),
    ([["판사", "변호사"], ["일상", "생활", "법정", "재판", "사건", "의뢰인"]], [], "현판", "high"),
    ([["편의점"], ["알바", "아르바이트", "점원", "생활", "이야기", "일상"]], [], "퓨판", "high"),
    ([["톱스타", "탑스타"]], [], "현판", "high"),
    ([["회사"], ["직장", "사원", "부장", "과장", "상사", "동료", "입사", "퇴사", "탈주"]], [], "현판", "high"),
    ([["대마법사", "네크로맨서", "드래곤", "마왕", "정령"]], [], "판타지", "high"),
    ([["검황", "천마", "무림", "강호", "검성", "검제", "검마", "곤륜", "점창", "무당파", "소림", "남궁세가", "제갈세가", "팽가", "아미파", "무제", "무신", "호위무사"]], [], "무협", "high"),
    ([["검술명가", "z 시대", "아카데미"]], [], "퓨판", "high"),
    ([["갓겜", "mmorpg", "rpg"]], [], "겜판", "high"),
    ([["공작", "황제", "악녀", "공녀", "황녀", "집착한다"]], [], "로판", "high"),
    ([["sf", "우주선", "안드로이드", "사이보그"]], [], "SF", "high"),
    ([["선인", "득도", "선계", "법술", "신선", "수선", "선협"]], [], "선협", "high"),
    ([["mlb", "nba", "라리가", "프리미어리그", "분데스리그", "레슬링", "라운더", "마운드", "발롱도르", "축구화"]], [], "스포츠", "high"),
    ([["좀비", "호러"]], [], "공포", "high"),
    ([["열도", "침몰", "작전명", "임진왜란", "병자호란", "바이킹", "1941", "1945", "구한말", "대한제국"]], [], "역사", "high"),
    (
        [
            ["비트코인", "걸그룹", "국세청", "국가실세", "게이트", "각성자", "엔지니어", "영화감독", "프로듀서", "엔터테인먼트", "회사원", "신입사원", "유튜브", "유튜버", "스트리밍", "인공지능", "트럭", "해킹", "해커", "핵무기", "ceo", "대학생", "복학생"]
        ],
        [],
        "현판",
        "high",
    ),
    ([[r"/(?U)\b(s+급|ex급)"], ["운빠", "운빨", "확률", "가챠", "뽑기", "랜덤"]], [], "겜판", "high"),
    ([[r"/(?U)\b(s+급|ex급)"]], [], "퓨판", "medium"),
    ([["헌터"]], [], "퓨판", "medium"),
    ([["혈마"]], [], "무협", "high"),
    ([["감독"], [*_SPORTS, "라운더", "라운드", "마운드", "코트"]], [], "스포츠", "high"),
    ([["감독"], ["영화", "프로듀서", "엔터테인먼트", "배우", "연기", "촬영"]], [], "현판", "high"),
    ([["감독"]], [], None, "low"),
    ([["라운더", "라운드", "마운드", "코트", "링", "경기장"]], [], "스포츠", "high"),
    ([["투수", "포수", "유격수", "1루수", "2루수", "3루수", "외야수", "중견수", "타자", "홈런", "공격수", "스트라이커", "수비수", "미들필더", "미드필더", "슈팅", "월클", "복서", "복싱", "킥복싱", "유도", "태권도"]], [], "스포츠", "high"),
    ([["영화감독", "프로듀서", "엔터테인먼트", "회사원", "신입사원"]], [], "현판", "high"),
    ([["제대", "이등병", "병장", "소대장", "군대", "입대"], ["마법", "던전", "검", "무림", "강호"]], [], "퓨판", "medium"),
    ([["제대", "이등병", "병장", "소대장", "군대", "입대"]], [], "현판", "medium"),
    ([["매니저"], [*_SPORTS, "감독"]], [], "스포츠", "high"),
    ([["매니저"]], [], "현판", "medium"),
    ([["재벌"]], [], "현판", "high"),
    ([["백작", "자작", "남작", "공작", "후작", "공녀", "황녀"]], [], "판타지", "medium"),
]
IMMORTAL = ["선협", "신선", "수선", "선인", "선계", "득도"]
ALONE_ENOUGH = ["무협", "선협", "로판", "SF", "스포츠", "공포", "역사"]
LEGACY_MAP = {"퓨전": "퓨판", "게임": "겜판", "로맨스": "로판", "BL": "로판"}


#: The rules as terms (rule, group, word, pattern); group 0 forbids.
TERMS = [(i, j, w.removeprefix("/"), w.startswith("/")) for i, (groups, forbidden, *_) in enumerate(RULES, 1) for j, g in enumerate([forbidden, *groups]) for w in g]


def rule_of(spark: SparkSession, name: Column) -> Column:
    """struct(rule, genre, confidence) of the first rule that fits; null if none does.

    Rule 0: names of Hangul alone, of immortals or else longer than six
    letters, which may be transcribed and say nothing.
    """
    kind = "struct<rule:long,genre:string,confidence:string>"
    low = F.lower(name)
    hangul = low.rlike("^[가-힣]+$")
    zero = F.when(F.exists(F.array(*map(F.lit, IMMORTAL)), lambda w: low.contains(w)), F.struct(F.lit(0), F.lit("선협"), F.lit("high")).cast(kind)).when(F.length(low) > 6, F.struct(F.lit(0), F.lit(None), F.lit("low")).cast(kind))
    says = F.array(*[F.struct(F.lit(i), F.lit(genre), F.lit(confidence)).cast(kind) for i, (*_, genre, confidence) in enumerate(RULES, 1)])
    # rules are numbered from 1 without gaps
    return F.coalesce(F.when(hangul, zero), F.get(says, fixed_rule(spark, TERMS)(low).cast("int") - 1))


def infer_genre(names: DataFrame, keywords: DataFrame, key: str = "pos", name: str = "raw_name") -> DataFrame:
    """(key, genre, confidence): by the rules, else by the most keywords of a genre: two are high, one is medium for some genres.

    ``keywords`` is (genre_pos, genre, keyword); ties go to the first genre.
    """
    ruled = names.select(key, F.col(name).alias("_n"), rule_of(names.sparkSession, F.col(name)).alias("_r"))
    open_names = ruled.filter("_r is null").select(key, "_n")
    scores = list_scores(open_names, keywords, key, "_n")
    order = keywords.groupBy("genre").agg(F.min("genre_pos").alias("genre_pos"))
    best = scores.join(F.broadcast(order), "genre").groupBy(key).agg(F.max(F.struct("score", (-F.col("genre_pos")).alias("first"), "genre")).alias("b"))
    j = ruled.join(best, key, "left")
    score, genre = F.col("b.score"), F.col("b.genre")
    mapped = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEGACY_MAP.items() for x in kv]), genre), genre)
    counted = F.when(score >= 2, F.struct(genre.alias("genre"), F.lit("high").alias("confidence"))).when((score == 1) & genre.isin(ALONE_ENOUGH), F.struct(mapped.alias("genre"), F.lit("medium").alias("confidence")))
    none = F.struct(F.lit(None).cast("string").alias("genre"), F.lit("low").alias("confidence"))
    r = F.when(F.col("_r").isNotNull(), F.struct(F.col("_r.genre").alias("genre"), F.col("_r.confidence").alias("confidence"))).otherwise(F.coalesce(counted, none))
    return j.select(key, r.alias("x")).select(key, "x.genre", "x.confidence")
