"""Golden rows of the rules: names, titles, links and files with what must come of them."""

from pyspark.sql import functions as F

from mulberry.functions import normalize as N
from mulberry.functions.titles import parse_titles, repair_jamo, standard_name, valid_genre
from mulberry.operators import archives, genres, keywords, naming, routing

JSON = [(1, '{"genre": "무협"}'), (2, '{"genre": ["판타지", "SF"]}'), (3, "{broken"), (4, '{"name": 1}'), (5, None)]
NAMES = [
    (1, "바보 성녀님은 2회차가 낯설어 1-371 完.txt", "바보 성녀님은 2회차가 낯설어", "", "1-371", True, "", "바보 성녀님은 2회차가 낯설어 1-371 (완)"),
    (2, "예시 100화 完.txt", "예시", "", "1-100", True, "", "예시 1-100 (완)"),
    (3, "예시 100화완.txt", "예시", "", "1-100", True, "", "예시 1-100 (완)"),
    (4, "무엇 1-546 完 2부 212", "무엇", "", "1-546 (완) 2부 1-212", False, "", "무엇 1-546 (완) 2부 1-212"),
    (5, "ㄷH공ㅂlㄱr", "대공비가", "", "", False, "", "대공비가"),
    (6, "무엇 1부完", "무엇", "1부", "", True, "", "무엇 1부 (완)"),
    (7, "회귀했더니 입대 전날 1-529 完 에필 및 외전 포함.txt", "회귀했더니 입대 전날", "", "1-529", True, "에필, 외전", "회귀했더니 입대 전날 1-529 (완) + 에필, 외전"),
    (8, "[선협] 어살 1-1014 完 (AI번역) @EE", "어살", "", "1-1014", True, "", "[선협] 어살 1-1014 (완)"),
    (9, "500조 재벌가 천재아들 1-324본편 및 외전 完, 후기 포함", "500조 재벌가 천재아들", "", "1-324", True, "외전, 후기", "500조 재벌가 천재아들 1-324 (완) + 외전, 후기"),
    (10, "초가류방 - 부황, 자공간유둔량 1-452 (완) + 외전", "초가류방 - 부황, 자공간유둔량", "", "1-452", True, "외전", "초가류방 - 부황, 자공간유둔량 1-452 (완) + 외전"),
    (11, "[임아소] 신선이 되자, 자손들이 저에게 출산해달라 부탁합니다. (완)", "신선이 되자, 자손들이 저에게 출산해달라 부탁합니다", "", "", True, "", "신선이 되자, 자손들이 저에게 출산해달라 부탁합니다 (완)"),
    (12, "100층의 올마스터 120 ", "100층의 올마스터", "", "1-120", False, "", "100층의 올마스터 1-120"),
    (13, "[현대 판타지 AI번역] 무엇 1-10", "무엇", "", "1-10", False, "", "[현판] 무엇 1-10"),
    (14, "제목 [개정판] 1-5 (완)", "제목", "", "1-5", True, "", "제목 [개정판] 1-5 (완)"),
    (15, "금병매지 1-20 完", "금병매지", "", "1-20", True, "", "금병매지 1-20 (완)"),
    (16, "", "", "", "", False, "", ""),
]
FILES = [("나 혼자 소드 마스터 1-1031 (완) + 외전 1-79, 에필.txt", "나 혼자 소드 마스터"), ("눈 감고 3점 슛 1-424 (완).txt", "눈 감고 3점 슛"), ("화산귀환 1-50화.txt", "화산귀환"), ("[판타지] 전지적 독자 시점 1-551 (완).epub", "전지적 독자 시점"), ("금리낭자 1-141 (완).txt", "금리낭자"), ("나혼자만레벨업_001.txt", "나혼자만레벨업")]
GENRES = [("현대 판타지", "현판"), ("전쟁·밀리터리", "역사"), ("패러디", "판타지"), ("공포", "미분류"), ("", "미분류"), (None, "미분류"), ("로맨스 판타지 소설", "로판"), ("무협", "무협")]
AUTHORS = [(0, "김 용", "무협"), (1, "홍길동", "역사"), (2, "김용", "선협"), (3, "이순", "현판")]
REMAP = [("현판", "축구 감독의 회귀", "스포츠"), ("판타지", "조선 왕조 연대기", "역사"), ("판타지", "회귀한 용사", "퓨판"), ("무협", "축구 감독", "무협"), ("판타지", "VR 게임 레벨업", "겜판"), ("현판", "축구", "현판"), ("판타지", "조선 왕조 마법", "판타지"), ("", "축구 감독", "")]
TEXTS = [(1, 0, "무협 소설"), (1, 1, "무협 판타지"), (2, 0, "판타지"), (3, 0, "야구"), (4, 0, "현대 판타지"), (4, 1, "현판 로판"), (4, 2, "로맨스 판타지, 현판"), (5, 0, "nothing")]
MERGE = [("무협", 0.5, 1, None, None, "무협", 0.5, "keyword_only"), ("미분류", 0.1, 0, "현판", 0.9, "현판", 0.9, "naver_only"), ("무협", 0.5, 3, "무협", 0.6, "무협", 0.8, "both_agree"), ("무협", 0.9, 3, "현판", 0.85, "현판", 0.85, "naver_high_confidence"), ("무협", 0.9, 3, "현판", 0.5, "무협", 0.9, "keyword_high_confidence"), ("무협", 0.9, 1, "현판", 0.7, "현판", 0.63, "naver_higher_confidence"), ("무협", 0.7, 2, "현판", 0.65, "무협", 0.63, "keyword_higher_confidence")]
LINKS = [("https://ssn.so/novel/12345", True), ("https://ssn.so/profile/user1", False), ("https://ssn.so/board/comments/999", False), ("https://other-site.com/info", True)]
QUERY_ROWS = [(1, "영마스터3여행기", "", "저자"), (2, "나 혼자 소드 마스터", "부제", ""), (3, "검", None, None)]
_QUERIES_OUT = [(1, 0, "영마스터3여행기 저자", 1), (1, 1, "영마스터3여행기", 2), (1, 2, "영마스터3여행기", 3), (1, 3, "영마스터 3 여행기", 4), (1, 4, "영마스터 3 여행기 저자", 5), (2, 0, "나 혼자 소드 마스터", 2), (2, 1, "소설 나 혼자 소드 마스터", 3), (2, 2, "부제", 4), (3, 0, "소설 검", 2), (3, 1, "검", 3)]
QUERIES_OUT = [(1, 0, "영마스터3여행기 저자", 1), (1, 1, "영마스터3여행기", 2), (1, 2, "영마스터3여행기", 3), (1, 3, "영마스터 3 여행기", 4), (1, 4, "영마스터 3 여행기 저자", 5), (2, 0, "나 혼자 소드 마스터", 2), (2, 1, "소설 나 혼자 소드 마스터", 3), (2, 2, "부제", 4), (3, 0, "소설 검", 2), (3, 1, "검", 3)]
NEW = [(1, "f", "a.txt"), (2, "f", "a.txt"), (3, "f", "b.txt"), (4, "g", "a.txt"), (5, "f", "a.txt")]
HAVE = [("f", "a.txt"), ("f", "a (2).txt"), ("f", "a (4).txt")]
MEMBERS = [
    ("one", "content.txt", 1000, False), ("big", "main.txt", 2_000_000, False), ("big", "readme.txt", 100, False), ("big", "info.txt", 50, False),
    ("dirs", "folder1/image1.jpg", 5, False), ("dirs", "folder1/image2.jpg", 5, False), ("dirs", "folder2/image3.jpg", 5, False),
    *[("all", f"t{i}.txt", 100_000, False) for i in range(5)], ("all", "image.jpg", 9, False), ("lone", "book.epub", 9, False),
]
METHODS = [("one", "extract_single_file", "content.txt"), ("big", "extract_single_file", "main.txt"), ("dirs", "extract_and_recompress_folders", None), ("all", "extract_all", None), ("lone", "extract_single_file", "book.epub"), ("none", "move_as_is", None)]
FOLDERS = [*[("x/few", f"{i}.txt", True) for i in range(3)], *[("x/many", f"{i}.txt", True) for i in range(4)], ("x/two", "a.zip", True), ("x/two", "b.RAR", True), ("x/two", "c.txt", True), ("x/single", "a.7z", True), ("x/single", "n.txt", True)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_titles(spark):
    p = parse_titles(spark.createDataFrame([r[:2] for r in NAMES], "pos long, raw_name string"))
    assert rows(p.select("pos", "title", "volume_info", "range_info", "is_completed", "side_story")) == sorted([(r[0], *r[2:7]) for r in NAMES], key=str)
    name = standard_name(valid_genre(F.col("original_genre")), *map(F.col, ("title", "edition_info", "volume_info", "range_info", "is_completed", "side_story")))
    assert rows(p.select("pos", name)) == sorted([(r[0], r[7]) for r in NAMES], key=str)


def test_repairs_and_plain_titles(spark):
    given = {"ㄷH공ㅂlㄱr": "대공비가", "ㄹㅔㅂ 1": "렙 1", "km 당": "km 당", "해리 porter": "해리 porter"}
    assert rows(spark.createDataFrame([(n,) for n in given], "n string").select("n", repair_jamo(F.col("n")))) == sorted(given.items(), key=str)
    assert rows(spark.createDataFrame(FILES, "file string, x string").select("file", N.plain_title(F.col("file")))) == sorted(FILES, key=str)
    assert rows(spark.createDataFrame(JSON, "id long, text string").select("id", F.array_join(N.json_genres(F.col("text")), "|"))) == [(1, "무협"), (2, "판타지|SF"), (3, ""), (4, ""), (5, "")]


def test_genres(spark):
    assert rows(spark.createDataFrame(GENRES, "name string, x string").select("name", genres.map_genre(F.col("name")))) == sorted(GENRES, key=str)
    assert rows(spark.createDataFrame(REMAP, "genre string, title string, x string").select("genre", "title", genres.remap_by_title(F.col("genre"), F.col("title")))) == sorted(REMAP, key=str)
    df = spark.createDataFrame(TEXTS, "query_id long, n long, text string").withColumn("key", F.struct("query_id", "n"))
    e = genres.text_evidence(df, "key", "text").select("key.query_id", "genre", (F.col("key.n") * 100 + F.col("pos")).alias("pos"))
    assert rows(genres.resolve_evidence(e, "query_id").withColumn("confidence", F.round("confidence", 6))) == [(1, "무협", 2, 0.74), (2, "판타지", 1, 0.67), (4, "현대판타지", 3, 0.81)]
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(MERGE)], "id long, kg string, kc double, n int, sg string, sc double")
    assert rows(df.select("id", genres.merge_results(*map(F.col, ("kg", "kc", "n", "sg", "sc"))).alias("r")).select("id", "r.*")) == [(i, *r[5:]) for i, r in enumerate(MERGE)]


def test_authors_links_and_searches(spark):
    df = spark.createDataFrame([("김용",), ("홍 길동",), ("이순신",), ("길동",), ("",), ("없음",)], "author string")
    want = [("김용", "선협"), ("홍 길동", "역사"), ("이순신", "현판"), ("길동", "역사"), ("", None), ("없음", None)]
    assert rows(keywords.author_genre(df, spark.createDataFrame(AUTHORS, "pos int, author string, genre string"))) == sorted(want, key=str)
    assert rows(spark.createDataFrame(LINKS, "link string, x boolean").select("link", routing.is_novel_page(F.col("link")))) == sorted(LINKS, key=str)
    df = spark.createDataFrame(QUERY_ROWS, "id long, title string, subtitle string, author string")
    got = df.select("id", F.posexplode(routing.search_queries(F.col("title"), F.col("subtitle"), F.col("author"))).alias("ord", "q")).select("id", "ord", "q.query", "q.priority")
    assert rows(got) == sorted(QUERIES_OUT, key=str)


def test_collisions_and_plans(spark):
    got = naming.free_names(spark.createDataFrame(NEW, "pos long, folder string, name string"), spark.createDataFrame(HAVE, "folder string, name string")).select("pos", "free_name")
    assert rows(got) == [(1, "a (1).txt"), (2, "a (3).txt"), (3, "b.txt"), (4, "a.txt"), (5, "a (5).txt")]
    many = spark.range(3000).select(F.col("id").alias("pos"), F.lit("f").alias("folder"), F.lit("a.txt").alias("name"))
    numbers = sorted(int(r.free_name[3:-5]) for r in naming.free_names(many, spark.createDataFrame(HAVE, "folder string, name string")).collect())
    assert numbers == [n for n in range(1, 3003) if n not in (2, 4)]
    members = spark.createDataFrame(MEMBERS, "archive string, name string, size long, is_dir boolean")
    assert rows(archives.archive_methods(members, spark.createDataFrame([(m[0],) for m in METHODS], "archive string"))) == sorted(METHODS, key=str)
    want = [*[(f, n, "copy", "") for f, n, _ in FOLDERS[:3]], *[(f, n, "copy", "many") for f, n, _ in FOLDERS[3:7]], *[(f, n, "copy", "two") for f, n, _ in FOLDERS[7:10]], ("x/single", "a.7z", "process_archive", "single"), ("x/single", "n.txt", "copy", "single")]
    assert rows(archives.folder_plan(spark.createDataFrame(FOLDERS, "folder string, name string, is_file boolean"))) == sorted(want, key=str)


def test_dictionaries_of_any_size(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "The nation and a heat"), (2, "thea the"), (3, None), (4, "")], "id long, text string")
    kw = spark.createDataFrame([(0, "a", 0, "tion", 2), (0, "a", 1, "ation", 5), (1, "b", 0, "the", 1), (1, "b", 1, "thea", 4)], "genre_pos int, genre string, pos int, keyword string, weight int")
    pairs = spark.createDataFrame([("a", "the", "tion"), ("b", "a", "the")], "genre string, kw1 string, kw2 string")

    def all_():
        return [rows(keywords.keyword_matches(texts, kw, "id", "text")), rows(keywords.list_scores(texts, kw, "id", "text")), rows(keywords.compound_pairs(texts, pairs, "id", "text"))]

    few = all_()
    monkeypatch.setattr(keywords, "ARRAY_KEYWORDS", 1)
    assert all_() == few and few[2] == [(1, "a", 1), (1, "b", 1), (2, "b", 1)]
