import pytest
from pyspark.sql import functions as F

from mulberry.functions import platforms as P


@pytest.fixture(scope="module")
def found(spark):
    def find(platform, *pages, url="https://x"):
        df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").withColumn("p", P.page_fields("html"))
        rows = df.select("i", P.EXTRACTORS[platform](F.col("p"), F.lit(url)).alias("g")).orderBy("i").collect()
        return [r.g and (r.g.genre, r.g.raw_genre, r.g.confidence) for r in rows]

    return find


def test_ridibooks(found):
    ld = '<script type="application/ld+json">{"genre": "현대 판타지"}</script>'
    crumb = '<nav class="breadcrumb"><a>홈</a><a>무협 소설</a></nav>'
    assert found("ridibooks", ld + crumb, crumb, "<meta name=keywords content='로맨스 판타지 소설'>", "<a href=x>게임 판타지</a>", "<p>퓨전판타지 이야기</p>", "<p>무엇</p>", None) == [
        ("현판", "현대 판타지", 0.95), ("무협", "무협", 0.95), ("로판", "로맨스 판타지 소설", 0.95), ("겜판", "게임 판타지", 0.95), ("퓨판", "퓨전판타지", 0.9), None, None,
    ]


def test_munpia(found):
    def path(s):
        return f'<p class="meta-path">웹소설 > 연재 > {s}</p>'

    assert found("munpia", path("현대판타지, 스포츠"), path("대체역사, 판타지"), path("전쟁·밀리터리, 판타지"), path("판타지, 퓨전"), path("무협"), path("무협, 로맨스"), '<p class="meta-path">연재 <strong>판타지,게임</strong></p>', "<p>선협 이야기</p>") == [
        ("스포츠", "스포츠", 0.92), ("역사", "대체역사", 0.92), ("판타지", "판타지", 0.92), ("퓨판", "퓨전판타지", 0.92), ("무협", "무협", 0.92), ("로판", "로맨스", 0.92), ("겜판", "게임판타지", 0.92), ("선협", "선협", 0.85),
    ]


def test_naver_series(found, spark):
    link = '<a href="/ebook/categoryProductList.series?genreCode=301">라이트노벨</a>'
    assert found("naver_series", link, "<a href=/other>기타</a><p>무협</p>", url="https://series.naver.com/ebook/detail") == [("판타지", "라이트노벨", 0.88), ("무협", "무협", 0.88)]
    assert found("naver_series", '<meta name="description" content="이야기 #전생 #무협">', '<meta property="og:description" content="현대 판타지입니다">', "<title>제목</title><body>선협 제목 겜판</body>") == [("무협", "무협", 0.88), ("현판", "현대 판타지", 0.88), None]
    df = spark.createDataFrame([("<title>제목</title><body>선협 제목 게임" + "x" * 2000 + "무협</body>",)], "html string").select(P.page_fields("html").alias("p"))
    both = df.select(P.naver_series(F.col("p"), F.lit("u")).genre.alias("whole"), P.naver_series(F.col("p"), F.lit("u"), near=1000).genre.alias("near")).first()
    assert tuple(both) == ("겜판", "겜판")
    flags = spark.createDataFrame([('<meta name="description" content="#현판">',)], "html string").withColumn("p", P.page_fields("html")).select(P.naver_series(F.col("p"), F.lit("u")).alias("g")).first().g
    assert (flags.needs_sports_check, flags.needs_history_check, flags.needs_fantasy_refinement) == (True, False, False)


def test_novelnet_and_mrblue(found):
    category = '<div class="product-category"><a>판타지</a> <a>현대판타지</a> <a>스포츠</a></div>'
    assert found("novelnet", '<meta name="keywords" content="현대판타지, 스포츠">', category, '<span class="genre-name">무협 소설</span>', "<p>언정</p>") == [("스포츠", "스포츠", 0.88), ("스포츠", "스포츠", 0.88), ("무협", "무협 소설", 0.88), ("언정", "언정", 0.8)]
    assert found("mrblue", '<meta property="og:description" content="정통 무협">', '<li class="badge">로맨스판타지 신작</li>', '<ul class="breadcrumb">홈 SF</ul>', "<p>역사물</p>") == [("무협", "무협", 0.85), ("로판", "로맨스판타지", 0.85), ("SF", "SF", 0.85), ("역사", "역사물", 0.75)]


def test_kakao_novelpia_joara(found):
    assert found("kakao", '<span class="break-all align-middle">연재</span><span class="break-all align-middle">무협</span>', "<p>퓨전 판타지</p>") == [("무협", "무협", 0.9), ("퓨판", "퓨전 판타지", 0.85)]
    assert found("novelpia", '<span class="tag">#판타지</span><span class="tag">#현대</span>', '<p class="hash"># 로맨스판타지</p>', "<p>이야기 #무협</p>", '<div class="tags">#판타지</div>', "<p>전쟁</p>") == [("현판", "현대+판타지", 0.92), ("로판", "로맨스판타지", 0.92), ("무협", "무협", 0.92), ("판타지", "판타지", 0.92), ("밀리터리", "전쟁", 0.8)]
    assert found("joara", '<div class="items"><span>패러디</span><span>무협</span></div>', '<title>로그인</title><div class="items"><span>무협</span></div>', '<div class="items"><span>다른</span></div>') == [("패러디", "패러디", 0.85), None, None]


def test_shops_and_webtoonguide(found):
    assert found("webtoonguide", '<div class="sc-gEvEer iWC"><b>웹소설/소설</b><div class="sc-cwHptR">판타지/무협</div><div class="gKqaMv">퓨전 판타지</div></div>', "<div class=x><b>무협</b></div>") == [("퓨판", "퓨전 판타지", 0.75), None]
    assert found("kyobo", '<div class="breadcrumb_list">HOME > 소설 > 한국소설 > 판타지소설</div>', '<ul class="category">HOME > 국내도서 > 한국소설일반</ul>', "<p>무협</p>") == [("판타지", "판타지소설", 0.85), ("소설", "소설", 0.6), None]
    book = '<script type="application/ld+json">{"@type": "Book", "genre": ["소설", "판타지/무협", "없음"]}</script>'
    assert found("yes24", book, '<a href="?CategoryNumber=1">소설</a><a href="?CategoryNumber=2">로맨스</a>', '<script type="application/ld+json">{broken</script>') == [("판타지", "판타지/무협", 0.7), ("로판", "로맨스", 0.7), None]
    assert found("aladin", '<a href="?CID=1">소설</a><a href="?CID=2">기타</a>', "<a href=x>소설</a>") == [("소설", "소설", 0.85), None]


def test_titles_and_order(spark):
    rows = [
        ("ridibooks", "<title>후회의 산미 - 로판 웹소설 - 리디</title>", "후회의 산미"),
        ("munpia", '<title>x</title><h2 class="title">[연재] 검의 노래</h2>', "검의 노래"),
        ("naver_series", '<meta property="og:title" content="네이버 시리즈"><h1>MENU</h1><h2>검의 노래 (완결)</h2>', "검의 노래"),
        ("kakao", "<title>마왕 조동칠 - 웹소설 | 카카오페이지</title>", "마왕 조동칠"),
        ("novelpia", '<meta property="og:title" content="노벨피아 - 웹소설로 꿈꾸는 세상! - 검의 노래">', "검의 노래"),
        ("webtoonguide", "<title>[웹소설/소설] &lt;마신 여포&gt; 세트</title>", "마신 여포"),
        ("yes24", "<title>마이언 전기 1 | 임달영 | 프로넷 - 예스24</title>", "마이언 전기 1"),
        ("kyobo", "<title>최강을 꿈꾸다 7(1부 완결) | 은서휘 - 교보문고</title>", "최강을 꿈꾸다"),
        ("aladin", "<title>제4세대 지판전기 1-5 완결 /대현문화사 - 알라딘</title>", "제4세대 지판전기"),
    ]
    df = spark.createDataFrame(rows, "platform string, html string, want string").withColumn("p", P.page_fields("html"))
    assert all(r.got == r.want for r in df.select(P.page_name(F.col("platform"), F.col("p")).alias("got"), "want").collect())
    some = spark.createDataFrame([([("판타지",), ("무협",), None],), ([("다른",), None],), ([],)], "f array<struct<genre:string>>")
    assert [r.g and r.g.genre for r in some.select(P.best_ridibooks(F.col("f")).alias("g")).collect()] == ["무협", "다른", None]
    names = spark.createDataFrame([("문피아",), ("YES24",), ("Other",)], "n string").select(P.platform_key(F.col("n")).alias("k"))
    assert [r.k for r in names.collect()] == ["munpia", "yes24", "other"]


def test_odd_pages(spark):
    rows = [(None,), ("",), ("</div></p><b", ), ("<div class=tag>" * 200 + "x",), ("<p>" + "w " * 50_000,)]
    got = spark.createDataFrame(rows, "html string").withColumn("p", P.page_fields("html")).select(P.platform_genre(F.lit("novelpia"), F.col("p"), F.lit("u")).alias("g")).collect()
    assert [r.g for r in got] == [None] * 5
