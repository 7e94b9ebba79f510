"""Controlled vocabularies and rule constants. They must be as they are for right results."""

UNCLASSIFIED = "미분류"

# Genres that a standard name may carry.
NAME_GENRES = ["소설", "판타지", "현대", "현판", "무협", "선협", "스포츠", "퓨판", "역사", "로판", "SF", "겜판", "언정", "공포", "패러디", "미분류"]
# Genres that a platform's genre may be mapped to.
MAPPED_GENRES = ["현판", "퓨판", "무협", "로판", "겜판", "판타지", "SF", "역사", "선협", "언정", "스포츠", "소설", "미분류"]

# Standard genre of each platform genre, in order.
GENRE_MAP = {
    "로판": ["로맨스 판타지", "로맨스판타지", "로판", "로맨스", "BL", "GL"],
    "현판": ["현대판타지", "현대 판타지", "현대물", "현판", "현대"],
    "퓨판": ["퓨전판타지", "퓨전 판타지", "퓨전물", "퓨전", "퓨판"],
    "겜판": ["게임판타지", "게임 판타지", "게임", "겜판"],
    "무협": ["무협", "무협 소설", "전통 무협", "신무협"],
    "선협": ["선협"],
    "판타지": ["판타지", "정통판타지", "정통 판타지", "하이 판타지", "라이트노벨", "패러디", "팬픽", "팬픽션"],
    "SF": ["SF", "공상과학"],
    "스포츠": ["스포츠", "스포츠물"],
    "역사": ["역사", "역사물", "대체역사", "대체 역사물", "시대물", "밀리터리", "전쟁"],
    "언정": ["언정"],
    "소설": ["미스터리", "추리", "소설", "해외 소설", "일반소설"],
}

# Genre names of translation tags.
TAG_GENRES = {
    "현판": ["현대 판타지", "현판"],
    "무협": ["무협", "신무협", "퓨전 무협"],
    "판타지": ["판타지"],
    "로판": ["로맨스 판타지", "로판"],
    "겜판": ["게임 판타지", "겜판"],
    "퓨판": ["퓨전 판타지", "퓨판"],
    "선협": ["선협"],
    "SF": ["SF"],
    "역사": ["역사"],
    "공포": ["공포"],
    "스포츠": ["스포츠"],
    "언정": ["언정"],
}

# How specific a genre is; others 2.
SPECIFICITY = {1: ["소설"], 2: ["판타지"], 3: ["현판", "퓨판", "겜판", "무협", "선협", "로판", "언정", "SF", "미스터리", "밀리터리", "패러디"], 4: ["역사", "스포츠"]}

# Target genre -> (from, least hits, words, words that forbid it), in order.
TITLE_REMAP = {
    "스포츠": (["현판", "판타지"], 2, ["축구", "야구", "농구", "배구", "테니스", "골프", "선수", "코치", "감독", "호타", "준족"], ["영화", "드라마", "연극", "공연", "마왕", "용사", "마법"]),
    "역사": (["판타지", "현판"], 2, ["조선", "고려", "삼국시대", "삼국지", "왕조", "황제", "제국", "전쟁", "임진왜란", "병자호란", "외교관", "봉건", "이성계", "인조반정"], ["사이버펑크", "네오", "미래", "SF", "우주", "마왕", "용사", "마법", "던전", "게이트"]),
    "겜판": (["판타지", "퓨판"], 2, ["게임", "VR", "가상현실", "레벨업", "스킬", "아이템", "NPC", "플레이어"], []),
    "퓨판": (["판타지"], 1, ["회귀", "환생", "빙의", "차원", "이계", "전이", "귀환"], []),
}

# Platform -> (rank in effective order, place in the list, confidence).
PLATFORMS = {
    "리디북스": (1, 1, 0.95),
    "문피아": (2, 2, 0.92),
    "네이버시리즈": (3, 3, 0.88),
    "소설넷": (3, 5, 0.88),
    "카카오페이지": (4, 4, 0.90),
    "노벨피아": (6, 6, 0.92),
    "조아라": (7, 7, 0.85),
    "웹툰가이드": (8, 8, 0.75),
    "미스터블루": (9, 9, 0.85),
    "교보문고": (9, 10, 0.85),
    "YES24": (10, 11, 0.70),
    "알라딘": (11, 12, 0.85),
}

# Platform of an address, first match; all of the parts of one of the alternatives.
PLATFORM_URLS = [
    ("ridibooks", [["ridibooks.com/books/"]]),
    ("munpia", [["munpia.com/novel/"], ["novel.munpia.com"]]),
    ("novelpia", [["novelpia.com/novel/"]]),
    ("joara", [["joara.com", "/book/"]]),
    ("naver_series", [["series.naver.com"]]),
    ("kakao", [["page.kakao.com/content/"]]),
    ("novelnet", [["novelnet.co.kr"], ["novel.naver.com"], ["ssn.so"]]),
    ("webtoonguide", [["webtoonguide.com"]]),
    ("mrblue", [["mrblue.com"]]),
    ("yes24", [["yes24.com/product/goods/"]]),
    ("kyobo", [["kyobobook.co.kr", "/detail/"]]),
    ("aladin", [["aladin.co.kr"]]),
]

# Names shown for a provenance, first contained one.
SOURCE_NAMES = {
    "리디북스": "리디북스", "ridibooks": "리디북스", "문피아": "문피아", "munpia": "문피아", "네이버시리즈": "네이버시리즈", "naver_series": "네이버시리즈",
    "카카오페이지": "카카오페이지", "kakaopage": "카카오페이지", "소설넷": "소설넷", "novelnet": "소설넷", "노벨피아": "노벨피아", "novelpia": "노벨피아",
    "조아라": "조아라", "joara": "조아라", "웹툰가이드": "웹툰가이드", "webtoonguide": "웹툰가이드", "미스터블루": "미스터블루", "mrblue": "미스터블루",
    "교보문고": "교보문고", "kyobo": "교보문고", "yes24": "YES24", "알라딘": "알라딘", "aladin": "알라딘", "keyword": "키워드", "cache": "캐시", "user": "사용자",
}

# Patterns that are evidence of a genre in a text, and the genres' ranks.
EVIDENCE = {
    "판타지": (20, ["판타지", "fantasy"]),
    "무협": (85, ["무협"]),
    "현대판타지": (75, [r"현대\s*판타지", "현판", r"어반\s*판타지"]),
    "로맨스판타지": (75, [r"로맨스\s*판타지", "로판"]),
    "게임판타지": (75, [r"게임\s*판타지", "겜판"]),
    "퓨전판타지": (50, [r"퓨전\s*판타지", "퓨판"]),
    "선협": (90, ["선협"]),
    "스포츠": (95, ["스포츠", "바둑", "야구", "축구", "농구", "격투기", "권투", "복싱", "골프", "배구", "테니스"]),
    "대체역사": (70, [r"대체\s*역사", "역사"]),
    "SF": (65, ["SF", "공상과학", "사이파이"]),
    "공포": (60, ["공포", "호러", "미스터리", "스릴러"]),
    "로맨스": (40, ["로맨스", "순정"]),
    "라이트노벨": (60, [r"라이트\s*노벨", "라노벨"]),
    "드라마": (10, ["드라마"]),
    "패러디": (100, ["패러디", "팬픽", r"2차\s*창작", "fanfic"]),
}
GENERIC_EVIDENCE = ["판타지", "소설", "드라마"]
GENERIC_GENRES = ["소설", "판타지", "미스터리", "드라마"]
RICH_SITES = ["dcinside.com", "namu.wiki", "arca.live", "instiz.net", "theqoo.net"]

# Words of a title that name a genre by themselves, by genre in order.
SPECIFIC_KEYWORDS = {
    "스포츠": [
        "축구", "야구", "농구", "복싱", "복서", "격투기", "킥복싱", "무에타이", "MMA", "UFC", "태권도", "유도", "배구", "테니스", "골프", "수영", "마라톤",
        "풋볼", "베이스볼", "바스켓볼", "투수", "타자", "골키퍼", "스트라이커", "리베로", "세터", "스파이커", "호타", "준족",
    ],
    "현판": [
        "아이돌", "작곡가", "가수", "배우", "연예인", "감독", "영화감독", "드라마감독", "애니메이션감독", "프로듀서", "매니저",
        "한의사", "의사", "변호사", "검사", "도예가", "화가", "요리사", "재벌", "회계사", "교수", "탐정", "징수",
    ],
    "역사": [
        "조선", "고려", "삼국", "삼국지", "고조선", "백제", "신라", "가야", "발해", "고구려", "임진왜란", "병자호란", "갑신정변", "동학농민운동",
        "광복", "독립운동", "항일", "세계대전", "2차대전", "1차대전", "나폴레옹", "히틀러", "무솔리니",
    ],
}

# Patterns of the title parser, by step.
NOISE = [
    r"@\S+", r"ⓒ\S+", r"©\S+", r"(?<!\S)저자[:\s]*\S+", r"(?<!\S)작가[:\s]*\S+", r"(?<!\S)글[:\s]*\S+", r"(?<!\S)by\s+\S+",
    r"(?:www\.)?[\w-]+\.(?:com|net|co\.kr|kr|cafe)", r"네이버\s*카페", r"다음\s*카페", "문피아", "조아라", "카카오페이지", "시리즈",
    r"(?<!\S)번역[:\s]*\S+", r"(?<!\S)역자[:\s]*\S+", r"\[번역\]", r"\(번역\)",
]
TAG_WORDS = ["판타지", "무협", "현판", "퓨판", "로판", "겜판", "SF", "역사", "선협", "언정", "공포", "스포츠", "소설", "단행본", "연재중", "미분류"]
EDITION_WORDS = ["개정판", "완전판", "수정판", "합본", "특별판", "무삭제판", "개정증보판"]
ADULT_WORDS = ["19금", "15금", "성인"]
PLATFORM_TAGS = [
    r"\[임아소\]", r"\[네이버시리즈\]", r"\[카카오페이지\]", r"\[문피아\]", r"\[조아라\]", r"\[리디북스\]", r"\[노벨피아\]",
    r"\(\s*AI번역\s*\)", r"\[\s*AI번역\s*\]", r"\(\s*AI\s*번역\s*\)", r"\[\s*AI\s*번역\s*\]",
    r"\[\s*(?:소설|웹소설)\s*(?:-\s*텍|텍본|txt)?\s*\]", r"\(\s*(?:소설|웹소설)\s*(?:-\s*텍|텍본|txt)?\s*\)", r"\[\s*텍본\s*\]", r"\(\s*텍본\s*\)",
]
COMPLETION = [
    r"\(\s*완결\s*\)", r"\[\s*완결\s*\]", r"\(\s*完\s*\)", r"\[\s*完\s*\]", r"\(\s*완\s*\)", r"\[\s*완\s*\]",
    r"(?<!\S)完(?!\S)", r"(?<!\S)완(?!\S)", r"(?<!\S)완결(?!\S)", r"(?<!\S)完\s*(?=\+)", r"(?<!\S)완\s*(?=\+)",
    r"\(\s*Complete\s*\)", r"\(\s*END\s*\)", r"\(\s*Fin\s*\)", r"본편\s*완결",
    r"(?<=[0-9화권부편회장])完(?!\S)", r"(?<=[0-9화권부편회장])완(?!\S)", r"(?<=[0-9화권부편회장])완결(?!\S)",
]
SIDE_WORDS = ["番外", "외전", "후기", "에필로그", "에필", "특별편", "번외편", "스핀오프", "후일담", "특외", "외포", "外"]
CHINESE_ENDINGS = ["지", "록", "담", "기담", "전기", "열전", "비록", "야사", "연의", "지전", "기전", "행기", "유기", "몽기", "환기", "선기"]
CHINESE_EXCEPTIONS = ["역전기", "전기", "일기", "세기", "용기", "인기", "무도"]

# Letters that look like jamo, and the jamo in Unicode's order of composition.
LOOKALIKE_JAMO = dict(zip("rRlIHkoijpuhynbm", "ㅏㅏㅣㅣㅐㅏㅐㅑㅓㅔㅕㅗㅛㅜㅠㅡ", strict=True))
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MEDIALS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
VOWEL_PAIRS = {"ㅗㅣ": "ㅚ", "ㅜㅣ": "ㅟ", "ㅡㅣ": "ㅢ", "ㅏㅣ": "ㅐ", "ㅓㅣ": "ㅔ"}

ARCHIVE_SUFFIXES = [".zip", ".rar", ".7z", ".zipx"]
SCAN_SUFFIXES = [".txt", ".epub", *ARCHIVE_SUFFIXES]
PROTECTED_FOLDERS = ["Temp", ".git", "__pycache__", ".vs", "logs", "config"]
BOX_DRAWING = "┌┐└┘├┤┬┴┼─│╒╓╔╕╖╗╘╙╚╛╜╝╞╟╠╡╢╣╤╥╦╧╨╩╪╫╬"

# Genre of the names that platforms' pages use, in order; the extractors' own list.
PAGE_GENRES = {
    "판타지": "판타지", "퓨전판타지": "퓨판", "퓨전 판타지": "퓨판", "퓨전": "퓨판", "현대판타지": "현판", "현대 판타지": "현판", "현판": "현판",
    "게임판타지": "겜판", "게임 판타지": "겜판", "게임": "겜판", "무협": "무협", "무협 소설": "무협", "전통 무협": "무협", "선협": "선협",
    "로맨스": "로판", "로맨스판타지": "로판", "로맨스 판타지": "로판", "로판": "로판", "BL": "로판", "언정": "언정", "SF": "SF", "스포츠": "스포츠",
    "스포츠물": "스포츠", "역사": "역사", "역사물": "역사", "대체역사": "역사", "대체 역사물": "역사", "정통판타지": "판타지", "정통 판타지": "판타지",
    "미스터리": "미스터리", "소설": "소설", "해외 소설": "소설", "라이트노벨": "판타지", "팬픽": "판타지", "팬픽션": "판타지", "패러디": "패러디",
    "밀리터리": "밀리터리", "전쟁 밀리터리": "밀리터리", "전쟁": "밀리터리", "현대": "현판",
}

# Keys of the platforms' names.
PLATFORM_KEYS = {
    "리디북스": "ridibooks", "문피아": "munpia", "노벨피아": "novelpia", "조아라": "joara", "네이버시리즈": "naver_series", "카카오페이지": "kakao",
    "소설넷": "novelnet", "웹툰가이드": "webtoonguide", "미스터블루": "mrblue", "YES24": "yes24", "교보문고": "kyobo", "알라딘": "aladin",
}

# Orders and lists of single platforms' extractors.
RIDI_ORDER = ["역사", "스포츠", "무협", "선협", "로판", "겜판", "현판", "퓨판", "SF", "판타지", "미분류"]
RIDI_LINKS = ["퓨전 판타지", "현대 판타지", "게임 판타지", "로맨스 판타지", "무협", "판타지"]
RIDI_TEXT = ["퓨전판타지", "퓨전 판타지", "현대판타지", "게임판타지", "로맨스판타지", "판타지", "무협", "로맨스"]
MUNPIA_MILITARY = ["전쟁·밀리터리", "전쟁 밀리터리", "밀리터리", "전쟁"]
MUNPIA_HISTORY = ["대체역사", "대체 역사", "역사"]
MUNPIA_FANTASY = ["판타지", "현대판타지", "퓨전판타지", "퓨전", "현판"]
MUNPIA_PAIRS = [("현대판타지", "스포츠", "스포츠"), ("현대판타지", "퓨전", "현대판타지"), ("판타지", "퓨전", "퓨전판타지"), ("판타지", "게임", "게임판타지")]
EBOOK_GENRES = {
    "소설": "소설", "판타지": "판타지", "로맨스": "로판", "무협": "무협", "BL": "로판", "라이트노벨": "판타지", "추리/미스터리": "미스터리", "SF": "SF",
    "역사": "역사", "스릴러": "스릴러", "공포": "공포", "시/에세이": "소설", "인문": "소설", "자기계발": "소설",
}
NOVELNET_ORDER = [
    "스포츠", "무협", "선협", "현판", "현대판타지", "현대 판타지", "겜판", "게임판타지", "게임 판타지", "로판", "로맨스판타지", "로맨스 판타지", "로맨스",
    "퓨판", "퓨전판타지", "퓨전 판타지", "역사", "대체역사", "시대물", "SF", "판타지",
]
NOVELPIA_COMPOUND = {
    "현대판타지": "현판", "현대 판타지": "현판", "로맨스판타지": "로판", "로맨스 판타지": "로판", "퓨전판타지": "퓨판", "퓨전 판타지": "퓨판", "게임판타지": "겜판", "게임 판타지": "겜판",
}
NOVELPIA_PAIRS = [("로맨스", "판타지", "로판", "로맨스+판타지"), ("판타지", "퓨전", "퓨판", "판타지+퓨전"), ("무협", "게임", "겜판", "무협+게임"), ("현대", "판타지", "현판", "현대+판타지")]
NOVELPIA_SINGLE = [
    "무협", "선협", "로판", "로맨스판타지", "로맨스 판타지", "로맨스", "현판", "현대판타지", "현대 판타지", "현대", "겜판", "게임판타지", "게임 판타지", "게임",
    "퓨판", "퓨전판타지", "퓨전 판타지", "퓨전", "스포츠", "스포츠물", "역사", "역사물", "SF", "BL", "판타지", "소설",
]
WEBTOONGUIDE_ORDER = {
    "로맨스 판타지": "로판", "로맨스판타지": "로판", "퓨전 판타지": "퓨판", "퓨전판타지": "퓨판", "현대 판타지": "현판", "현대판타지": "현판", "현판": "현판",
    "게임 판타지": "겜판", "게임판타지": "겜판", "겜판": "겜판", "무협 판타지": "무협", "무협판타지": "무협", "무협": "무협", "로맨스": "로판", "로판": "로판",
    "BL": "로판", "bl": "로판", "역사": "역사", "액션": "액션", "스릴러": "스릴러", "미스터리": "미스터리", "공포": "공포", "코미디": "코미디", "판타지": "판타지",
}
KYOBO_SPECIFIC = {"판타지소설": "판타지", "무협소설": "무협", "로맨스소설": "로판", "역사소설": "역사", "SF소설": "SF", "추리소설": "미스터리", "미스터리소설": "미스터리"}

# What is replaced in the titles of a platform's pages, in order; (?i) where case doesn't matter.
PAGE_TITLES = {
    "ridibooks": [(r"(?i)\s*-\s*(판타지|로맨스|로판|무협|BL|현대판타지|퓨전판타지|게임판타지|정통판타지|선협|역사|SF|스포츠|겜판|퓨판|현판)?\s*(웹소설|e북|전자책|소설)?\s*-?\s*리디.*$", "")],
    "munpia": [
        (r" - 웹소설 문피아| - 문피아", ""), (r"\s*\[.*?\]\s*", ""), (r"^(개정판|합본|특별판|완전판|무삭제판|리마스터판)\s*[-|]\s*", ""), (r"\s*[-|]\s*(개정판|합본|특별판|완전판|무삭제판|리마스터판)$", ""),
    ],
    "naver_series": [
        (r"\s*[\[\(【<].*?[\]\)】>]\s*", " "), (r"(?i)\s*[-|]\s*(웹소설\s*홈\s*:\s*)?네이버\s*시리즈.*$", ""), (r"(?i)^네이버\s*시리즈\s*$", ""),
        (r"^(개정판|합본|특별판|완전판|무삭제판|리마스터판)\s*[|]\s*", ""), (r"\s*[|]\s*(개정판|합본|특별판|완전판|무삭제판|리마스터판)$", ""),
    ],
    "kakao": [(r"(?i)\s*-\s*(웹소설|웹툰|책)\s*\|?\s*카카오페이지.*$", ""), (r"(?i)\s+\d+화\s*\|?\s*카카오페이지.*$", "")],
    "novelpia": [(r"^노벨피아\s*-\s*웹소설로\s*꿈꾸는\s*세상!\s*-\s*", ""), (r"\s*-\s*노벨피아$", "")],
    "webtoonguide": [(r"\[웹소설/소설\]", ""), (r"<([^>]+)>", "$1"), (r"\[단행본\]|\[세트\]", ""), (r"\s*세트\s*$", ""), (r"\s*단행본\s*$", ""), (r"\s*-\s*웹툰의 모든 것!.*$", "")],
    "yes24": [(r"(?i)\s*-\s*예스24.*$", ""), (r"\s*\|.*$", "")],
    "kyobo": [(r"(?i)\s*-\s*교보문고.*$", ""), (r"\s*\|.*$", ""), (r"\s+\d+\s*\([^)]+\)\s*$", ""), (r"\s+\d+권?\s*$", ""), (r"\s*\([^)]*(?:완결|완|부)\s*[^)]*\)\s*$", ""), (r"[!?]+$", "")],
    "aladin": [(r"(?i)\s*-\s*알라딘.*$", ""), (r"\s+\d+-\d+\s*(완결|세트|권)?.*$", ""), (r"\s*/[^|]+$", ""), (r"\s+\(.*?\)$", ""), (r"\s*\|.*$", "")],
}

# Leading tags of the older normaliser: genres that stay, synonyms, and what translators add.
TAG_GENRES_KEPT = ["소설", "판타지", "현대", "현판", "무협", "선협", "스포츠", "퓨판", "역사", "로판", "SF", "겜판", "언정", "공포", "패러디"]
TAG_SYNONYMS = {
    "신무협": "무협", "퓨전무협": "무협", "퓨전 무협": "무협", "퓨전판타지": "퓨판", "퓨전 판타지": "퓨판", "현대판타지": "현판", "현대 판타지": "현판",
    "대체역사": "역사", "대체 역사": "역사", "퓨전": "퓨판", "게임": "겜판", "로맨스": "로판", "BL": "로판",
}
TRANSLATED = r"(?iU)\s*(?:[Aa][ㅣlI]?번역|AI번역|기계번역|손번역|번역가?|[Aa][lI]?번역)\s*"

# Signs of a name that the older normaliser hasn't seen, and of one that it has.
RAW_NAME_SIGNS = [
    r"(?i)(?<!\()(完|완결?|Complete)(?!\))", r"(?<!\+\s)(外|외포|번외|에필로그|외전포함)", r"(?U)\b0\d+", r"[@ⓒ]", r"(?U)[_+](?!\s+(외전|에필|후기))", r"\(외전포함\)", r"\d+-\d+(회|화|권)",
    r"(?U)\d+-\d+\s+\(완\)\s+[\(\[\{]?(개정판|완전판|수정판)", r"(?U)\d{1,4}부\s+[\(\[\{](개정판|완전판|수정판)", r"(?U)\d{1,4}부\s+\d{1,4}부", r"\d{1,4}부_\d{1,4}부", r"^\(",
    r"(?U)\(완\)\s*-\s*[가-힣]{2,4}", r"\[[가-힣]{2,4}\]", r"\d{1,4}부,\d{1,4}부", r"\d+\(완\)", r"(?U)[가-힣a-zA-Z]\d+\s*-\s*\d+", r"(?U)\s+\+\s+\w+\s+\+\s+", r"(?U)외전\s+\d+-\d+\s+\(완\)",
]
SETTLED_NAME = r"(?U)\d{1,4}부\s+\d{1,4}-\d{1,4}\s+\(완\)\s+\d{1,4}부\s+\d{1,4}-\d{1,4}\s+\(완\)"
SIDE_RUNS_ON = r"(?iU)(외전|外)\s*(연재\s*중|미완)|\[외전\d+-\d+화?미완\]"
