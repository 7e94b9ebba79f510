"""Rules on names as data: what their documentation gives as examples, and rules of one's own."""

from pyspark.sql import functions as F

from mulberry.functions import rules as r

SYMBOLS = {
    "001_304": "001-304", "제목 1부_2부": "제목 1-2부", "제목 1_2부": "제목 1-2부", "001회~111회": "001회-111회", "( 001회-111회)": "(001회-111회)", "제목 (19N)_x": "제목 (19N) x", "제목 (18+) a+b": "제목 (18+) a b", "제목 (~144)": "제목 1-144",
    "삼국지 ~난세서~": "삼국지 - 난세서", "제목 1-.355": "제목 1-355", "1,2,3부": "1-3부", "1, 2부": "1-2부", "1- 2부": "1-2부", "1 - 787": "1-787", "아이들1부": "아이들 1부", "산하1-192": "산하 1-192", "1-318(완)": "1-318 (완)", "메이지(완)": "메이지 (완)",
    "外 5": "외전 5", "1-100 外": "1-100 외전", "1-6841,2부": "1-6841§§COMMA§§2부", "a~b": "a-b", "😀 1_2 😀": "😀 1-2 😀", "": "",
}
RANGES = {
    "제목 [1-111]": ("제목", "1-111", []), "제목 (001회-111회)": ("제목", "1-111", []), "제목 (1-36)": ("제목", "1-36", []), "제목 01권-04권": ("제목", "1-4", []), "제목 001회-111회": ("제목", "1-111", []), "제목 001-178": ("제목", "1-178", []),
    "제목 -203": ("제목", "1-203", []), "-99레벨 대마법사": ("-99레벨 대마법사", None, []), "2부 532-562": ("2부", "532-562", []), "제목 2부 -203": ("제목 2부", "1-203", []), "제목 1-3부 814": ("제목 1-3부", "1-814", []), "제목 1부 2부": ("제목 1-2부", None, []),
    "제목 1-6841§§COMMA§§2부": ("제목 1-2부", "1-684", []), "제목 1-430화 1부": ("제목 1부", "1-430", []), "제목 1-406 1-2부": ("제목 1-2부", "1-406", []), "제목 1115 시즌4": ("제목 시즌4", "1-1115", []), "007": ("007", None, []), "1874 대혁명": ("1874 대혁명", None, []),
    "163,417,413번째": ("163,417,413번째", None, []), "제목 123화": ("제목", "1-123", []), "제목 [에필로그후기]": ("제목", None, ["에필", "후기"]), "제목 [외전후기]": ("제목", None, ["외전", "후기"]), "제목 1-50 [외전1-5화미완]": ("제목", "1-50", ["외전 1-5"]),
    "제목 1-50 외전 11화": ("제목", "1-50", ["외전 11"]), "제목 1-50 외전 1-5": ("제목", "1-50", ["외전 1-5"]), "제목 1-50, 외전, 후기": ("제목", "1-50", ["외전", "후기"]), "제목 1-50 특외8화": ("제목", "1-50", ["특외 8"]), "제목 1-50 후일담 1-46": ("제목", "1-50", ["후일담 1-46"]),
    "제목 1-50 번외": ("제목", "1-50", ["번외"]), "제목 1-50 추가외전": ("제목", "1-50", ["외전", "추가외전"]), "제목 1-50 에필로그 1-5": ("제목", "1-50", ["에필 1-5"]), "제목 1-외전": ("제목", None, ["외전"]), "혈기린외전 1-20": ("혈기린외전", "1-20", []),
    "제목 2부 1-50 외전": ("제목 2부", "1-50", ["외전"]), "😀 제목 3-50 😀": ("😀 제목 😀", "3-50", []), "": ("", None, []),
}


def test_symbols(spark):
    df = spark.createDataFrame([(n,) for n in [*SYMBOLS, None]], "n string")
    assert {x.n: x.s for x in df.select("n", r.standard_symbols(F.col("n")).alias("s")).collect()} == SYMBOLS | {None: None}


def test_ranges_and_extras(spark):
    df = spark.createDataFrame([(n,) for n in [*RANGES, None]], "n string")
    got = {x.n: x.r and (x.r.title, x.r.range_info, x.r.extras) for x in df.select("n", r.range_and_extras(F.col("n")).alias("r")).collect()}
    got.pop(None)
    assert {n: (got[n], w) for n, w in RANGES.items() if got[n] != w} == {}


def test_rules_of_ones_own(spark):
    rules = [r.Rule("range", r"#(\d+)\.\.(\d+)", "<$2>", ("1", "2")), r.Rule("range", r"@(\d+)", "", ("1",)), r.Rule("numbers", r"x(\d+)", "", ("ex",)), r.Rule("label", "end", "", ("done",)), r.Rule("part", "!"), r.Rule("end", "", only="part"), r.Rule("rewrite", "a", "b")]
    df = spark.createDataFrame([("a #01..020 #3..4 @5 x007 x1 end",), ("a! @00",), (None,)], "n string")
    got = [tuple(x) for x in df.select(r.applied(F.col("n"), rules).alias("s")).select("s.*").collect()]
    assert got == [("b <020> #3..4 @5   ", "1-20", ["ex 7", "ex 1", "done"], False, False), ("a! ", "1-0", [], True, True), (None,) * 5]
