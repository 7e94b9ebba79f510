"""All links between titles, and which rows stand for which title."""

import difflib
from collections import Counter

import duckdb

from mulberry.operators import similarity as s
from mulberry.plans import decision_queries as d


def bare(title):
    return "".join(c for c in title.lower() if c.isalnum() or c == "_")


def test_the_query_gives_every_link(spark):
    """Each part finds, under the part that stands for what it asks, all titles that reach the bar, as brute force has them."""
    parts = {r.p_partkey: bare(f"{r.p_brand} {r.p_name}") for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    rows = d.fuzzy_matches(spark, "/root/testdata/sf0.001").collect()
    asked, found = {r.p_partkey: bare(r.asked) for r in rows}, {}
    for r in rows:
        if r.link_id is not None:
            assert r.p_partkey == r.class_id and found.setdefault(r.p_partkey, {}).setdefault(parts[r.link_id], r.link_ratio) == r.link_ratio
    assert {r.p_partkey: r.class_id for r in rows} == {k: min(j for j in asked if asked[j] == t) for k, t in asked.items()} and asked.keys() == parts.keys()
    assert {r.p_partkey: r.title_id for r in rows} == {k: min(j for j in parts if parts[j] == t) for k, t in parts.items()}
    for r in rows:
        want = {t: difflib.SequenceMatcher(None, asked[r.p_partkey], t).ratio() for t in set(parts.values())}
        want = {t: x for t, x in want.items() if x >= 0.85}
        assert found.get(r.class_id, {}) == want and r.n_links == len(want)
    assert len(rows) == sum(map(len, found.values())) + len(parts) - len(found) and max(map(len, found.values())) > 1


def test_links_of_classes(spark):
    left = spark.createDataFrame([(4, "The 영웅 Story!"), (2, "the 영웅story"), (3, None), (5, "..."), (6, "nothing like it"), (None, "THE 영웅 STORY")], "id int, name string")
    right = spark.createDataFrame([(9, "the 영웅 storys"), (8, "The 영웅 story"), (7, "the 영웅 Story"), (6, ""), (None, "the 영웅 stories")], "page int, title string")
    got = s.linked_titles(left, right, "id", "name", "page", "title")
    assert got.columns == ["id", "name", "match_id", "match_title", "ratio", "n_links", "class_id", "link_id", "link_title", "link_ratio"]
    near, far = 20 / 21, 2 * 9 / 22
    assert far < 0.85
    best = (7, "the 영웅 Story", 1.0, 2, 2)
    want = [(4, *best, None, None), (None, *best, None, None), (2, *best, 7, 1.0), (2, *best, 9, near)] + [(i, None, None, None, 0, c, None, None) for i, c in ((3, None), (5, None), (6, 6))]
    assert Counter((r.id, r.match_id, r.match_title, r.ratio, r.n_links, r.class_id, r.link_id, r.link_ratio) for r in got.collect()) == Counter(want)


def test_odd_titles_as_in_sql(spark, tmp_path):
    """Titles of more than 200 letters are linked by all of them; signs, marks, empty and null titles and keys count as in the SQL."""
    long = "a bird in the hand is worth two in the bush " * 7
    names = [long, long + "end", long[:90] + "q" + long[91:], long[5:], "", None, "!!", *(f"red ring {c} number one" for c in ("²", "½", "é", "é", "_", "‿", "Ⅷ", "ͅ", "ー", "😀"))]
    rows = [(i - 2 if i else None, None if i % 5 == 4 else "Brand", n) for i, n in enumerate([*names, *names[:4], names[8]])]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    df = d.fuzzy_matches(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({d.ORACLES['fuzzy_matches']})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert Counter(got) == Counter(want) and any(r[10] is not None and r[10] < 1 and len(r[1]) > 250 for r in got)
