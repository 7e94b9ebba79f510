from pyspark.sql import functions as F

from mulberry.functions import html as H


def test_text_after_3000_characters_counts(spark):
    page = "<html><body><p>" + "lorem " * 2000 + "무협</p></body></html>"
    p = F.col("p")
    r = spark.createDataFrame([(page,)], "p string").select(H.visible_text(p).alias("t"), H.visible_text(p, 3000).alias("c"), H.genre_of_page(p).alias("g")).first()
    assert r.t.endswith("무협") and len(r.t) == 12_002 and len(r.c) == 3000
    assert (r.g["genre"], r.g["source"]) == ("무협", "body")
