from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from moodspark.functions.urls import resolve_url

BASES = ["https://a.org/x/y.html?q=1#f", "http://a.org", "http://a.org/", "https://a.org:80/d/"]
HREFS = [
    "https://b.org/z", "mailto:me", "//c.org/z", "/root", "/root/../up?k=/../v", "rel", "rel/b?c=d#e",
    "../up", "../../../top", "./same", "?only=query", "#part", "a/./b/../c/", "..", ".",
]


@pytest.mark.parametrize("base", BASES)
def test_against_the_standard_rules(spark, base):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(HREFS)], "i int, h string")
    got = df.orderBy("i").select(resolve_url(F.lit(base), F.col("h"))).collect()
    assert [r[0] for r in got] == [urljoin(base, h) for h in HREFS]
