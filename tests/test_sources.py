import glob

import pytest
from pyspark.errors import AnalysisException

from moodspark import schemas
from moodspark.sources import keyed, tables
from moodspark.sources.stored import StoredTable
from tests.conftest import rows


def test_missing_table(spark, tmp_path):
    path = str(tmp_path / "absent")
    empty = tables.read_table(spark, path, schemas.POST_COMMENTS, missing="empty")
    assert empty.columns == ["id", "account_name", "post_url", "post_caption", "comment"]
    assert empty.count() == 0
    with pytest.raises(AnalysisException):
        tables.read_table(spark, path, schemas.POST_COMMENTS)
    with pytest.raises(ValueError):
        tables.read_table(spark, path, missing="empty")
    with pytest.raises(ValueError):
        tables.read_table(spark, path, missing="ignore")


def test_author_names_are_never_read(spark, tmp_path):
    path = str(tmp_path / "comments")
    spark.createDataFrame(
        [(1, 2, "somebody", "text", 3, 4)],
        "id bigint, article_id bigint, user string, comment string, upvotes int, downvotes int",
    ).write.parquet(path)
    assert "user" not in tables.read_table(spark, path, schemas.COMMENTS_VOTED).columns
    for name in dir(schemas):
        assert "user" not in str(getattr(schemas, name)) or not name.isupper()


def test_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.overwrite(spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string"), path)
    tables.overwrite(spark.createDataFrame([(3, "c")], "n int, s string"), path)
    assert rows(tables.read_table(spark, path)) == [(3, "c")]


def test_overwrite_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    schema = "n int, source string"
    tables.overwrite(spark.createDataFrame([(1, "a"), (2, "b")], schema), path, ["source"])
    tables.overwrite(spark.createDataFrame([(3, "b")], schema), path, ["source"], only_touched=True)
    assert rows(tables.read_table(spark, path)) == [(1, "a"), (3, "b")]
    with pytest.raises(ValueError):
        tables.overwrite(spark.createDataFrame([(3, "b")], schema), path, only_touched=True)


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    data = [
        ("insta_1", "instagram", 'say "hi", you', "a\nb", None),
        ("insta_2", "instagram", "", " spaced ", "neutral"),
        ("insta_3", "instagram", "back\\slash", "comma, comma", "positive"),
    ]
    df = spark.createDataFrame(data, schemas.PREDICTIONS)
    tables.write_csv(df, path)
    assert rows(tables.read_csv(spark, path, schemas.PREDICTIONS)) == sorted(data, key=repr)


def test_save_stage(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "n int, s string")
    kept = tables.save_stage(df, "unit")
    assert rows(kept) == rows(df)
    root = spark.conf.get("spark.checkpoint.dir")
    assert all(f.startswith(f"file:{root}/unit-") or f.startswith(f"file://{root}/unit-") for f in kept.inputFiles())


def test_prompt_table_is_repeatable(spark, tmp_path):
    df = spark.createDataFrame([("u1", "one"), ("u2", "two")], "post_url string, prompt string")
    assert rows(tables.prompt_table(df, "post_url")) == rows(tables.prompt_table(df.repartition(5), "post_url"))
    tables.write_prompts(df, str(tmp_path / "prompts"), "post_url")
    assert {r[1] for r in rows(tables.read_table(spark, str(tmp_path / "prompts")))} == {"one", "two"}


def test_report_files_are_in_order(spark, tmp_path):
    lines = [(s, f"{p:04d}", f"line {s} {p}") for s in (2, 0, 10, 1) for p in (3, 1, 2)]
    df = spark.createDataFrame(lines, "section int, position string, line string").repartition(6)
    tables.write_report_input(df, str(tmp_path / "report"))
    text = "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "report" / "part-*"))))
    assert text.splitlines() == [x[2] for x in sorted(lines)]


BASE = [("both", 1, "old"), ("base", 1, "old")]
DELTA = [("both", 5, "new"), ("delta", 1, "first"), ("delta", 3, "last"), ("delta", 2, "middle")]
KV = "k string, v int, t string"


@pytest.mark.parametrize("parts", [1, 7])
def test_upsert_and_insert(spark, parts):
    base = spark.createDataFrame(BASE, KV).repartition(parts)
    delta = spark.createDataFrame(DELTA, KV).repartition(parts)
    once = keyed.upsert(base, delta, ["k"], ["v"])
    assert rows(once) == [("base", 1, "old"), ("both", 5, "new"), ("delta", 3, "last")]
    assert rows(keyed.upsert(once, delta, ["k"], ["v"])) == rows(once)
    added = keyed.insert_missing(base, delta, ["k"], ["v"])
    assert rows(added) == [("base", 1, "old"), ("both", 1, "old"), ("delta", 1, "first")]
    assert rows(keyed.insert_missing(added, delta, ["k"], ["v"])) == rows(added)


@pytest.mark.parametrize("per_split", [2, 1_000_000])
def test_replace_children(spark, per_split):
    schema = "article_id int, id int, comment string"
    base = spark.createDataFrame(
        [(1, n, "old") for n in range(40)] + [(2, 100, "stays"), (3, 101, "goes"), (None, 102, "orphan")], schema
    )
    delta = spark.createDataFrame([(1, 200, "new")], schema)
    refreshed = spark.createDataFrame([(1,), (3,), (1,)], "article_id int")
    got = keyed.replace_children(
        base, delta, refreshed, ["article_id"], ["id"], rows_per_split=per_split
    )
    assert rows(got) == [(1, 200, "new"), (2, 100, "stays"), (None, 102, "orphan")]


def test_null_keys_are_keys(spark):
    base = spark.createDataFrame([(None, 1, "old"), ("a", 1, "old")], KV)
    delta = spark.createDataFrame([(None, 2, "new"), (None, 3, "newer"), ("b", 1, "new")], KV)
    once = keyed.upsert(base, delta, ["k"], ["v"])
    assert rows(once) == sorted([(None, 3, "newer"), ("a", 1, "old"), ("b", 1, "new")], key=repr)
    assert rows(keyed.upsert(once, delta, ["k"], ["v"])) == rows(once)
    added = keyed.insert_missing(base, delta, ["k"], ["v"])
    assert rows(added) == sorted([(None, 1, "old"), ("a", 1, "old"), ("b", 1, "new")], key=repr)
    assert rows(keyed.insert_missing(added, delta, ["k"], ["v"])) == rows(added)


def test_stored_table(spark, tmp_path, monkeypatch):
    table = StoredTable(spark, f"{tmp_path}/t", KV, ["k"], buckets=5)
    assert table.read().collect() == []
    base = spark.createDataFrame([(f"k{n}", 1, "old") for n in range(40)] + [(None, 1, "old")], KV)
    table.insert_missing(base, ["v"])
    delta = spark.createDataFrame([("k3", 2, "new"), (None, 5, "new"), (None, 4, "older"), ("more", 1, "new")], KV)
    table.upsert(delta, ["v"])
    want = [(f"k{n}", 1, "old") for n in range(40) if n != 3] + [("k3", 2, "new"), (None, 5, "new"), ("more", 1, "new")]
    assert rows(table.read()) == sorted(want, key=repr)
    # buckets that were not touched keep their folders
    folders = table._folders()
    table.upsert(delta, ["v"])
    assert rows(table.read()) == sorted(want, key=repr)
    kept = [b for b, f in table._folders().items() if f == folders[b]]
    assert len(table._folders()) == 5 and kept
    table.upsert(delta.limit(0), ["v"])
    # a run that stops after writing its rows changes nothing
    monkeypatch.setattr(StoredTable, "_switch", lambda *_: 1 / 0)
    before = table.versions()
    with pytest.raises(ZeroDivisionError):
        table.upsert(spark.createDataFrame([("k1", 9, "lost")], KV), ["v"])
    assert rows(table.read()) == sorted(want, key=repr) and table.versions() == before
    # and so does one that stops while it writes the new list
    (tmp_path / "t" / "versions" / "99").mkdir()
    assert table.versions() == before and rows(table.read()) == sorted(want, key=repr)


def test_stored_children(spark, tmp_path):
    schema = "article_id int, id int, comment string"
    table = StoredTable(spark, f"{tmp_path}/c", schema, ["article_id"], buckets=3)
    table.insert_missing(spark.createDataFrame([(1, 1, "a")], schema), ["id"])
    table.replace_children(
        spark.createDataFrame([(2, 2, "b"), (2, 3, "c")], schema), spark.createDataFrame([(2,)], "article_id int"), ["id"]
    )
    assert rows(table.read()) == [(1, 1, "a"), (2, 2, "b"), (2, 3, "c")]
    table.replace_children(
        spark.createDataFrame([(2, 9, "new")], schema), spark.createDataFrame([(1,), (2,)], "article_id int"), ["id"]
    )
    assert rows(table.read()) == [(2, 9, "new")]


def test_bad_csv_records_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,name\n1,one\n2\n3,"a, b",c\nfour,four\n5,"five\nlines"\n6,\n')
    good, bad = tables.read_csv_checked(spark, str(tmp_path / "x.csv"), "id int, name string")
    assert rows(good) == [(1, "one"), (5, "five\nlines"), (6, None)]
    assert [r.bad_record for r in bad.orderBy("bad_record").collect()] == ["2", '3,"a, b",c', "four,four"]
    assert good.count() + bad.count() == 6 and bad.where("file LIKE '%x.csv'").count() == 3


def test_keys(spark):
    df = spark.createDataFrame([("http://a",), ("http://b",), ("http://a",)], "url string")
    ids = [r["id"] for r in keyed.with_key(df, "url").collect()]
    assert len(set(ids)) == 2
