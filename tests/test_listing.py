"""Golden listing and update cases over configuration documents."""

import pytest
from pyspark.sql import functions as F

from crawlatlas.functions.labels import matches_selector
from crawlatlas.operators import listing as R
from crawlatlas.operators import updates as U
from crawlatlas.operators.projection import mask_project

SCHEMA = ("id string, apiVersion string, kind string, meta struct<name:string,description:string,created:timestamp_ntz,"
          "createdBy:string,lastModified:timestamp_ntz,lastModifiedBy:string,label:array<struct<key:string,value:string>>>,"
          "crawlScheduleConfig struct<cronExpression:string>")


@pytest.fixture(scope="module")
def schedules(spark):
    def one(i, description, labels):
        return (f"id{i}", "v1", "crawlScheduleConfig",
                (f"csc{i}", description, None, "admin", None, "admin", labels), (f"{i} * * * *",))

    return spark.createDataFrame([
        one(1, "csc1desc", [("foo", "bar")]), one(2, "csc2desc", None),
        one(3, None, [("foo", "bar"), ("aaa", "bbb")])], SCHEMA)


def names(df):
    return sorted(r["n"] for r in df.select(F.col("meta.name").alias("n")).collect())


def test_listing(schedules):
    def found(**request):
        return names(R.list_rows(schedules, R.ListRequest(**request)))

    assert found(name_regex=".*3") == ["csc3"]
    assert found(template={"meta": {"name": "csc3"}}, template_mask=["meta.name"]) == ["csc3"]
    assert found(template={"meta": {"description": "csc2desc"}}, template_mask=["meta.description"]) == ["csc2"]
    assert found(template={}, template_mask=["meta.description"]) == ["csc3"]
    one = {"meta": {"label": [{"key": "foo", "value": "bar"}]}}
    assert found(template=one, template_mask=["meta.label"]) == ["csc1", "csc3"]
    both = {"meta": {"label": [{"key": "foo", "value": "bar"}, {"key": "aaa", "value": "bbb"}]}}
    assert found(template=both, template_mask=["meta.label"]) == ["csc3"]
    assert R.count_rows(schedules, R.ListRequest(name_regex="c[s|j]", page_size=1)).first()["count"] == 3
    assert found(label_selectors=["FOO:BA*"]) == ["csc1", "csc3"]
    assert found(label_selectors=["foo:", "bbb"]) == ["csc3"]
    assert found(label_selectors=[":"]) == ["csc1", "csc3"]
    assert found(offset=1) == []
    assert found(order_by="meta.name", descending=True, page_size=1) == ["csc3"]


def test_selectors(spark):
    df = spark.createDataFrame([([("Foo", "Bar")],)], "label array<struct<key:string,value:string>>")
    cases = {"foo:bar": True, "foo:": True, ":bar": True, "bar": True, "foo:ba*": True, ":ba*": True, "ba*": True,
             ":": True, "": True, "foo:ber": False, "be*": False, "bar:": False}
    got = df.select(*[matches_selector(F.col("label"), s).alias(str(i)) for i, s in enumerate(cases)]).first()
    assert list(got) == list(cases.values())


def test_masks_use_whole_segments(schedules):
    rows = mask_project(schedules, ["meta.label.key", "meta.name"])
    assert rows.columns == ["id", "apiVersion", "kind", "meta"]
    assert rows.schema["meta"].dataType.fieldNames() == ["name", "label"]
    assert rows.where("id = 'id3'").first()["meta"]["label"][0].asDict() == {"key": "foo"}
    with pytest.raises(ValueError, match="Valid field names"):
        mask_project(schedules, ["meta.nam"])


def test_filter_strings(schedules):
    assert names(R.filter_string(schedules, "meta.label+=foo:bar", "crawlScheduleConfig.cronExpression=1 * * * *")) == ["csc1"]
    for text, message in (("meta.name", "invalid filter"), ("meta.nope=1", "no field with name"),
                          ("meta.label=foo", "not a valid")):
        with pytest.raises(ValueError, match=message):
            R.filter_string(schedules, text)
    with pytest.raises(ValueError, match="Valid values"):
        R.add_filter(schedules.schema, "kind=x", {}, [], {"kind": ["seed"]})


def test_masked_updates(schedules):
    now = F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")
    labelled = F.exists("meta.label", lambda e: e["value"] == "bar")
    big = {"meta": {"label": [{"key": "big", "value": "bang"}]}}
    first = U.masked_update(schedules, labelled, big, ["meta.label+"], "ann", now)
    assert first.where("updated").count() == 2
    change = {"meta": {"label": [{"key": "aaa", "value": "bbb"}]}, "crawlScheduleConfig": {"cronExpression": "9 * * * *"}}
    mask = ["meta.label-", "meta.description", "crawlScheduleConfig.cronExpression", "meta.created"]
    second = U.masked_update(first.drop("updated"), F.lit(True), change, mask, "bob", now)
    assert second.where("updated").count() == 3
    later = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    third = U.masked_update(second.drop("updated"), F.lit(True), change, mask, "eve", later)
    assert third.where("updated").count() == 0
    row = third.where("id = 'id3'").first()
    assert [tuple(e) for e in row["meta"]["label"]] == [("foo", "bar"), ("big", "bang")]
    assert (row["meta"]["description"], row["meta"]["lastModifiedBy"]) == (None, "bob")


def test_upsert_keeps_creation(schedules):
    now = F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")
    new = schedules.where("id = 'id1'").withColumn("meta", F.col("meta").withField("name", F.lit("")).withField("createdBy", F.lit("x")))
    row = U.upsert_config(schedules, new, "ann", now).where("id = 'id1'").first()["meta"]
    assert (row["name"], row["createdBy"], row["lastModifiedBy"]) == ("csc1", "admin", "ann")


def test_sort_nulls_last(spark):
    df = spark.createDataFrame([("a", "10"), ("b", ""), ("c", "9"), ("d", "x")], "id string, v string")
    for descending, want in ((False, ["c", "a", "b", "d"]), (True, ["a", "c", "b", "d"])):
        assert [r["id"] for r in R.sort_nulls_last(df, "v", "number", descending).collect()] == want


def test_log_lookup_precedence(spark):
    logs = spark.createDataFrame([(1, "w1", "e1"), (2, "w2", "e1"), (3, "w3", "e2")],
                                 "ingestion_seq int, warc_id string, execution_id string")

    def ids(**request):
        return [r["warc_id"] for r in R.log_lookup(logs, **request).collect()]

    assert ids(warc_ids=["w1"], execution_id="e2") == ["w1"]
    assert ids(execution_id="e1") == ["w2", "w1"]
    assert ids(page_size=2) == ["w3", "w2"]
    assert ids() == ["w3"]
    with pytest.raises(ValueError):
        ids(other_filter=True)
