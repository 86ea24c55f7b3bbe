import base64
import json

from pyspark.sql import functions as F

from drawlake.sources import messages


def decode(spark, *values, **options):
    rows = [(i, v if isinstance(v, bytes) else json.dumps(v).encode()) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "id int, value binary")
    good, bad = messages.split_messages(frame, **options)
    return {r.id: r for r in good.collect()}, {r.id: r.reason for r in bad.collect()}


def packed(body):
    return base64.b64encode(json.dumps(body).encode()).decode()


BODY = {"execution_id": "e", "lottery_type": " LOTO6 ", "gcs_bucket": "b", "gcs_object": "o/p.csv", "draw_no": "7"}


def test_the_shapes_agree(spark):
    good, bad = decode(spark, {"message": {"data": packed(BODY)}}, {"data": packed(BODY)}, BODY)
    assert not bad and len(good) == 3
    for r in good.values():
        assert (r.execution_id, r.lottery_type, r.gcs_uri, r.bucket, r.object, r.draw_no) == ("e", "loto6", "gs://b/o/p.csv", "b", "o/p.csv", 7)


def test_broken_messages_get_a_reason(spark):
    good, bad = decode(
        spark, b'{"lottery_type": ', [1, 2], {"note": 1}, {"message": {}}, {"data": "%%%"}, {"data": packed([1])},
        {**BODY, "lottery_type": "mini"}, {"lottery_type": "loto6"}, {**BODY, "gcs_uri": "http://x/y"}, {**BODY, "gcs_uri": "gs://only"},
    )
    assert not good
    assert [bad[i] for i in range(10)] == [
        "invalid_json", "not_object", "empty_data", "empty_data", "invalid_data", "not_object",
        "unsupported_type", "missing_uri", "invalid_uri", "invalid_uri",
    ]


def test_uri_sources_in_order(spark):
    base = {"lottery_type": "loto7", "execution_id": "e"}
    good, _ = decode(
        spark, {**base, "gcs_uri": "gs://u/v", "gcs_bucket": "b", "gcs_object": "o"}, {**base, "gcs_bucket": "b", "gcs_object": "", "name": "n"},
        {**base, "gcs_path": "p"}, default_bucket="raw",
    )
    assert [good[i].gcs_uri for i in range(3)] == ["gs://u/v", "gs://b/n", "gs://raw/p"]


def test_flags_ids_and_numbers(spark):
    good, _ = decode(
        spark, {**BODY, "notify": False}, {**BODY, "notify": "false"}, {**BODY, "notify": ""}, {**BODY, "notify": 0},
        {**BODY, "draw_no": "x", "execution_id": ""}, {**BODY, "execution_id": None},
    )
    assert [good[i].notify for i in range(4)] == [False, True, False, False]
    assert good[4].draw_no is None and good[4].notify is True
    assert len(good[4].execution_id) == 64 and len(good[5].execution_id) == 64
    assert good[4].execution_id == decode(spark, {**BODY, "draw_no": "x", "execution_id": ""})[0][0].execution_id


def test_encode_round_trip(spark):
    rows = spark.createDataFrame([("loto6", "gs://b/第.csv")], "lottery_type string, gcs_uri string")
    good, bad = messages.split_messages(messages.encode(rows, ["lottery_type", "gcs_uri"]))
    assert bad.isEmpty() and good.select(F.col("object")).first()[0] == "第.csv"
