import hashlib

from lodestock import functions as fn

D = hashlib.sha256(b"x").hexdigest()


def values(spark, expression, rows, kind):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression("v")).collect()]


def test_label_key_merges_null_empty_and_the_literal(spark):
    assert values(spark, fn.label_key, [None, "", "unlabeled", " ", "Cat", "cat"], "string") == ["unlabeled"] * 3 + [" ", "Cat", "cat"]


def test_status(spark):
    assert values(spark, fn.status_text, [True, False, None], "boolean") == ["added", "already present", None]


def test_known_size(spark):
    assert values(spark, fn.known_size, [None, -1, 0, 5], "bigint") == [None, None, 0, 5]


def test_content(spark):
    assert values(spark, fn.content_digest, ["x", "", None], "string") == [D, hashlib.sha256(b"").hexdigest(), None]
    assert values(spark, fn.content_size, ["é", "", None], "string") == [2, 0, None]


def test_digest_of_any_writing(spark):
    good = [
        D,
        D.upper(),
        f"sha256:{D}",
        f"SHA256:{D.upper()}",
        f"sha256-{D}",
        f"urn:sha256:{D}",
        f"0x{D}",
        f"  {D}",
        f"{D}\r\n",
        f"{D}  ./img_2095.jpg",
        "-".join(D[i : i + 16] for i in range(0, 64, 16)),
        " ".join(D[i : i + 2] for i in range(0, 64, 2)),
    ]
    assert values(spark, fn.digest_of, good, "string") == [bytearray.fromhex(D)] * len(good)


def test_no_digest_in_damaged_values(spark):
    bad = [None, "", "sha256:", "n/a", D[:63], D[:63] + "?", D[:31] + "…", D[:40], D + "0", "pending", D[:60] + "  ./img_1.jpg", "z" * 64, "sha256" + D, D + "x", "g" + D, "+" + D[:63], " " * 64, " " * 5000]
    assert values(spark, fn.digest_of, bad, "string") == [None] * len(bad)
